"""Scores and ranks against plain Python, and the sharing DAG against plain sums."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tempora.llm import lexical, queries

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k=50):
    counts = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, terms in asked.items():
        scored = []
        for doc, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, n, doc, -s) for n, (s, _, doc) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=lambda r: r[:2])


def found(df):
    return sorted([(r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()], key=lambda r: r[:2])


def test_terms():
    for text in ("Ab-c9_ é×ß\x00x\x7fy", "", "…“q” 漢字🙂Z", " a\x1cb"):
        assert [t.decode() for t in lexical.terms_of(text.encode())] == TERM.findall(text.translate(LOWER))


@pytest.mark.parametrize("seed", range(6))
def test_dag(seed):
    dice = random.Random(seed)
    stems = [frozenset(dice.sample(range(60), dice.randint(2, 12))) for _ in range(5)]
    sets = {i: set().union(*dice.sample(stems, dice.randint(0, 3)), dice.sample(range(60), dice.randint(0, 5))) for i in range(30)}
    dag = lexical.share(sets, 60)
    for n, of in enumerate(dag.nodes, 60):
        assert of and max(of) < n
    shares = np.array([[dice.randrange(10**12) for _ in range(7)] for _ in range(60)])
    got = lexical.accumulate(dag.nodes, list(dag.items.values()), shares)
    for row, s in zip(got, sets.values(), strict=True):
        assert (row == shares[sorted(s)].sum(axis=0)).all()
    saved = sum(map(len, sets.values())) - sum(map(len, dag.items.values())) - sum(map(len, dag.nodes))
    assert saved > 0 and dag.nodes


def test_shared_sets_are_summed_once():
    dag = lexical.share({1: {0, 1, 2, 3}, 2: {0, 1, 2, 4}, 3: {0, 1, 2, 3, 4}, 4: {7}}, 8)
    assert [0, 1, 2] in dag.nodes and all(len(of) <= 3 for of in dag.items.values()) and dag.items[4] == [7]


def test_whole_tables(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert found(queries.op12_lexical(spark, sf)) == want
    assert found(lexical.search(docs, items, block=7)) == want  # several blocks of items
    assert found(lexical.search(docs, items, k=3)) == [r for r in want if r[1] <= 3]


def test_small_blocks_of_documents(spark, sf, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", 1)
    monkeypatch.setattr(lexical, "MERGED", 1)
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    docs, items = docs.limit(60).repartition(5), items.limit(9)
    assert found(lexical.search(docs, items, k=4)) == plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 4)


def test_awkward_rows(spark, awkward, nothing):
    rows = [(1, "the quick BROWN fox"), (1, "jumps"), (2, None), (3, ""), (None, "dog"), (4, "absent-word"), (5, "word 漢字 ß"), (6, "the " * 50_000)]
    items = spark.createDataFrame([(*r, 1) for r in rows], "item_id long, text string, score int")
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    assert found(lexical.search(awkward, items)) == plain(docs, rows)
    assert found(lexical.search(nothing, items)) == []
    assert found(lexical.search(awkward, items.limit(0))) == []
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert found(lexical.search(none, items)) == []


def test_ties_and_repeated_rows(spark):
    docs = [(n % 70, "same words here") for n in range(140)] + [(None, "same words here")] * 3 + [(500, "other words")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    items = [(1, "same"), (2, "other same words")]
    assert found(lexical.search(df, spark.createDataFrame(items, "item_id long, text string"))) == plain(docs, items)
    assert found(lexical.search(df, spark.createDataFrame(items, "item_id long, text string"), k=200)) == plain(docs, items, 200)
