"""Words, pairs, forms and roots against plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest

from tempora.llm import queries, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(rows, often=5):
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= often}


def edited(a, b):
    """Exactly one edit apart."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def plain(words):
    by = {}
    for w in words:
        by.setdefault(len(w), []).append(w)
    near = {w: [x for k in (-1, 0, 1) for x in by.get(len(w) + k, []) if edited(w, x)] for w in words}
    form = {}
    for w, around in near.items():
        best = min(around, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def found(df):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]


def same(df, rows):
    got = found(df)
    assert len(got) == len(set(got)) and set(got) == plain(plain_words(rows))


def test_edits():
    assert edited("abc", "abcd") and edited("abc", "bc") and edited("abc", "axc") and not edited("abc", "abc") and not edited("abc", "acb")


def test_words_of_whole_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(plain_words(rows)) > 500
    same(queries.op13_spelling(spark, sf), rows)


@pytest.mark.parametrize("prune", [1, 4, 1000])
def test_dense_families(spark, prune):
    """Thousands of near pairs in families that share most of their grams, with grams pruned early and late."""
    dice = random.Random(5)
    words = {"".join(dice.choice("ab") for _ in range(dice.randint(6, 9))) for _ in range(400)}
    words |= {"aaaaaa", "aaaaaaa", "a" * 300, "a" * 299 + "b", "é" * 6, "é" * 7}
    words |= {f"commonstem{a}{b}" for a in "abcdefgh" for b in "abcdefgh"}
    got = spelling.near_pairs(spark.createDataFrame([(w, 5) for w in words], "word string, n long"), prune=prune, most=50).collect()
    want = {frozenset((a, b)) for a in words for b in words if edited(a, b)}
    assert len(got) == len(want) and {frozenset((r.a, r.b)) for r in got} == want


def test_decomposition_bounds():
    for word in ("abcdef", "aaaaaaaaa", "commonstemab"):
        (p, g), (q, h) = spelling.decompose(word, {"ab": 50, "aa": 90, "aaa": 70, "co": 40, "com": 33})
        assert p + len(g) <= q and word[p : p + len(g)] == g and word[q : q + len(h)] == h


def test_chains_lead_to_the_last_form(make_docs):
    text = " ".join(f"{w} " * n for w, n in (("colouring", 3125), ("coloring", 625), ("coloringx", 125), ("coloringxy", 25), ("coloringxyz", 5), ("Coloringxyz", 0)))
    rows = [(1, text), (1, None), (None, "")]
    docs = make_docs(rows)
    same(spelling.variants(docs), rows)
    assert {r.root for r in spelling.variants(docs).collect()} == {"colouring"}


def test_awkward_rows(awkward, nothing, make_docs):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    same(spelling.variants(awkward.withColumnRenamed("score", "word").withColumnRenamed("size", "n")), rows)
    assert spelling.variants(nothing).count() == 0
    rows = [(None, "unnamed " * 9), (None, "unnamed " * 9), (3, "Unnamed×÷ ÀÉÎÕÜß éééééé " * 5), (4, "x" * 100_000 + " "), (4, ("y" * 2_000 + " ") * 5), (5, ("y" * 2_001 + " ") * 30)]
    same(spelling.variants(make_docs(rows)), rows)


def test_lists_and_words_are_not_broadcast(spark, make_docs):
    # a small file of words whose lists, once exploded, are fifty times as large
    text = " ".join(f"common{a}{b}stem " * 5 for a in "abcdefghij" for b in "abcdefghij") + "rarerword " * 25 + "rareword " * 5
    docs = make_docs([(1, text)])
    found = spelling.words(docs)
    for df in (spelling.near_pairs(spelling.materialise(found, "test-words")), spelling.variants(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    same(spelling.variants(docs), [(1, text)])
