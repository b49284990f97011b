import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, norm double, block int"


def brute(rows, k, is_query):
    vectors = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v and i is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in {i for i, _ in vectors if is_query(i)}:
        best = {}
        for qi, qv in vectors:
            if qi == q:
                for i, v in vectors:
                    if i != q and len(v) == len(qv):
                        s = sum(a * b for a, b in zip(qv, v))
                        best[i] = max(best.get(i, s), s)
        for rank, (s, i) in enumerate(sorted((-s, i) for i, s in best.items())[:k], 1):
            out.add((q, rank, i, -s))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1.0, 4) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("seed,spread", [(1, 1.0), (2, 0.02), (3, 8.0)])
def test_matches_brute_force(spark, seed, spread, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "SEED_ROWS", 32)
    monkeypatch.setattr(topk, "QUERY_ROWS", 8)
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=6)
    rows = [(n, [float(np.float32(x)) for x in (centre + rng.normal(size=6) * spread) * rng.choice([0.1, 1, 5])]) for n in range(120)]
    got = {tuple(r) for r in topk.top_k(frame(spark, rows), F.col("vec_id") % 10 == 0, k=4).collect()}
    assert got == brute(rows, 4, lambda i: i % 10 == 0)


def test_awkward_vectors(spark):
    rows = [
        (0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, []), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [0.0, 0.0]),
        (10, [0.0, 0.0]), (11, [1.0]), (12, [-1.0, -2.0]), (1, [1.0, 2.0]), (None, [1.0, 1.0]), (20, [3e30, 1.0]), (21, [2.0, 3e30]),
    ]
    small = rows[:-2]
    got = {tuple(r) for r in topk.top_k(frame(spark, small), F.col("vec_id") % 10 == 0).collect()}
    assert got == brute(small, 10, lambda i: i % 10 == 0)
    assert topk.top_k(frame(spark, rows), F.col("vec_id") == 20).where("vec_id = 21").first()["score"] == 2**63 - 1
    assert topk.top_k(frame(spark, []), F.col("vec_id") == 0).count() == 0


def test_one_long_vector_does_not_spoil_the_floors(spark, monkeypatch):
    """The first pass counts rows: a bucket of a single row is not enough for it."""
    import numpy as np

    seen, best = [], topk._best

    def counting(found, k):
        out = best(found, k)
        seen.append(out.groupBy("query_id").count().where(f"count = {k}").count())
        return out

    monkeypatch.setattr(topk, "_best", counting)
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(3000, 8)).tolist() + [[1000.0] * 8]
    got = topk.top_k(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>"), "vec_id % 100 = 0").collect()
    assert seen[0] == 31 and len(got) == 310
    whole = np.floor(np.array(vectors) * 1024).astype(np.int64)
    for q in (0, 1500):
        score = whole @ whole[q]
        order = [n for n in np.lexsort((np.arange(3001), -score)) if n != q][:10]
        assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [(n, score[n]) for n in order]
