"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are grouped by length (bit length of the squared norm, in eighths) and each bucket is cut into blocks of a bounded number of rows.
A first pass scores every query against the longest vectors, which gives it a floor: its k-th best score so far. In the second pass a query
goes only to buckets whose greatest length can still reach the floor, and inside a block the floor becomes a
local cosine threshold. High thresholds prune by coordinates: a unit vector at that cosine must have the query's largest
coordinate within an interval. Low ones prune by length alone. What is left is multiplied out and merged.

Queries travel in blocks too, so a task holds one block of each side, and no side is broadcast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

K = 10
SCALE = 1024
BLOCK_ROWS = 1024
QUERY_ROWS = 4096
#: From this local cosine on, coordinates are looked at before products.
COORDINATE_FROM = 0.8
#: Rows that the first pass takes at least, longest first.
SEED_ROWS = 1024

_FOUND = "query_id long, vec_id long, score long"


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, v, dim, norm): components floor(scale * x). Null vectors, and those with null or non-finite components or a null id, are left out."""
    x = F.col(vec_col)
    fit = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (
        df.where(F.col(id_col).isNotNull() & x.isNotNull())
        .where(fit)
        .select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double")).alias("v"))
        .withColumn("dim", F.size("v"))
        .withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)))
    )


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products; past 2**53 by Python's integers, held to the range of a long."""
    if q.shape[1] * np.abs(q).max(initial=0) * np.abs(c).max(initial=0) < 2**53:
        return (q @ c.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(q) @ whole(c).T, -(2**63), 2**63 - 1).astype(np.int64)


def best_of_block(qid, q, floor, cid, c, k: int = K) -> pd.DataFrame:
    """(query_id, vec_id, score): for each query of a block, the k best of a block of candidates that may be among its k best of all.

    floor: a score that each query's k-th best reaches (-inf: unknown). Ties go to smaller ids, a candidate with the query's own id doesn't count,
    and a repeated id counts once, by its best score.
    """
    lengths = np.sqrt((c * c).sum(axis=1))
    order = np.argsort(-lengths, kind="stable")
    cid, c, lengths = cid[order], c[order], lengths[order]
    q_len = np.sqrt((q * q).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = floor / (q_len * lengths[0]) * (1 - 1e-12)
        need = floor / q_len * (1 - 1e-12)
    cosine[~np.isfinite(cosine)], need[~np.isfinite(need)] = -1.0, -np.inf
    out = []

    def verify(asked: np.ndarray, left: np.ndarray) -> None:
        ids, at = np.unique(cid[left], return_inverse=True)
        by_id = np.argsort(at, kind="stable")
        starts = np.flatnonzero(np.diff(at[by_id], prepend=-1))
        scores = np.maximum.reduceat(_products(q[asked], c[left])[:, by_id], starts, axis=1)
        for i, s in zip(asked, scores, strict=True):
            may = np.flatnonzero((s >= floor[i]) & (ids != qid[i]))
            if len(may) > k:
                may = may[s[may] >= np.partition(s[may], -k)[-k]]
            best = may[np.lexsort((ids[may], -s[may]))][:k]
            out.append(pd.DataFrame({"query_id": np.full(len(best), qid[i]), "vec_id": ids[best], "score": s[best]}))

    unit = c / np.maximum(lengths, 1e-300)[:, None]
    for i in np.flatnonzero((cosine >= COORDINATE_FROM) & (cosine <= 1)):
        u, t = q[i] / q_len[i], cosine[i]
        f = int(np.abs(u).argmax())
        reach = np.sqrt((1 - t * t) * max(0.0, 1 - u[f] * u[f])) + 1e-9
        left = np.flatnonzero(unit[:, f] * np.sign(u[f]) >= abs(u[f]) * t - reach)
        if len(left):
            verify(np.array([i]), left)
    for asked in np.array_split(dull := np.flatnonzero(cosine < COORDINATE_FROM), max(1, len(dull) // 256)):
        if len(asked):
            # candidates shorter than every floor needs can't reach one
            left = np.arange(np.searchsorted(-lengths, -max(0.0, need[asked].min()), side="right"))
            if len(left):
                verify(asked, left)
    found = pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    return found.astype("int64")


def _pass(queries: DataFrame, candidates: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """The best of each pair of blocks that `targets` (qblock, dim, bucket, block) lists; queries have a floor each."""

    def run(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        return best_of_block(
            left["vec_id"].to_numpy(), np.stack(left["v"]), left["floor"].to_numpy(float), right["vec_id"].to_numpy(), np.stack(right["v"]), k
        )

    asked = queries.join(targets, ["qblock", "dim"])
    met = candidates.join(targets.toDF(*targets.columns), ["dim", "bucket", "block"])
    met = met.select(*[F.col(c).alias(c) for c in ("qblock", "dim", "bucket", "block", "vec_id", "v")])
    keys = ["qblock", "dim", "bucket", "block"]
    return asked.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInPandas(run, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query: a repeated candidate counts once; best first, ties to smaller ids."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(df: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows of df where the Column `is_query` holds, the k highest integer inner products with other rows.

    Vectors that are null or hold null or non-finite components take no part; empty ones meet each other, with product 0. Vectors of another dimension aren't candidates. Rows with the query's own id
    aren't; a repeated candidate id counts once with its best score, a repeated query id gives the best over its rows. Fewer than k candidates: all of them. An empty table
    gives an empty result. Products outside the range of a long are held to its ends.
    """
    vectors = integer_vectors(df, id_col, vec_col, scale)
    bucket = F.floor(F.log2(F.col("norm") + 1) * 8).cast("int")
    stats = materialise(
        vectors.groupBy("dim", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.max("norm").alias("longest")), "topk-buckets"
    )
    blocks = stats.withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("long"))
    placed = materialise(
        vectors.withColumn("bucket", bucket)
        .join(blocks.select("dim", "bucket", "blocks"), ["dim", "bucket"])
        .withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("blocks")))  # any deal will do
        .drop("blocks"),
        "topk-vectors",
    )
    asking = placed.where(is_query)
    n = asking.groupBy("dim").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("long").alias("qblocks"))
    queries = materialise(
        asking.join(n, "dim").select("vec_id", "v", "dim", "norm", F.pmod(F.xxhash64("vec_id", "block"), F.col("qblocks")).alias("qblock")),
        "topk-queries",
    )
    every = blocks.select("dim", "bucket", "longest", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))

    # first pass: the longest vectors, counted by rows, give each query a floor; a query left without one is open to all blocks
    ahead = Window.partitionBy("dim").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    longer = stats.select("dim", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    each_block = F.col("n") / F.ceil(F.col("n") / BLOCK_ROWS)
    seeds = every.join(longer, ["dim", "bucket"]).where(F.col("before") + F.col("block") * each_block < SEED_ROWS).drop("before")
    open_q = queries.withColumn("floor", F.lit(float("-inf")))
    seeded = _best(_pass(open_q, placed, _pairs(queries, seeds).drop("longest"), k), k)
    floors = materialise(
        seeded.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") == k).select("query_id", "floor"),
        "topk-floors",
    )

    # second pass: every bucket that can reach the floor
    known = queries.join(floors, queries["vec_id"] == floors["query_id"], "left").select(
        "vec_id", "v", "dim", "norm", "qblock", F.coalesce(F.col("floor").cast("double"), F.lit(float("-inf"))).alias("floor")
    )
    least = known.groupBy("qblock", "dim").agg(F.min(F.when(F.col("norm") > 0, F.col("floor") / F.col("norm")).otherwise(F.lit(float("-inf")))).alias("need"))
    reachable = _pairs(queries, every).join(least, ["qblock", "dim"]).where(F.col("longest") * (1 + 1e-9) >= F.col("need"))
    return _best(_pass(known, placed, reachable.select("qblock", "dim", "bucket", "block"), k), k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )


def _pairs(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every block of queries with every block of candidates of its dimension: the rows are blocks, not vectors."""
    return queries.select("qblock", "dim").distinct().join(blocks, "dim").select("qblock", "dim", "bucket", "block", "longest")
