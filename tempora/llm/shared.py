"""Helpers the operators share: the cluster's shared folder, written intermediate tables and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared

#: Words as the contracts define them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table_path(spark: SparkSession, tag: str) -> str:
    """A new path in this application's folder, which goes when the application ends: results may be read until then."""
    return shared.table_path(spark, tag, "llm")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    return shared.written(df, tag, "llm")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(df: DataFrame, key: Column | None = None) -> Column:
    """crc32 of doc_id written as text; the contracts cut folds by its remainder."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for undirected `edges` (src, dst longs): alternating large-star and small-star steps.

    component is the smallest node id that can be reached. Every round is two grouped minima joined
    back to the edges; the edge table is written to the shared folder after each round, so neither the lineage nor the
    driver holds it. Nodes without edges aren't listed. Empty edges give an empty table.
    """
    spark = edges.sparkSession
    cur = materialise(
        edges.select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).where("hi <> lo").distinct(), "cc"
    )
    state = None
    for _ in range(max_rounds):
        # large-star: each node sends its larger neighbours to the smallest node around it
        both = cur.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            cur.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        # small-star: each node sends its smaller neighbours, and itself, to the smallest of them
        floor = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(floor, "hi")
            .select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("e"))
            .select("e.*")
            .where("hi <> lo")
            .distinct()
        )
        cur = materialise(small, "cc")
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(F.col("lo").alias("node")).distinct()
    return cur.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


#: Rows that may be broadcast once counted: ids, hashes and the like, a few dozen bytes each.
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame, tag: str, bound: int = BROADCAST_ROWS) -> DataFrame:
    """df written to the shared folder; marked for broadcast where it was counted to hold at most `bound` rows, left to a shuffle join beyond."""
    kept = materialise(df, tag)
    return F.broadcast(kept) if kept.count() <= bound else kept
