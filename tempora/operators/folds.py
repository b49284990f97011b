"""Ordered folds: greedy left-to-right rules that have no set form, a bounded recording or edit at a time."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import attrgetter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

CHUNK = 20_000


def fold(df: DataFrame, key: list[str], order: list[str], step: Callable[[Iterator], Iterable[tuple]], schema: str) -> DataFrame:
    """Apply `step` to the ordered rows of each key; it returns tuples of `schema`.

    Rows are dealt by key and sorted in their partition, then streamed: a rule that takes its rows one by one holds no more than its own state, however long
    a group is, and many small groups cost no more than their rows.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        rows = (r for pdf in batches for r in pdf.itertuples(index=False, name="Row"))
        out = []
        for _, group in groupby(rows, key=attrgetter(*key)):
            for told in step(group):
                out.append(told)
                if len(out) >= CHUNK:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(run, schema)


def choose_apart(df: DataFrame, key: list[str], order: list[str], start: str = "start_us", end: str = "end_us") -> DataFrame:
    """The rows of df that stay if, in `order` (which tells a key's rows apart), each goes that overlaps one that stayed: spans (start, end) that share more than a point.

    Spans that overlap, directly or through others, form an island; what stays of an island depends on nothing else. Spans alone on theirs stay at once, only islands of two or more
    go through the ordered rule. An empty span overlaps what it lies inside of. Placed rows are written to the shared folder once, as three readings follow.
    """
    by_time = Window.partitionBy(*key).orderBy(start, end)
    ahead = F.max(end).over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    placed = df.withColumn("_opens", (ahead.isNull() | (F.col(start) >= ahead)).cast("long"))
    island = F.sum("_opens").over(by_time.rowsBetween(Window.unboundedPreceding, 0))
    of_island = Window.partitionBy(*key, "_island")
    placed = placed.withColumn("_island", island).withColumn("_nth", F.row_number().over(of_island.orderBy(*order)).cast("long")).withColumn("_size", F.count("*").over(of_island))
    placed = written(placed.drop("_opens"), "islands")
    alone = placed.where("_size = 1").select(*df.columns)
    crowded = placed.where("_size > 1")

    def keep(rows):
        kept: list[tuple[int, int]] = []
        for r in rows:
            at = bisect_left(kept, (r.lo, r.hi))
            # kept spans are disjoint: only the neighbours can overlap
            if all(r.hi <= a or r.lo >= b for a, b in kept[max(0, at - 1) : at + 2]):
                insort(kept, (r.lo, r.hi))
                yield *(getattr(r, k) for k in names), r.fold_island, r.fold_nth

    names = [f"fold_k{i}" for i in range(len(key))]
    kinds = dict(df.dtypes)
    slim = crowded.select(*[F.col(k).alias(n) for k, n in zip(key, names, strict=True)], F.col("_island").alias("fold_island"), F.col("_nth").alias("fold_nth"), F.col(start).alias("lo"), F.col(end).alias("hi"))
    schema = ", ".join([*[f"{n} {kinds[k]}" for k, n in zip(key, names, strict=True)], "fold_island long", "fold_nth long"])
    kept = fold(slim, [*names, "fold_island"], ["fold_nth"], keep, schema)
    on = [F.col(k) == F.col(n) for k, n in zip(key, names, strict=True)] + [F.col("_island") == F.col("fold_island"), F.col("_nth") == F.col("fold_nth")]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return alone.unionByName(crowded.join(kept, condition, "left_semi").select(*df.columns))
