"""Joins and set operations over time spans (start_us, end_us), keyed by recording or edit.

Long recordings are cut into time bins, so a join's key is (key, bin): work is spread and one long recording doesn't land
in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN_US = 10_000_000


def _binned(df: DataFrame, start: str, end: str, bin_us: int) -> DataFrame:
    lo, hi = F.floor(F.col(start) / bin_us), F.floor(F.greatest(start, end) / bin_us)
    return df.withColumn("_bin", F.explode(F.sequence(lo, hi)))


def range_join(
    a: DataFrame, b: DataFrame, on: list[str], a_span: tuple[str, str], b_span: tuple[str, str], condition: Column, bin_us: int = BIN_US
) -> DataFrame:
    """Pairs of a and b with equal `on` whose closed spans meet and for which `condition` holds, each pair once.

    Both sides go to every bin they touch; a pair is kept in the bin where the later of the two begins. Column names of a and b must differ
    but for `on`.
    """
    left, right = _binned(a, *a_span, bin_us), _binned(b, *b_span, bin_us)
    later = F.floor(F.greatest(F.col(a_span[0]), F.col(b_span[0])) / bin_us)
    return left.join(right, [*on, "_bin"]).where((F.col("_bin") == later) & condition).drop("_bin")


def overlap_join(a: DataFrame, b: DataFrame, on: list[str], a_span: tuple[str, str], b_span: tuple[str, str], bin_us: int = BIN_US) -> DataFrame:
    """Pairs that share more than a point, with the shared span lo_us, hi_us."""
    lo, hi = F.greatest(a_span[0], b_span[0]), F.least(a_span[1], b_span[1])
    return range_join(a, b, on, a_span, b_span, lo < hi, bin_us).withColumns({"lo_us": lo, "hi_us": hi})


def merge(spans: DataFrame, key: list[str], gap_us: int = 0) -> DataFrame:
    """Spans of a key joined where they lie at most `gap_us` apart: (key, start_us, end_us)."""
    order = Window.partitionBy(*key).orderBy("start_us", "end_us")
    before = F.max("end_us").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = before.isNull() | (F.col("start_us") > before + gap_us)
    island = F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        spans.withColumn("_fresh", fresh.cast("int"))
        .withColumn("_island", island)
        .groupBy(*key, "_island")
        .agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
        .drop("_island")
    )


def complement(spans: DataFrame, whole: DataFrame, key: list[str], least_us: int = 0) -> DataFrame:
    """What of each whole (key, duration_us) no span covers, in pieces longer than `least_us`."""
    ends = whole.select(*key, F.col("duration_us").alias("start_us"), F.col("duration_us").alias("end_us"))
    order = Window.partitionBy(*key).orderBy("start_us", "end_us")
    covered = F.coalesce(F.max("end_us").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = spans.join(whole, key).where("start_us < duration_us").select(*key, "start_us", F.least("end_us", "duration_us").alias("end_us"))
    return (
        inside.unionByName(ends)
        .select(*key, covered.alias("_from"), F.col("start_us").alias("_to"))
        .where(F.col("_to") - F.col("_from") > least_us)
        .select(*key, F.col("_from").alias("start_us"), F.col("_to").alias("end_us"))
    )


def subtract(ranges: DataFrame, cuts: DataFrame, on: str, range_key: list[str], least_us: int = 0) -> DataFrame:
    """ranges (range_key, on, start_us, end_us) less cuts (on, cut_id, cut_start, cut_end): pieces with the ids of the cuts before each.

    (range_key, on, piece, start_us, end_us, cut_ids). A piece lists the cuts since the piece before it; pieces under `least_us` are dropped, their
    number is not reused.
    """
    hit = range_join(ranges, cuts, [on], ("start_us", "end_us"), ("cut_start", "cut_end"), (F.col("cut_end") > F.col("start_us")) & (F.col("cut_start") < F.col("end_us")))
    order = Window.partitionBy(*range_key).orderBy("cut_start", "cut_end", "cut_id")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    gaps = (
        hit.withColumn("_from", F.coalesce(F.greatest(F.max("cut_end").over(ahead), F.col("start_us")), F.col("start_us")))
        .withColumn("_opens", (F.col("cut_start") > F.col("_from")).cast("long"))
        .withColumn("_piece", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    # a cut belongs to the piece after it: piece n lists the cuts counted with it, after its own gap
    ids = gaps.groupBy(*range_key, "_piece").agg(F.transform(F.array_sort(F.collect_list(F.struct("cut_start", "cut_end", "cut_id"))), lambda c: c["cut_id"]).alias("cut_ids"))
    inner = gaps.where("_opens = 1").select(*range_key, on, (F.col("_piece") - 1).alias("_piece"), F.col("_from").alias("start_us"), F.col("cut_start").alias("end_us"))
    last = (
        gaps.groupBy(*range_key, on)
        .agg(F.max("_piece").alias("_piece"), F.max("cut_end").alias("start_us"), F.first("end_us").alias("end_us"))
        .where("start_us < end_us")
        .select(*range_key, on, "_piece", "start_us", "end_us")
    )
    whole = ranges.join(hit.select(*range_key).distinct(), range_key, "left_anti").select(*range_key, on, F.lit(0).cast("long").alias("_piece"), "start_us", "end_us")
    return (
        inner.unionByName(last)
        .join(ids, [*range_key, "_piece"], "left")
        .select(*range_key, on, F.col("_piece").alias("piece"), "start_us", "end_us", F.coalesce("cut_ids", F.array().cast("array<string>")).alias("cut_ids"))
        .unionByName(whole.select(*range_key, on, F.col("_piece").alias("piece"), "start_us", "end_us", F.array().cast("array<string>").alias("cut_ids")))
        .where(F.col("end_us") - F.col("start_us") >= least_us)
    )


def nearest(points: DataFrame, targets: DataFrame, on: list[str], point: str, target: str, within_us: int, tie: str, key: list[str]) -> DataFrame:
    """For each row of points (identified by `key`) the target at most `within_us` away, the nearest, ties to the smallest `tie`.

    Points without one are left out. Targets go to their own bin, points to those their reach touches.
    """
    reach = points.withColumn("_bin", F.explode(F.sequence(F.floor((F.col(point) - within_us) / BIN_US), F.floor((F.col(point) + within_us) / BIN_US))))
    placed = targets.withColumn("_bin", F.floor(F.col(target) / BIN_US))
    away = F.abs(F.col(point) - F.col(target))
    met = reach.join(placed, [*on, "_bin"]).where(away <= within_us).withColumn("_away", away)
    order = Window.partitionBy(*key).orderBy("_away", tie)
    return met.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_bin", "_away", "_nth")
