"""Project and batch tables, media inventories, and framing from detected faces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold


def build_manifest(files: DataFrame) -> DataFrame:
    """files (path) with source_id: the stem, or parent_stem where the stem repeats."""
    parts = F.split("path", "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    parent = F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    n = F.count("*").over(Window.partitionBy("stem"))
    return files.withColumns({"stem": stem, "parent": parent}).withColumn("n", n).select("path", F.when(F.col("n") > 1, F.concat_ws("_", "parent", "stem")).otherwise(F.col("stem")).alias("source_id"))


def unique_names(sources: DataFrame, title: str = "name") -> DataFrame:
    """sources (name, title) with slug of the title: lower case, runs of other characters made one dash, -2, -3... on repeats in name order."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    n = F.row_number().over(Window.partitionBy("base").orderBy("name"))
    return sources.withColumn("base", slug).withColumn("n", n).select("name", F.when(F.col("n") > 1, F.concat_ws("-", "base", F.col("n").cast("string"))).otherwise(F.col("base")).alias("slug"))


def merge_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and new (source_id, path, fingerprint): new wins for an id or a path."""
    kept = old.join(new.select("source_id").distinct(), "source_id", "left_anti").join(new.select("path").distinct(), "path", "left_anti")
    return kept.select("source_id", "path", "fingerprint").unionByName(new.select("source_id", "path", "fingerprint"))


def upsert_source(old: DataFrame, new: DataFrame) -> DataFrame:
    """(source_id, status): added, updated, unchanged or kept, by fingerprint."""
    a, b = old.select("source_id", F.col("fingerprint").alias("was")), new.select("source_id", F.col("fingerprint").alias("now"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "kept").when(F.col("was") == F.col("now"), "unchanged").otherwise("updated")
    return a.join(b, "source_id", "full").select("source_id", status.alias("status"))


def fingerprint(size: Column, head: Column, tail: Column) -> Column:
    """Of a file: its size and the hashes of its first and last part."""
    return F.sha2(F.concat_ws(":", size.cast("string"), head, tail), 256)


def cache_key(content: Column, options: Column) -> Column:
    """Of content and a map of options: nulls left out, in key order."""
    known = F.map_filter(options, lambda k, v: v.isNotNull())
    told = F.array_join(F.transform(F.array_sort(F.map_entries(known)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return F.sha2(F.concat_ws("|", content, told), 256)


def work_left(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """wanted without what is done already."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def score_assets(files: DataFrame, name_terms: list[str], text_terms: list[str], top: int = 80) -> DataFrame:
    """(asset_id, score, rank): terms in the path 20 each (60 at most), in the text 8 each (40 at most), 15 for a directory of value; 25 and more, the best `top`."""
    path, text = F.lower("path"), F.lower("text")
    hits = lambda col, terms: sum((F.when(F.instr(col, t) > 0, 1).otherwise(0) for t in terms), F.lit(0))
    score = F.least(F.lit(60), 20 * hits(path, name_terms)) + F.least(F.lit(40), 8 * hits(text, text_terms)) + F.when(path.rlike(r"/(docs|brand|assets|media|content)/"), 15).otherwise(0)
    best = files.withColumn("score", score).where("score >= 25").orderBy(F.desc("score"), "asset_id").limit(top)  # a top-k report
    return best.select("asset_id", F.col("score").cast("long").alias("score"), F.row_number().over(Window.orderBy(F.desc("score"), "asset_id")).cast("long").alias("rank"))


def config_conflicts(claims: DataFrame) -> DataFrame:
    """(key, first_value, other_value): keys a later file sets differently from the first. claims: (key, file_no, value)."""
    first = claims.groupBy("key").agg(F.min_by("value", "file_no").alias("first_value"))
    return claims.join(first, "key").where("value <> first_value").select("key", "first_value", F.col("value").alias("other_value")).distinct()


def stage_status(states: DataFrame, required: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(workspace, stage, n_missing, ready): artifacts (workspace, path) that a state's stage requires (stage, path) and that aren't there."""
    need = states.select("workspace", "stage").join(F.broadcast(required), "stage")  # a fixed table of stages
    missing = need.join(artifacts.select("workspace", "path").distinct(), ["workspace", "path"], "left_anti").groupBy("workspace").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return states.join(missing, "workspace", "left").select("workspace", "stage", n.alias("n_missing"), (n == 0).alias("ready"))


def batch_status(states: DataFrame) -> DataFrame:
    """(batch, recordings, complete, shared_contract, next_workspace) of states (batch, workspace, stage, contract)."""
    open_ = F.when(F.col("stage") != "complete", F.col("workspace"))
    return states.groupBy("batch").agg(
        F.count("*").alias("recordings"), F.count_if(F.col("stage") == "complete").alias("complete"), (F.count_distinct("contract") <= 1).alias("shared_contract"),
        F.min(open_).alias("next_workspace"),
    )


def edits_in_progress(states: DataFrame, top: int = 5) -> DataFrame:
    """The newest `top` unfinished edits of each batch: (batch, workspace, changed, rank)."""
    order = Window.partitionBy("batch").orderBy(F.desc("changed"), "workspace")
    return states.where("stage <> 'complete'").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select("batch", "workspace", "changed", "rank")


def primary_face(faces: DataFrame) -> DataFrame:
    """(source_id, sample_idx, face_idx): the largest face of a sample, then the surer, then the first."""
    order = Window.partitionBy("source_id", "sample_idx").orderBy(F.desc(F.col("w") * F.col("h")), F.desc("confidence"), "face_idx")
    return faces.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("source_id", "sample_idx", "face_idx")


def choose_speaker(tracks: DataFrame, envelope: DataFrame) -> DataFrame:
    """(source_id, track_id, r, margin): the track whose mouth moves with the sound, r of 0.15 and 0.08 clear of the next; track_id null where none is.

    tracks: (source_id, track_id, sample_idx, motion); envelope: (source_id, sample_idx, level). Tracks seen in under four samples correlate with nothing.
    """
    r = tracks.join(envelope, ["source_id", "sample_idx"]).groupBy("source_id", "track_id").agg(F.corr("motion", "level").alias("c"), F.count("motion").alias("n"))
    scored = r.select("source_id", "track_id", F.round(F.when((F.col("n") >= 4) & ~F.isnan("c"), F.col("c")).otherwise(0.0), 9).alias("r"))
    order = Window.partitionBy("source_id").orderBy(F.desc("r"), "track_id")
    best = scored.withColumns({"nth": F.row_number().over(order), "next": F.lead("r").over(order), "n": F.count("*").over(Window.partitionBy("source_id"))}).where("nth = 1")
    sure = (F.col("n") == 1) | ((F.col("r") >= 0.15) & (F.col("r") - F.col("next") >= 0.08))
    return best.select("source_id", F.when(sure, F.col("track_id")).alias("track_id"), "r", F.round(F.col("r") - F.coalesce("next", F.lit(0.0)), 9).alias("margin"))


def crop_size(sources: DataFrame, w: int = 9, h: int = 16) -> DataFrame:
    """sources (source_id, width, height) with the largest even crop of the output's aspect."""
    wide = F.col("width") * h > F.col("height") * w
    cw = F.when(wide, F.floor(F.col("height") * w / h)).otherwise(F.col("width"))
    ch = F.when(wide, F.col("height")).otherwise(F.floor(F.col("width") * h / w))
    return sources.select("source_id", (cw - cw % 2).cast("long").alias("crop_w"), (ch - ch % 2).cast("long").alias("crop_h"))


def hysteresis(scores: DataFrame, factor_pct: int = 125) -> DataFrame:
    """(series, step, chosen): the best candidate of each step, changed only for one over `factor_pct` of the current. scores: (series, step, values array).

    Spark finds the best of each step, and the steps that can change anything: those without candidates, and those where the best is the one of
    the step before, leave the choice as it was or are no threat to it. The rule's state is one number.
    """
    best = F.array_position("values", F.array_max("values")) - 1

    def run(rows):
        held = None
        for r in rows:
            if r.top >= 0 and (held is None or held >= len(r.values) or r.values[r.top] * 100 > r.values[held] * factor_pct):
                held = r.top
            yield r.series, r.step, -1 if held is None else held

    asked = scores.select("series", "step", "values", F.when(F.size("values") > 0, best).otherwise(-1).cast("int").alias("top"))
    return fold(asked, ["series"], ["step"], run, "series long, step long, chosen int")


def crop_path(positions: DataFrame, alpha: float = 0.3, dead_zone: int = 20) -> DataFrame:
    """(series, step, x): positions smoothed forwards and backwards, then held until they leave the dead zone."""

    def run(rows):
        rows = list(rows)  # backwards too: a series must be bounded
        out = [float(r.x) for r in rows]
        for _ in range(2):
            for i in range(1, len(out)):
                out[i] = alpha * out[i] + (1 - alpha) * out[i - 1]
            out.reverse()
        held = out[0]
        for r, x in zip(rows, out, strict=True):
            if abs(x - held) >= dead_zone:
                held = x
            yield r.series, r.step, held

    return fold(positions, ["series"], ["step"], run, "series long, step long, x double")
