"""Cut candidates, edit plans and their compilation into ranges.

Times are microseconds. What has a set form is windows and joins; greedy left-to-right rules run per recording or edit on the few rows
that qualify (`applyInPandas`, ordered inside).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normalise
from .folds import choose_apart, fold
from .intervals import complement, merge, overlap_join, range_join, subtract
from .speech import by_word, find_pauses

LEAD_IN_US = 50_000
ISOLATED_US = 150_000
MAX_RESTART = 5
SNAP_US = 350_000
PAD_US = 80_000
SNAP_MERGE_US = 50_000
PIECE_US = 80_000
LEAST_CUT_US = 50_000
FREEZE_US = 750_000
END_TOLERANCE_US = 250_000

_CANDIDATE = "source_id long, kind string, confidence string, start_us long, end_us long"


def _through_gap() -> Column:
    """To just before the next word; the word's own end where there is none."""
    nxt = F.lead("start_us").over(by_word())
    return F.coalesce(F.greatest(F.col("end_us"), nxt - LEAD_IN_US), F.col("end_us"))


def stutters(words: DataFrame, fillers: DataFrame, deliberate: DataFrame) -> DataFrame:
    """A word said twice in a row that isn't a filler; medium where it is often meant. fillers, deliberate: (key)."""
    keyed = words.withColumn("key", normalise(F.col("word")))
    found = keyed.withColumns({"next_key": F.lead("key").over(by_word()), "to_us": _through_gap()}).where("key <> '' and key = next_key")
    sure = deliberate.select(F.col("key").alias("_d")).distinct()
    return (
        found.join(fillers.select("key").distinct(), "key", "left_anti")
        .join(sure, F.col("key") == F.col("_d"), "left")
        .select("source_id", F.lit("stutter").alias("kind"), F.when(F.col("_d").isNotNull(), "medium").otherwise("high").alias("confidence"), "start_us", F.col("to_us").alias("end_us"))
    )


def fillers(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Listed hesitations; high with 150 ms of gap on both sides (or the edge of speech), ambiguous ones only then. lexicon: (key, ambiguous)."""
    gap_before = F.coalesce(F.col("start_us") - F.lag("end_us").over(by_word()), F.lit(ISOLATED_US))
    gap_after = F.coalesce(F.lead("start_us").over(by_word()) - F.col("end_us"), F.lit(ISOLATED_US))
    marked = words.withColumns({"key": normalise(F.col("word")), "to_us": _through_gap(), "alone": (gap_before >= ISOLATED_US) & (gap_after >= ISOLATED_US)})
    return (
        marked.join(lexicon.select("key", "ambiguous"), "key")
        .where("alone or not ambiguous")
        .select("source_id", F.lit("filler").alias("kind"), F.when(F.col("alone"), "high").otherwise("medium").alias("confidence"), "start_us", F.col("to_us").alias("end_us"))
    )


def pause_cuts(words: DataFrame, recordings: DataFrame, max_us: int = 900_000, keep_us: int = 250_000, padding_us: int = 80_000) -> DataFrame:
    """Dead air trimmed up to a padding, long pauses tightened to `keep_us`; cuts under 50 ms are left out."""
    p = find_pauses(words, recordings, max_us)
    short = F.col("end_us") - F.col("start_us") <= keep_us
    start = F.when(F.col("place") == "lead", 0).when(F.col("place") == "tail", F.col("start_us") + padding_us).otherwise(
        F.when(short, F.col("start_us")).otherwise(F.col("start_us") + keep_us // 2)
    )
    end = F.when(F.col("place") == "lead", F.greatest(F.lit(0).cast("long"), F.col("end_us") - padding_us)).when(F.col("place") == "tail", F.col("end_us")).otherwise(
        F.when(short, F.col("start_us")).otherwise(F.col("end_us") - keep_us // 2)
    )
    return p.select("source_id", F.lit("pause").alias("kind"), F.lit("high").alias("confidence"), start.cast("long").alias("start_us"), end.cast("long").alias("end_us")).where(
        F.col("end_us") - F.col("start_us") >= LEAST_CUT_US
    )


def false_starts(words: DataFrame) -> DataFrame:
    """A phrase of 5 to 2 words said twice in a row: the first take, longest first; the scan goes on behind it.

    Which lengths repeat at a word is found by comparing it with the words ahead; the skip runs over those words alone.
    """
    keyed = words.withColumn("key", normalise(F.col("word"))).withColumn("next_start", F.lead("start_us").over(by_word()))
    fits = []
    for n in range(2, MAX_RESTART + 1):
        pairs = [(F.lead("key", j).over(by_word()), F.lead("key", j + n).over(by_word())) for j in range(n)]
        ok = pairs[0][0] == pairs[0][1]
        for a, b in pairs[1:]:
            ok = ok & (a == b)
        for a, _ in pairs:
            ok = ok & (a != "")
        fits.append(F.when(ok, n))
    longest = F.array_max(F.array(*fits))
    ends = [F.when(F.col("n") == n, F.struct(F.lead("end_us", n - 1).over(by_word()).alias("e"), F.lead("start_us", n).over(by_word()).alias("s"))) for n in range(2, MAX_RESTART + 1)]
    found = keyed.withColumn("n", longest).withColumn("last", F.coalesce(*ends)).where("n is not null")

    def skip(rows):
        free = -1
        for r in rows:
            if r.idx >= free:
                free = r.idx + r.n
                yield r.source_id, "false_start", "high" if r.n >= 3 else "medium", r.start_us, max(r.e, r.s - LEAD_IN_US)

    sparse = found.select("source_id", "idx", F.col("n").cast("long").alias("n"), "start_us", "last.e", "last.s")
    return fold(sparse, ["source_id"], ["idx"], skip, _CANDIDATE)


def find_cut_candidates(kinds: list[DataFrame]) -> DataFrame:
    """Candidates of all kinds, the earlier kinds first: one that overlaps a kept one goes. (source_id, cut_id, kind, confidence, start_us, end_us).

    Kinds may overlap inside themselves. Only candidates that overlap others go through the ordered rule.
    """
    every = None
    for n, df in enumerate(kinds):
        part = df.withColumn("priority", F.lit(n))
        every = part if every is None else every.unionByName(part)

    kept = choose_apart(every, ["source_id"], ["priority", "start_us", "end_us", "confidence"]).drop("priority")
    order = Window.partitionBy("source_id").orderBy("start_us", "end_us", "kind")
    return kept.select("source_id", F.format_string("cut-%03d", F.row_number().over(order)).alias("cut_id"), "kind", "confidence", "start_us", "end_us")


def accept_cuts(candidates: DataFrame, chosen: DataFrame, present: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused): chosen (source_id, cut_id) candidates not in the plan yet (present: source_id, cut_id), and those that don't exist."""
    asked = chosen.select("source_id", "cut_id").distinct()
    key = ["source_id", "cut_id"]
    accepted = candidates.join(asked, key, "left_semi").join(present.select(*key).distinct(), key, "left_anti")
    return accepted, asked.join(candidates, key, "left_anti")


def keep_intervals(items: DataFrame, recordings: DataFrame) -> DataFrame:
    """(edit_id, source_id, start_us, end_us): what an edit keeps: its keeps if it has any, else all but its drops (cuts aside), over 50 ms.

    items: (edit_id, source_id, action, start_us, end_us, cut_id).
    """
    keeps = F.col("action").isin("keep", "tighten")
    flags = items.groupBy("edit_id", "source_id").agg(F.max(keeps).alias("any_keep"))
    explicit = items.where(keeps).select("edit_id", "source_id", "start_us", "end_us")
    whole = flags.where("not any_keep").join(recordings.select("source_id", "duration_us"), "source_id").select("edit_id", "source_id", "duration_us")
    drops = items.where((F.col("action") == "drop") & F.col("cut_id").isNull()).select("edit_id", "source_id", "start_us", "end_us")
    return explicit.unionByName(complement(drops, whole, ["edit_id", "source_id"], LEAST_CUT_US))


def snap_ranges(ranges: DataFrame, words: DataFrame, recordings: DataFrame, key: list[str] | None = None) -> DataFrame:
    """ranges with snap_start, snap_end: the nearest word start and end within 0.35 s, else the edge of the word around them, then
    padded by 80 ms as far as the neighbouring words allow. A range that would turn over stays as it is.

    What becomes of an instant depends on the words within 0.35 s of it alone, so each different instant of a recording is looked up once, by time bins, however many
    ranges (told apart by `key`) share it.
    """
    w = words.select("source_id", F.col("idx").alias("w_idx"), F.col("start_us").alias("w_start"), F.col("end_us").alias("w_end"))
    lim = recordings.select("source_id", F.col("duration_us").alias("limit_us"))
    ins = _snapped(ranges.select("source_id", F.col("start_us").alias("at")), w, "w_start", "w_end", -1).toDF("source_id", "start_us", "to_in", "prev_end")
    outs = _snapped(ranges.select("source_id", F.col("end_us").alias("at")), w, "w_end", "w_start", 1).toDF("source_id", "end_us", "to_out", "next_start")
    out = ranges.join(ins, ["source_id", "start_us"]).join(outs, ["source_id", "end_us"]).join(lim, "source_id", "left")
    pad_in = F.least(F.lit(PAD_US), F.greatest(F.lit(0), F.col("to_in") - F.coalesce("prev_end", F.lit(0))))
    pad_out = F.least(F.lit(PAD_US), F.greatest(F.lit(0), F.coalesce("next_start", "limit_us") - F.col("to_out")))
    turned = F.col("to_out") <= F.col("to_in")
    return out.select(
        *[F.col(c) for c in ranges.columns],
        F.when(turned, F.col("start_us")).otherwise(F.greatest(F.lit(0).cast("long"), F.col("to_in") - pad_in)).alias("snap_start"),
        F.when(turned, F.col("end_us")).otherwise(F.least(F.col("to_out") + pad_out, F.coalesce("limit_us", F.col("to_out") + pad_out))).alias("snap_end"),
    )


def _snapped(points: DataFrame, w: DataFrame, edge: str, other: str, side: int) -> DataFrame:
    """(source_id, at, to, neighbour) for each different point (source_id, at): where it goes, and the nearest `other` edge of a word within the padding on its outer side
    (-1: before it, 1: behind it). Words beyond the padding, and the bounds of a recording, don't matter to it."""
    each = points.distinct()
    away = F.abs(F.col(edge) - F.col("at"))
    close, around = away <= SNAP_US, (F.col("w_start") < F.col("at")) & (F.col("at") < F.col("w_end"))
    reach = each.withColumns({"_lo": F.col("at") - SNAP_US - 1, "_hi": F.col("at") + SNAP_US + 1})
    met = range_join(reach, w, ["source_id"], ("_lo", "_hi"), ("w_start", "w_end"), close | around)
    best = met.groupBy("source_id", "at").agg(F.min_by(edge, F.when(close, F.struct(away, "w_idx"))).alias("near"), F.min_by(edge, F.when(around, F.col("w_idx"))).alias("around"))
    to = each.join(best, ["source_id", "at"], "left").select("source_id", "at", F.coalesce("near", "around", "at").alias("to"))
    beyond = (F.col(other) - F.col("to")) * side
    span = to.select("source_id", "to").distinct().withColumns({"_lo": F.col("to") - PAD_US - 1, "_hi": F.col("to") + PAD_US + 1})
    ends = w.select("source_id", other, F.col(other).alias("_e0"), (F.col(other) + 1).alias("_e1"))
    hit = range_join(span, ends, ["source_id"], ("_lo", "_hi"), ("_e0", "_e1"), (beyond >= 0) & (beyond <= PAD_US))
    neighbour = hit.groupBy("source_id", "to").agg(F.min_by(other, beyond).alias("neighbour"))
    return to.join(neighbour, ["source_id", "to"], "left").select("source_id", "at", "to", "neighbour")


def snap_merge(ranges: DataFrame) -> DataFrame:
    """Snapped ranges (edit_id, source_id, snap_start, snap_end) joined where at most 50 ms lie between."""
    spans = ranges.select("edit_id", "source_id", F.col("snap_start").alias("start_us"), F.col("snap_end").alias("end_us"))
    return merge(spans, ["edit_id", "source_id"], SNAP_MERGE_US)


def compile_plan(items: DataFrame, cuts: DataFrame, words: DataFrame, recordings: DataFrame) -> DataFrame:
    """Plan items to ranges: kept intervals, snapped to words and merged, less the accepted cuts (source_id, cut_id, cut_start, cut_end),
    pieces under 80 ms left out. (edit_id, source_id, range_idx, start_us, end_us, cut_ids)."""
    kept = keep_intervals(items, recordings).withColumn("kept_no", F.row_number().over(Window.partitionBy("edit_id").orderBy("source_id", "start_us", "end_us")))
    snapped = snap_ranges(kept, words, recordings, ["edit_id", "kept_no"])
    merged = snap_merge(snapped)
    # edits that keep the same span of a recording share its pieces
    spans = merged.select("source_id", F.col("source_id").alias("of"), "start_us", "end_us", F.col("start_us").alias("low"), F.col("end_us").alias("high")).distinct()
    pieces = subtract(spans, cuts, "source_id", ["of", "low", "high"], PIECE_US)
    mine = merged.select("edit_id", "source_id", F.col("start_us").alias("low"), F.col("end_us").alias("high")).join(pieces, ["source_id", "low", "high"])
    order = Window.partitionBy("edit_id").orderBy("source_id", "start_us")
    return mine.select("edit_id", "source_id", (F.row_number().over(order) - 1).alias("range_idx"), "start_us", "end_us", F.array_join("cut_ids", ",").alias("cut_ids"))


def allocate_frames(ranges: DataFrame, fps: int = 30) -> DataFrame:
    """ranges with frames: rounded running ends, so rounding doesn't add up, at least one frame each. Expects duration_us.

    The sequential rule has the closed form i + max over the earlier ends of (round(end) - i), floored at i.
    """
    order = Window.partitionBy("edit_id").orderBy("range_idx").rowsBetween(Window.unboundedPreceding, 0)
    n = F.row_number().over(Window.partitionBy("edit_id").orderBy("range_idx"))
    end = F.bround(F.sum("duration_us").over(order) * fps / 1_000_000.0).cast("long")
    bounded = ranges.withColumns({"_i": n, "_end": end}).withColumn("_b", F.col("_i") + F.greatest(F.lit(0), F.max(F.col("_end") - F.col("_i")).over(order)))
    before = F.coalesce(F.lag("_b").over(Window.partitionBy("edit_id").orderBy("range_idx")), F.lit(0))
    return bounded.withColumn("frames", F.col("_b") - before).drop("_i", "_end", "_b")


def join_seams(ranges: DataFrame, min_gap_us: int = 300_000) -> DataFrame:
    """ranges with transition_in: neighbours of one take that lie closer than `min_gap_us`, or overlap, meet in the middle: `continuous` where
    they look the same, else `punch`.

    A moved start counts for the next seam's guard. So whether a range meets the one before follows from whether that one did, as one of four rules: yes, no, the same, the opposite.
    Since the last plain yes or no only the opposites count, which windows find without going through the ranges in order.
    """
    order = Window.partitionBy("edit_id").orderBy("range_idx")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    before = {c: F.lag(c).over(order) for c in ("source_id", "start_us", "end_us", "speed_pct", "zoom_pct")}
    seen = ranges.withColumns({"_" + c: v for c, v in before.items()}).withColumn("_mid", F.shiftright(F.col("_end_us") + F.col("start_us"), 1))
    seen = seen.withColumn("_before_mid", F.lag("_mid").over(order))
    near = (
        F.col("source_id").eqNullSafe(F.col("_source_id")) & (F.col("speed_pct") == 100) & (F.col("_speed_pct") == 100)
        & (F.col("start_us") - F.col("_end_us") < min_gap_us) & (F.col("end_us") > F.col("_end_us")) & (F.col("end_us") - F.col("_mid") >= PIECE_US)
    )
    meets = lambda start: F.coalesce(near & (F.col("start_us") > start) & (F.col("_mid") - start >= PIECE_US), F.lit(False))
    ruled = seen.withColumns({"_moved": meets(F.col("_before_mid")), "_plain": meets(F.col("_start_us"))})
    ruled = ruled.withColumn("_turns", F.sum((~F.col("_moved") & F.col("_plain")).cast("long")).over(upto))
    fixed = F.when(F.col("_moved") == F.col("_plain"), F.struct(F.col("_plain").alias("meets"), F.col("_turns").alias("turns")))
    ruled = ruled.withColumn("_fixed", F.last(fixed, ignorenulls=True).over(upto))
    ruled = ruled.withColumn("_meets", F.col("_fixed.meets") != ((F.col("_turns") - F.col("_fixed.turns")) % 2 == 1))
    seam = F.when(F.col("_meets"), F.col("_mid"))
    return ruled.select(
        "edit_id", "range_idx", *[c for c in ranges.columns if c not in ("edit_id", "range_idx", "start_us", "end_us")], F.coalesce(seam, "start_us").alias("start_us"),
        F.coalesce(F.lead(seam).over(order), "end_us").alias("end_us"), F.when(F.col("_meets"), F.when(F.col("zoom_pct").eqNullSafe(F.col("_zoom_pct")), "continuous").otherwise("punch")).alias("transition_in"),
    )


def fit_to_picture(ranges: DataFrame, pictures: DataFrame) -> DataFrame:
    """ranges with picture_end, freeze_us, fit: a range past its picture by 0.75 s of output or less holds the last frame, one further past ends with it. pictures: (source_id, picture_us)."""
    df = ranges.join(pictures, "source_id", "left")
    gap = F.floor((F.col("end_us") - F.col("picture_us")) * 100 / F.col("speed_pct")).cast("long")
    past = (F.col("end_us") > F.col("picture_us") + 1000) & (F.col("picture_us") > F.col("start_us"))
    fit = F.when(past & (gap <= FREEZE_US), "freeze").when(past, "trim").otherwise("as_is")
    return df.withColumn("fit", fit).withColumns(
        {
            "freeze_us": F.when(F.col("fit") == "freeze", gap).otherwise(0).cast("long"),
            "end_us": F.when(F.col("fit") == "trim", F.col("picture_us")).otherwise(F.col("end_us")),
        }
    ).drop("picture_us")


def validate_edits(ranges: DataFrame, recordings: DataFrame) -> DataFrame:
    """(edit_id, range_idx, problem) rows: unknown source, start past its end, end past it by over 0.25 s, output under 50 ms."""
    df = ranges.join(recordings.select("source_id", "duration_us"), "source_id", "left")
    unknown = F.col("duration_us").isNull()
    late = F.col("start_us") >= F.col("duration_us")
    problems = F.array_compact(
        F.array(
            F.when(unknown, "unknown_source"),
            F.when(late, "starts_past_end"),
            F.when(~late & (F.col("end_us") > F.col("duration_us") + END_TOLERANCE_US), "ends_past_end"),
            F.when((F.col("end_us") - F.col("start_us")) * 100 < LEAST_CUT_US * F.col("speed_pct"), "too_short"),
        )
    )
    return df.select("edit_id", "range_idx", F.explode(problems).alias("problem"))


def rank_candidates(clips: DataFrame, scores: list[str], need: str) -> DataFrame:
    """clips with mean_score and rank: the mean of the scores and of the inverted need of context (0 to 100); unscored clips last, ties by clip_id."""
    known = [F.col(c) for c in scores] + [100 - F.col(need)]
    n = sum((c.isNotNull().cast("int") for c in known), F.lit(0))
    total = sum((F.coalesce(c, F.lit(0)) for c in known), F.lit(0))
    mean = F.when(n > 0, F.floor(total * 100 / n)).cast("long")
    ranked = clips.withColumn("mean_score", mean)
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("edit_id").orderBy(F.desc_nulls_last("mean_score"), "clip_id")).cast("long"))
