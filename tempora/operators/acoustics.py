"""Edges of speech in measured levels: where a range should open and close, and whether it cuts a word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import range_join

# Frame length, the shortest run of voice in frames, reach of the search, context for the noise floor, breath, and the time after the last word that is heard.
FRAME_US = 10_000
MIN_RUN = 3
SEARCH_US = 400_000
LONG_WORD_US = 1_000_000
CONTEXT_US = 1_500_000
LEAST_BREATH_US = 80_000
MOST_BREATH_US = 120_000
TAIL_US = 300_000
LEAST_US = 80_000


def _frame(c: Column) -> Column:
    return F.floor((c + FRAME_US // 2) / FRAME_US)


#: Frames are kept in bins of so many times the widest window, an array of stretches each; a bin also holds what windows that begin in it reach behind its end.
BIN_WINDOWS = 10


def _let(value: Column, f) -> Column:
    """f of a value that is found once: a plain column would be worked out anew for each element of an array that f goes over."""
    return F.transform(F.array(value), f)[0]


def _cut(first: Column, levels: Column, lo: Column, hi: Column) -> Column:
    """What of a stretch (number of its first frame, levels) lies in frames lo to hi, hi left out, as a stretch; they share a frame at least."""
    start, end = F.greatest(first, lo), F.least(first + F.size(levels), hi)
    return F.struct(start.cast("long").alias("first"), F.slice(levels, (start - first + 1).cast("int"), (end - start).cast("int")).alias("levels"))


def _bins(frames: DataFrame, reach: int) -> DataFrame:
    """(source_id, bin, stretches): the frames that windows of up to `reach` frames which begin in a bin may hold.

    Frames come as stretches (source_id, frame_no of the first, levels), or a row each (source_id, frame_no, level_db10).
    """
    size = BIN_WINDOWS * reach
    levels = F.col("levels") if "levels" in frames.columns else F.array("level_db10")
    runs = frames.select("source_id", F.col("frame_no").alias("first"), levels.alias("levels")).where("size(levels) > 0")
    bins = F.sequence(F.floor((F.col("first") - reach) / size), F.floor((F.col("first") + F.size("levels") - 1) / size))
    each = runs.select("source_id", "first", "levels", F.explode(bins).alias("bin"))
    # a stretch that begins past the reach of the bin before its own is in it by rounding only
    lo, hi = F.col("bin") * size, (F.col("bin") + 1) * size + reach
    each = each.where((F.col("first") < hi) & (F.col("first") + F.size("levels") > lo))
    return each.select("source_id", "bin", _cut(F.col("first"), F.col("levels"), lo, hi).alias("s")).groupBy("source_id", "bin").agg(F.collect_list("s").alias("stretches"))


def _share(c: Column, share: float) -> Column:
    """The given share of a sorted array, between two of its values in proportion."""
    at = (F.size(c) - 1) * F.lit(share)
    low, high = F.get(c, F.floor(at).cast("int")).cast("double"), F.get(c, F.ceil(at).cast("int")).cast("double")
    return low * (1 - (at - F.floor(at))) + high * (at - F.floor(at))


def voice_runs(windows: DataFrame, frames: DataFrame, key: list[str], widest_us: int | None = None) -> DataFrame:
    """(key, runs): the runs of frames with voice in each window (key, source_id, w_lo, w_hi), in time, as an array of (first, last).

    frames: (source_id, frame_no, level_db10), 10 ms each, or stretches of them (source_id, frame_no of the first, levels). The threshold is measured inside the window: a fifth of the way from the floor
    (10th percentile) to the peaks (95th), 8 dB above the floor at least; where both lie within 10 dB there is no voice. Runs have three frames at least. A window holds some hundred frames, whatever the
    recording's length, and is looked at in one row: it meets the one bin of frames that it begins in, which holds all of it. widest_us: what no window is longer than; without it, they are looked through.
    """
    spans = windows.select(*key, "source_id", _frame(F.col("w_lo")).alias("lo_frame"), F.floor(F.col("w_hi") / FRAME_US).alias("hi_frame")).where("lo_frame < hi_frame")
    reach = spans.agg(F.max(F.col("hi_frame") - F.col("lo_frame"))).first()[0] or 1 if widest_us is None else widest_us // FRAME_US + 1
    # windows are the small side: bins aren't sorted
    met = _bins(frames, reach).join(spans.withColumn("bin", F.floor(F.col("lo_frame") / (BIN_WINDOWS * reach))).hint("shuffle_hash"), ["source_id", "bin"])
    shares = lambda s: (s["first"] < F.col("hi_frame")) & (s["first"] + F.size(s["levels"]) > F.col("lo_frame"))
    inside = F.transform(F.filter("stretches", shares), lambda s: _cut(s["first"], s["levels"], F.col("lo_frame"), F.col("hi_frame")))
    each = F.flatten(F.transform(inside, lambda s: F.transform(s["levels"], lambda x, i: F.struct((s["first"] + i).alias("frame_no"), x.alias("level_db10")))))
    held = met.select(*key, F.array_sort(each).alias("levels"))
    level = lambda x: x["level_db10"]
    edges = lambda v: F.struct(_share(v, 0.1).alias("low"), (_share(v, 0.95) - _share(v, 0.1)).alias("span"))
    over = lambda t, x: (t["e"]["span"] >= 100) & (level(x) - t["e"]["low"] > F.greatest(F.lit(80.0), t["e"]["span"] / 5))
    with_edges = lambda v: F.struct(v.alias("v"), _let(F.array_sort(F.transform(v, level)), edges).alias("e"))
    loud = _let(_let(F.col("levels"), with_edges), lambda t: F.transform(F.filter(t["v"], lambda x: over(t, x)), lambda x: x["frame_no"]))
    return held.select(*key, _let(loud, _runs).alias("runs"))


def _runs(loud: Column) -> Column:
    """Sorted frame numbers as runs (first, last) of MIN_RUN or more."""
    firsts = F.filter(loud, lambda x, i: ~F.coalesce(F.get(loud, i - 1) == x - 1, F.lit(False)))
    lasts = F.filter(loud, lambda x, i: ~F.coalesce(F.get(loud, i + 1) == x + 1, F.lit(False)))
    return F.filter(F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("first"), b.alias("last"))), lambda r: r["last"] - r["first"] + 1 >= MIN_RUN)


def voiced(windows: DataFrame, frames: DataFrame, key: list[str]) -> DataFrame:
    """(key, frame_no, run_end): frames with voice in each window as in `voice_runs`, a row each, and where their run ends."""
    each = voice_runs(windows, frames, key).select(*key, F.explode("runs").alias("r"))
    return each.select(*key, F.explode(F.sequence("r.first", "r.last")).alias("frame_no"), (F.col("r.last") + 1).alias("run_end"))


def check_tail(edits: DataFrame, frames: DataFrame, recordings: DataFrame) -> DataFrame:
    """(edit_id, tail_us): speech right behind each edit's last word (edit_id, source_id, end_us), up to 0.3 s; above 0 a word is cut."""
    w = edits.join(recordings.select("source_id", "duration_us"), "source_id")
    w = w.withColumns({"w_lo": F.greatest(F.lit(0).cast("long"), F.col("end_us") - CONTEXT_US), "w_hi": F.least(F.col("duration_us"), F.col("end_us") + CONTEXT_US), "at": _frame(F.col("end_us"))})
    heard = voice_runs(w.where(F.col("end_us") < F.col("duration_us") - FRAME_US).select("edit_id", "source_id", "w_lo", "w_hi", "at"), frames, ["edit_id", "at"], 2 * CONTEXT_US)
    around = F.filter("runs", lambda r: (r["first"] <= F.col("at")) & (F.col("at") <= r["last"]))
    last = F.get(around, F.lit(0))["last"]
    heard = heard.select("edit_id", "at", last.alias("last"))
    tail = F.when(F.col("last").isNotNull(), F.least(F.col("last") + 1 - F.col("at"), F.lit(TAIL_US // FRAME_US)) * FRAME_US)
    return edits.select("edit_id").join(heard.select("edit_id", tail.alias("tail_us")), "edit_id", "left").select("edit_id", F.coalesce("tail_us", F.lit(0)).cast("long").alias("tail_us"))


def acoustic_edges(ranges: DataFrame, words: DataFrame, frames: DataFrame, recordings: DataFrame, padding_us: int) -> DataFrame:
    """(edit_id, range_idx, start_us, end_us): ranges moved to where the voice of their first and last word begins and ends, with a breath of 80 to 120 ms.

    The search goes 0.4 s to both sides of the word's edge (1 s into a long first word) and never past the neighbouring word. Without voice there, or with voice already at the start of the search, an
    edge stays; so does a range that would last under 80 ms. Words of a recording don't overlap.
    """
    breath = min(MOST_BREATH_US, max(LEAST_BREATH_US, padding_us))
    order = Window.partitionBy("source_id").orderBy("idx")
    w = words.select(
        "source_id", "idx", F.col("start_us").alias("w0"), F.col("end_us").alias("w1"), F.coalesce(F.lag("end_us").over(order), F.lit(0)).alias("prev_end"), F.lead("start_us").over(order).alias("next_start")
    )
    key = ["edit_id", "range_idx"]
    met = range_join(ranges.select(*key, "source_id", "start_us", "end_us"), w, ["source_id"], ("start_us", "end_us"), ("w0", "w1"), (F.col("w1") > F.col("start_us")) & (F.col("w0") < F.col("end_us")))
    word = F.struct("w0", "w1", "prev_end", "next_start")
    ends = met.groupBy(*key, "source_id").agg(F.min_by(word, "idx").alias("a"), F.max_by(word, "idx").alias("b")).join(recordings.select("source_id", "duration_us"), "source_id")
    ceiling = F.coalesce("b.next_start", "duration_us")
    a_hi = F.greatest(F.col("a.w0") + SEARCH_US, F.least(F.col("a.w1"), F.col("a.w0") + LONG_WORD_US))
    sides = F.array(
        F.struct(F.lit("in").alias("side"), F.greatest(F.col("a.prev_end"), F.col("a.w0") - SEARCH_US).alias("lo"), a_hi.alias("hi")),
        F.struct(F.lit("out").alias("side"), F.greatest(F.col("b.w0"), F.col("b.w1") - SEARCH_US).alias("lo"), F.least(ceiling, F.col("b.w1") + SEARCH_US, F.col("duration_us")).alias("hi")),
    )
    spans = ends.select(*key, "source_id", "duration_us", F.col("b.next_start").alias("next_start"), F.explode(sides).alias("s")).select(*key, "source_id", "duration_us", "next_start", "s.*")
    spans = spans.where((F.col("side") == "in") | (F.col("hi") - F.col("lo") >= FRAME_US * MIN_RUN))
    windows = spans.select(*key, "side", "source_id", F.greatest(F.lit(0).cast("long"), F.col("lo") - CONTEXT_US).alias("w_lo"), (F.col("hi") + CONTEXT_US).alias("w_hi"))
    heard = spans.withColumns({"lo_frame": _frame(F.col("lo")), "hi_frame": _frame(F.col("hi"))}).join(voice_runs(windows, frames, [*key, "side"], 2 * CONTEXT_US + SEARCH_US + LONG_WORD_US), [*key, "side"])
    inside = heard.withColumn("runs", F.filter("runs", lambda r: (r["last"] >= F.col("lo_frame")) & (r["first"] < F.col("hi_frame")))).where("size(runs) > 0 and lo_frame < hi_frame")
    onset, offset = F.greatest(F.col("runs")[0]["first"], "lo_frame"), F.least(F.element_at("runs", -1)["last"] + 1, "hi_frame")
    found = inside.withColumns({"onset": onset * FRAME_US, "offset": offset * FRAME_US})
    new_in = F.when(F.floor(F.col("onset") / FRAME_US) > _frame(F.col("lo")), F.greatest(F.lit(0).cast("long"), F.col("onset") - F.least(F.lit(breath), F.col("onset") - F.col("lo"))))
    room = F.when(F.col("next_start").isNotNull(), F.greatest(F.lit(0).cast("long"), F.col("hi") - F.col("offset"))).otherwise(breath)
    new_out = F.least(F.col("offset") + F.least(F.lit(breath).cast("long"), room), "duration_us", F.coalesce("next_start", "duration_us"))
    moved = found.groupBy(*key).agg(F.max(F.when(F.col("side") == "in", new_in)).alias("i"), F.max(F.when(F.col("side") == "out", new_out)).alias("o"))
    start, end = F.coalesce("i", "start_us"), F.coalesce("o", "end_us")
    stays = end - start < LEAST_US
    return ranges.join(moved, key, "left").select(*key, F.when(stays, F.col("start_us")).otherwise(start).cast("long").alias("start_us"), F.when(stays, F.col("end_us")).otherwise(end).cast("long").alias("end_us"))
