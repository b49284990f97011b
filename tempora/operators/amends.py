"""What changes a transcript, an edit or its captions after review: refined passages, requested fixes, corrected words, and whether a cue fits its box."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import word_key
from .folds import fold
from .intervals import BIN_US, range_join

NEAR_US = 1_000_000
EDGE_US = 300_000
FIELDS = ("start_us", "end_us", "zoom_pct", "speed_pct")
# Fixed values of caption boxes: mean advance of a letter in em, the part of the width that may be used, the least size as a part of the asked one and in pixels, padding.
ADVANCE_EM = 0.58
WIDTH_SAFETY = 0.97
SHRINK_FLOOR = 0.72
LEAST_PX = 8
BOX_PADDING_PX = 25
LINE = 1_000_000
OVERLONG = 1_000_000_000_000


def snap_to_word(points: DataFrame, words: DataFrame, prefer: str = "nearest") -> DataFrame:
    """(source_id, at_us, to_us): for each different point the nearest word start, end or either (`prefer`), however far; starts win ties over ends, then the earlier one.

    Points of a recording without words stay. Edges and points meet in time bins; only one row a bin is carried over the recording.
    """
    kinds = {"start": [("start_us", 0)], "end": [("end_us", 1)]}.get(prefer, [("start_us", 0), ("end_us", 1)])
    met = words.join(points.select("source_id").distinct(), "source_id", "left_semi")  # recordings without points need no edges
    each = [met.select("source_id", F.col(c).alias("at_us"), F.lit(rank).alias("rank")) for c, rank in kinds]
    edges = each[0] if len(each) == 1 else each[0].unionByName(each[1])
    edges = edges.groupBy("source_id", "at_us").agg(F.min("rank").alias("rank")).withColumn("edge", F.struct("at_us", "rank"))
    asked = points.select("source_id", "at_us").distinct().withColumn("edge", F.lit(None).cast("struct<at_us:bigint,rank:int>"))
    rows = edges.drop("rank").unionByName(asked).withColumns({"bin": F.floor(F.col("at_us") / BIN_US), "point": F.col("edge").isNull()})
    over_bins = Window.partitionBy("source_id").orderBy("bin")
    bins = rows.groupBy("source_id", "bin").agg(F.min("edge").alias("first"), F.max("edge").alias("last"))
    bins = bins.select(
        "source_id", "bin", F.last("last", ignorenulls=True).over(over_bins.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"),
        F.last("first", ignorenulls=True).over(Window.partitionBy("source_id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)).alias("later"),
    )
    inside = Window.partitionBy("source_id", "bin")
    met = rows.withColumns(
        {"before": F.last("edge", ignorenulls=True).over(inside.orderBy("at_us", "point")), "after": F.last("edge", ignorenulls=True).over(inside.orderBy(F.desc("at_us"), "point"))}
    ).where("point")
    ends = F.array_compact(F.array(F.coalesce("before", "earlier"), F.coalesce("after", "later")))
    best = F.array_min(F.transform(ends, lambda e: F.struct(F.abs(e["at_us"] - F.col("at_us")).alias("away"), e["rank"].alias("rank"), e["at_us"].alias("to"))))
    return met.join(bins, ["source_id", "bin"]).select("source_id", "at_us", F.coalesce(best["to"], F.col("at_us")).alias("to_us"))


def splice_refined(words: DataFrame, passages: DataFrame, spans: DataFrame) -> DataFrame:
    """(source_id, idx, word, start_us, end_us, refined): transcripts with a passage heard again in the place of one span each.

    spans: (source_id, lo_us, hi_us), one a recording; passages: (source_id, pos, word, start_us, end_us), times from lo_us on. Words wholly inside the span go; passage words more than
    half under a word that stays don't come in, nor does one that repeats the word cut by the span's edge beside it. A full stop on the last one goes where speech goes on in lower case.
    """
    of = words.join(spans, "source_id", "left")
    inside = F.coalesce((F.col("start_us") >= F.col("lo_us")) & (F.col("end_us") <= F.col("hi_us")), F.lit(False))
    kept = of.where(~inside)
    lo, hi = F.col("lo_us"), F.col("hi_us")
    heard = passages.join(spans, "source_id").select(
        "source_id", "pos", "word", F.least(F.col("start_us") + lo, hi).alias("start_us"), F.least(F.col("end_us") + lo, hi).alias("end_us"), "lo_us", "hi_us"
    ).where("start_us >= lo_us")
    cut = kept.where((F.col("start_us") < hi) & (F.col("end_us") > lo)).select("source_id", F.col("start_us").alias("k_start"), F.col("end_us").alias("k_end"))
    shared = F.least("end_us", "k_end") - F.greatest("start_us", "k_start")
    under = heard.join(cut, "source_id").where(shared * 2 > F.greatest(F.col("end_us") - F.col("start_us"), F.lit(1000))).select("source_id", "pos").distinct()
    new = heard.join(under, ["source_id", "pos"], "left_anti").withColumn("key", word_key(F.col("word")))
    at = F.struct("start_us", "idx")
    crosses = lambda edge: (F.col("start_us") < edge) & (edge < F.col("end_us"))
    around = kept.where(lo.isNotNull()).withColumn("key", word_key(F.col("word"))).groupBy("source_id").agg(
        F.max_by(F.struct("key", "end_us"), F.when(crosses(lo), at)).alias("left"), F.min_by(F.struct("key", "start_us"), F.when(crosses(hi), at)).alias("right"),
        F.min_by("word", F.when(F.col("start_us") >= hi, at)).alias("next"),
    )
    every = Window.partitionBy("source_id")
    placed = new.join(around, "source_id", "left").withColumns({"first": F.min("pos").over(every) == F.col("pos"), "last": F.max("pos").over(every) == F.col("pos")})
    again = (F.col("first") & (F.col("left.key") == F.col("key")) & (F.col("start_us") - F.col("left.end_us") < EDGE_US)) | (
        F.col("last") & (F.col("right.key") == F.col("key")) & (F.col("right.start_us") - F.col("end_us") < EDGE_US)
    )
    left = placed.where(~F.coalesce(again, F.lit(False))).withColumn("last", F.max("pos").over(every) == F.col("pos"))
    bare = F.regexp_replace("word", "[.!?…]+$", "")
    goes_on = F.col("last") & F.coalesce(F.col("next").rlike(r"^\p{Ll}"), F.lit(False)) & (bare != "")
    came = left.select("source_id", F.col("pos").alias("idx"), F.when(goes_on, bare).otherwise(F.col("word")).alias("word"), "start_us", "end_us", F.lit(True).alias("refined"))
    whole = kept.select("source_id", "idx", "word", "start_us", "end_us", F.lit(False).alias("refined")).unionByName(came)
    n = F.row_number().over(Window.partitionBy("source_id").orderBy("start_us", "end_us", "refined", "idx")) - 1
    return whole.withColumn("idx", n.cast("long"))


def apply_fixes(ranges: DataFrame, fixes: DataFrame) -> DataFrame:
    """ranges with their fixes in, and `status`: unchanged, applied or refused.

    fixes: (edit_id, fix_idx, path, value, approved), path as ranges[2].end_us by place in the edit. Fixes of an approved edit do nothing; the last one of a path holds. An edit takes all of its
    fixes or none: none where a path is unknown or a range would turn over, begin before 0 or stand still.
    """
    asked = fixes.where("not approved").withColumns(
        {"place": F.regexp_extract("path", r"^ranges\[(\d{1,9})\]\.(\w+)$", 1).try_cast("long"), "field": F.regexp_extract("path", r"^ranges\[(\d{1,9})\]\.(\w+)$", 2)}
    )
    place = (F.row_number().over(Window.partitionBy("edit_id").orderBy("range_idx")) - 1).cast("long")
    numbered = ranges.withColumn("place", place)
    named = asked.where(F.col("field").isin(*FIELDS))
    wanted = named.groupBy("edit_id", "place").agg(*[F.max_by("value", F.when(F.col("field") == f, F.col("fix_idx"))).alias(f"_{f}") for f in FIELDS])
    unknown = asked.where(F.col("place").isNull() | ~F.col("field").isin(*FIELDS)).select("edit_id").unionByName(
        wanted.join(numbered.select("edit_id", "place"), ["edit_id", "place"], "left_anti").select("edit_id")
    )
    types = dict(ranges.dtypes)
    new = {f"new_{f}": F.coalesce(F.col(f"_{f}"), F.col(f)).cast(types[f]) for f in FIELDS}
    fixed = numbered.join(wanted, ["edit_id", "place"], "left").withColumns(new)
    wrong = fixed.where("new_start_us < 0 or new_end_us <= new_start_us or new_speed_pct <= 0").select("edit_id")
    state = asked.select("edit_id").distinct().join(unknown.unionByName(wrong).distinct().withColumn("bad", F.lit(True)), "edit_id", "left")
    status = F.when(F.col("bad"), "refused").otherwise("applied")
    out = fixed.join(state.select("edit_id", status.alias("status")), "edit_id", "left").withColumn("status", F.coalesce("status", F.lit("unchanged")))
    take = F.col("status") == "applied"
    return out.select(*[F.when(take, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in FIELDS else F.col(c) for c in ranges.columns], "status")


def fix_words(cues: DataFrame, fixes: DataFrame) -> DataFrame:
    """(edit_id, fix_id, cue_idx, problem, words): each fix tried by itself on the cue on screen at its time.

    cues: (edit_id, cue_idx, start_us, end_us, words array of (text, start_us, end_us)); fixes: (edit_id, fix_id, at_us, old, new). The cue is the first one around the instant, else
    the nearest within a second. The old words are looked for exactly, then by letters and digits; the new ones share their time evenly. Problems: no cue, not said, empty.
    """
    f = fixes.select("edit_id", "fix_id", "at_us", F.col("old"), F.col("new"), (F.col("at_us") - NEAR_US).alias("_lo"), (F.col("at_us") + NEAR_US).alias("_hi"))
    away = F.greatest(F.col("start_us") - F.col("at_us"), F.col("at_us") - F.col("end_us"), F.lit(0))
    near = range_join(f, cues, ["edit_id"], ("_lo", "_hi"), ("start_us", "end_us"), away <= NEAR_US)
    best = near.groupBy("edit_id", "fix_id").agg(F.min_by(F.struct("cue_idx", "words"), F.struct(away, "cue_idx")).alias("cue"))
    parts = lambda c: F.filter(F.split(c, r"\s+"), lambda x: x != "")
    met = fixes.join(best, ["edit_id", "fix_id"], "left").withColumns({"was": parts("old"), "becomes": parts("new")})
    said = F.transform("cue.words", lambda w: w["text"])
    n = F.size("was")

    def places(have: Column, want: Column) -> Column:
        starts = F.when((n > 0) & (F.size(have) >= n), F.sequence(F.lit(1), F.size(have) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.filter(starts, lambda k: F.slice(have, k, n) == want)

    bare = lambda a: F.transform(a, word_key)
    found = met.withColumn("at", F.get(F.concat(places(said, F.col("was")), places(bare(said), bare(F.col("was")))), F.lit(0)))
    w, k = F.col("cue.words"), F.size("becomes")
    a, b = F.element_at(w, F.col("at"))["start_us"], F.element_at(w, F.col("at") + n - 1)["end_us"]
    share = F.transform(
        "becomes",
        lambda t, i: F.struct(t.alias("text"), (a + F.floor((b - a) * i / k)).cast("long").alias("start_us"), (a + F.floor((b - a) * (i + 1) / k)).cast("long").alias("end_us")),
    )
    fixed = F.concat(F.slice(w, F.lit(1), F.col("at") - 1), share, F.slice(w, F.col("at") + n, F.greatest(F.lit(0), F.size(w) - F.col("at") - n + 1)))
    problem = F.when(F.col("cue").isNull(), "no cue").when(F.col("at").isNull(), "not said").when(F.size(w) - n + k == 0, "empty")
    return found.select("edit_id", "fix_id", F.col("cue.cue_idx").alias("cue_idx"), problem.alias("problem"), F.when(problem.isNull(), fixed).alias("words"))


def _said_at(words: list, wanted: list[str]) -> int | None:
    """Where the wanted words stand in a cue's words (text, start, end): as written, else by letters and digits."""
    for told in (str, lambda t: "".join(c for c in t.lower() if c.isalnum())):
        have, want = [told(w[0]) for w in words], [told(t) for t in wanted]
        at = next((k for k in range(len(have) - len(want) + 1) if have[k : k + len(want)] == want), None)
        if want and at is not None:
            return at
    return None


def carry_fixes(cues: DataFrame, fixes: DataFrame) -> DataFrame:
    """Earlier fixes on a rebuilt track, in order of fix_id, each on what the ones before it left.

    Rows of two kinds: word (edit_id, n = cue_idx, pos, text, start_us, end_us) and fix (n = fix_id, text = applied, moved, done or lost). A fix goes to the cue at its old time, else to the one
    cue that says the old words; where some cue says the new ones it is done. Each depends on the ones before: a fold over one edit's track, a row a cue.
    """
    said = F.transform("words", lambda w: F.struct(w["text"].alias("text"), w["start_us"].alias("a"), w["end_us"].alias("b")))
    w = cues.where(F.size("words") > 0).select(
        "edit_id", F.lit(0).alias("kind"), F.col("cue_idx").alias("n"), F.col("start_us").alias("c0"), F.col("end_us").alias("c1"), F.lit("").alias("old"), F.lit("").alias("new"), said.alias("ws")
    )
    f = fixes.select(
        "edit_id", F.lit(1).alias("kind"), F.col("fix_id").alias("n"), F.col("at_us").alias("c0"), F.col("at_us").alias("c1"), F.col("old"), F.col("new"),
        F.lit(None).cast(w.schema["ws"].dataType).alias("ws"),
    )

    def carry(rows):
        track, edit = {}, None  # cue -> its span and words
        for r in rows:
            edit = r.edit_id
            if not r.kind:
                track.setdefault(r.n, (r.c0, r.c1, []))[2].extend((x["text"], x["a"], x["b"]) for x in r.ws)
                continue
            old, new = r.old.split(), r.new.split()
            away = {n: max(c0 - r.c0, r.c0 - c1, 0) for n, (c0, c1, _) in track.items()}
            near = min(away, key=lambda n: (away[n], n), default=None)
            says = [n for n in sorted(track) if _said_at(track[n][2], old) is not None]
            target = near if near in says and away[near] <= NEAR_US else says[0] if len(says) == 1 else None
            if target is not None and len(track[target][2]) > len(old) - len(new):
                words, at = track[target][2], _said_at(track[target][2], old)
                a, b = words[at][1], words[at + len(old) - 1][2]
                words[at : at + len(old)] = [(t, a + (b - a) * k // len(new), a + (b - a) * (k + 1) // len(new)) for k, t in enumerate(new)]
                state = "applied" if target == near and away[near] <= NEAR_US else "moved"
            else:
                state = "done" if any(_said_at(c[2], new) is not None for c in track.values()) else "lost"
            yield edit, "fix", r.n, 0, state, r.c0, r.c0
        for n, (_, _, words) in track.items():
            for k, (t, a, b) in enumerate(words):
                yield edit, "word", n, k, t, a, b

    return fold(w.unionByName(f), ["edit_id"], ["kind", "n"], carry, "edit_id long, kind string, n long, pos long, text string, start_us long, end_us long")


def fit_check(cues: DataFrame, size_px: int, width_px: int, max_lines: int) -> DataFrame:
    """(edit_id, cue_idx, size_px, n_lines): the largest size at which a cue wraps into its lines, from the asked one down to 72 %; null where it overflows.

    Words fill lines greedily and are never broken. Widths are estimated from letters, so a size comes down to a number of letters a line.
    """
    budget, sizes = width_px * WIDTH_SAFETY, range(size_px, max(LEAST_PX, int(size_px * SHRINK_FLOOR)) - 1, -1)
    tried = F.array(*[F.struct(F.lit(s).alias("size"), F.lit(math.floor(budget / (s * ADVANCE_EM) + 1e-9)).cast("long").alias("limit")) for s in sizes])
    letters = F.transform(F.filter(F.split("text", r"\s+"), lambda x: x != ""), lambda x: F.length(x).cast("long"))

    def lines(limit: Column) -> Column:
        # full lines and the letters of the open one in a number
        def put(s, x):
            used = s % LINE
            return F.when(x > limit, s + OVERLONG).when(used == 0, s + x).when(used + 1 + x <= limit, s + 1 + x).otherwise(s - used + LINE + x)

        return F.floor(F.aggregate(F.col("_letters"), F.lit(0).cast("long"), put) / LINE) + 1

    wrapped = F.transform(tried, lambda t: F.struct(t["size"].alias("size"), lines(t["limit"]).alias("n")))
    fits = cues.withColumn("_letters", letters).withColumn("_fit", F.get(F.filter(wrapped, lambda t: t["n"] <= max_lines), F.lit(0)))
    return fits.select("edit_id", "cue_idx", F.when(F.size("_letters") > 0, F.col("_fit.size")).alias("size_px"), F.when(F.size("_letters") > 0, F.col("_fit.n")).alias("n_lines"))


def style_fits(styles: DataFrame) -> DataFrame:
    """styles with needed_px, available_px and fits: whether a cue of the most letters, split evenly, can be drawn at all.

    styles: font_pct10 and margin_pct10 (tenths of a percent), max_chars, max_lines, boxed, width, height.
    """
    per_line = F.ceil(F.col("max_chars") / F.greatest(F.lit(1), F.col("max_lines")))
    needed = per_line * F.greatest(F.lit(LEAST_PX * 1000), F.col("height") * F.col("font_pct10")) * 58
    available = F.col("width") * (1000 - F.col("margin_pct10")) - F.when(F.col("boxed"), 2 * BOX_PADDING_PX * 1000).otherwise(0)
    return styles.withColumns({"needed_px": F.floor(needed / 100_000), "available_px": F.floor(available / 1000), "fits": needed <= available * 97})
