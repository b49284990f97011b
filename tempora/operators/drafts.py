"""First drafts and variants: plans from timing alone, story captions, enumerated steps, turns, opening lines, and what a brand allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ends_clause, ends_sentence, first_sentence, normalise
from ..sources.shared import written
from .folds import choose_apart, fold
from .speech import synthesize_spacing

RUN = 3
PIECE_US = 50_000
SHORT_US = 3_000_000
SHEET = 12
SEAM_LEFT_US = 40_000
LEAST_LABEL_US = 500_000
#: Stills of a recording: how many, how far apart, how long and how densely the opening is sampled, how far behind a cut and before the end.
STILLS, STILL_GAP_US, OPENING_US, OPENING_STEP_US, AFTER_CUT_US, LAST_US = 40, 150_000, 3_000_000, 500_000, 50_000, 250_000


def spoken_key(c: Column) -> Column:
    """Lower case without the marks . , ! ? ; : at either end."""
    return F.lower(F.regexp_replace(F.trim(c), r"^[.,!?;:]+|[.,!?;:]+$", ""))


def draft_plan(words: DataFrame, recordings: DataFrame, fillers: DataFrame, max_pause_us: int, min_pause_us: int, padding_us: int) -> DataFrame:
    """(source_id, reason, start_us, end_us): what a first pass drops, by timing alone.

    Pauses of `max_pause_us` are tightened to `min_pause_us`; fillers (key) that stand between two pauses go; of three words said twice in a row the first take goes, and the
    search goes on behind the second; silence before the first and after the last word goes up to `padding_us` from speech. Recordings without words give nothing.
    """
    order = Window.partitionBy("source_id").orderBy("idx")
    spaced = synthesize_spacing(words).select("source_id", "start_us", "end_us")
    pauses = spaced.where(F.col("end_us") - F.col("start_us") >= max_pause_us).select(
        "source_id", F.lit("dead air").alias("reason"), (F.col("start_us") + min_pause_us // 2).alias("start_us"), (F.col("end_us") - min_pause_us // 2).alias("end_us")
    )
    keyed = words.withColumns({"key": spoken_key(F.col("word")), "pos": F.row_number().over(order)})
    quiet = spaced.select("source_id", F.col("start_us").alias("s"), F.col("end_us").alias("e"))
    alone = (
        keyed.join(fillers.select("key").distinct(), "key", "left_semi")
        .join(quiet.select("source_id", F.col("e").alias("start_us")).distinct(), ["source_id", "start_us"], "left_semi")
        .join(quiet.select("source_id", F.col("s").alias("end_us")).distinct(), ["source_id", "end_us"], "left_semi")
        .select("source_id", F.lit("filler").alias("reason"), "start_us", "end_us")
    )
    same = F.lit(True)
    for j in range(RUN):
        a = F.lead("key", j).over(order)
        same = same & (a == F.lead("key", j + RUN).over(order)) & (a != "")
    twice = keyed.withColumns({"same": same, "last": F.lead("end_us", RUN - 1).over(order)}).where("same")

    def first_takes(rows):
        free = 0
        for r in rows:
            if r.pos >= free:
                free = r.pos + 2 * RUN
                yield r.source_id, "false start", r.start_us, r.last

    repeats = fold(twice.select("source_id", "pos", "start_us", "last"), ["source_id"], ["pos"], first_takes, "source_id long, reason string, start_us long, end_us long")
    ends = words.groupBy("source_id").agg(F.min_by("start_us", "idx").alias("first"), F.max_by("end_us", "idx").alias("final")).join(recordings, "source_id")
    lead = ends.where(F.col("first") > max_pause_us).select("source_id", F.lit("lead in").alias("reason"), F.lit(0).cast("long").alias("start_us"), F.greatest(F.lit(0).cast("long"), F.col("first") - padding_us).alias("end_us"))
    tail = ends.where(F.col("duration_us") - F.col("final") > max_pause_us).select("source_id", F.lit("tail").alias("reason"), (F.col("final") + padding_us).alias("start_us"), F.col("duration_us").alias("end_us"))
    return pauses.where(F.col("end_us") - F.col("start_us") >= PIECE_US).unionByName(alone).unionByName(repeats).unionByName(lead).unionByName(tail)


def story_cues(line: DataFrame) -> DataFrame:
    """(edit_id, cue_idx, start_us, end_us, text): each range's quote for exactly its time on the output, to the millisecond. line: a timeline with `quote`."""
    ms = lambda c: (F.floor((F.col(c) + 500) / 1000) * 1000).cast("long")
    n = F.row_number().over(Window.partitionBy("edit_id").orderBy("range_idx")) - 1
    return line.select("edit_id", n.cast("long").alias("cue_idx"), ms("output_start").alias("start_us"), ms("output_end").alias("end_us"), F.col("quote").alias("text"))


def export_vtt(cues: DataFrame) -> DataFrame:
    """(edit_id, vtt): the web caption file of each edit, cues by time."""
    from .timeline import srt_time

    time = lambda c: F.replace(srt_time(F.col(c)), F.lit(","), F.lit("."))
    block = F.concat(time("start_us"), F.lit(" --> "), time("end_us"), F.lit("\n"), F.col("text"), F.lit("\n"))
    each = cues.groupBy("edit_id").agg(F.array_sort(F.collect_list(F.struct("start_us", "cue_idx", block.alias("b")))).alias("bs"))
    return each.select("edit_id", F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("bs", lambda x: x["b"]), "\n")).alias("vtt"))


def select_shorts(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """(candidate_id, source_id, start_us, end_us, problem): the selected candidates; null where one can become a short, else what stops it."""
    known = sources.select(F.col("source_id").alias("_s")).distinct()
    df = candidates.where("selected").join(known, F.col("source_id") == F.col("_s"), "left")
    problem = F.when(F.col("_s").isNull(), "unknown source").when(F.col("end_us") - F.col("start_us") < SHORT_US, "fragment")
    return df.select("candidate_id", "source_id", "start_us", "end_us", problem.alias("problem"))


def contrasts(words: DataFrame, recordings: DataFrame, lexicon: DataFrame, punch_max_pct: int) -> DataFrame:
    """(source_id, idx, start_us, end_us, scale_permille): a push-in of 1.3 s and 70 % of the greatest scale on each word that turns the argument, where 0.4 s are left."""
    hit = words.withColumn("key", normalise(F.col("word"))).join(lexicon.select("key").distinct(), "key", "left_semi").join(recordings.select("source_id", "duration_us"), "source_id")
    end = F.least("duration_us", F.col("start_us") + 1_300_000)
    return hit.withColumn("end_us", end).where("end_us - start_us >= 400000").select("source_id", "idx", "start_us", "end_us", F.lit(1000 + (punch_max_pct - 100) * 7).alias("scale_permille"))


def steps(words: DataFrame, recordings: DataFrame, markers: DataFrame) -> DataFrame:
    """(source_id, start_us, end_us, n_items, items): a list where a recording has two markers or more with something after them.

    markers: (first, second); second is null for markers of one word. An item is up to four words behind its marker, to the end of their clause or the next marker; the first five are
    shown from the first marker until 2 s behind the last, 2.5 s at least.
    """
    order = Window.partitionBy("source_id").orderBy("idx")
    end = ends_sentence(F.col("word")) | ends_clause(F.col("word"))
    keyed = words.withColumns(
        {"key": normalise(F.col("word")), "after": F.lead(normalise(F.col("word"))).over(order), "pos": F.row_number().over(order),
         "ahead": F.collect_list(F.struct("word", end.alias("e"))).over(order.rowsBetween(0, 5))}
    )
    m = markers.select("first", "second").distinct()
    met = keyed.join(m, F.col("key") == F.col("first")).where(F.col("second").isNull() | (F.col("second") == F.col("after")))
    by_mark = Window.partitionBy("source_id").orderBy("pos", "size")
    marks = met.withColumn("size", F.when(F.col("second").isNull(), 1).otherwise(2)).withColumn("next", F.lead("pos").over(by_mark))
    room = F.least(F.lit(4), F.coalesce(F.col("next") - F.col("pos") - F.col("size"), F.lit(4)), F.size("ahead") - F.col("size"))
    said = F.slice("ahead", F.col("size") + 1, F.greatest(room, F.lit(0)).cast("int"))
    cut = marks.withColumn("said", said).withColumn("stop", F.array_position(F.transform("said", lambda w: w["e"]), F.lit(True)).cast("int"))
    heard = F.transform(F.when(F.col("stop") > 0, F.slice("said", F.lit(1), F.col("stop"))).otherwise(F.col("said")), lambda w: w["word"])
    item = F.substring(F.regexp_replace(F.array_join(heard, " "), r"^[,.;:!?]+|[,.;:!?]+$", ""), 1, 60)
    per = cut.groupBy("source_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "size", item.alias("item")))).alias("xs"), F.min("start_us").alias("start_us"), F.max_by("end_us", "pos").alias("last"), F.count("*").alias("marks"),
    )
    full = per.withColumn("xs", F.filter(F.transform("xs", lambda x: x["item"]), lambda x: x != "")).where("marks >= 2 and size(xs) >= 2").join(recordings.select("source_id", "duration_us"), "source_id")
    until = F.least("duration_us", F.greatest(F.col("last") + 2_000_000, F.col("start_us") + 2_500_000))
    return full.select("source_id", "start_us", until.alias("end_us"), F.least(F.lit(5), F.size("xs")).cast("long").alias("n_items"), F.array_join(F.slice("xs", 1, 5), " | ").alias("items"))


def sheet_moments(cuts: DataFrame, recordings: DataFrame) -> DataFrame:
    """(source_id, shot, at_us, length_us): the middle of each shot, thinned evenly to twelve. cuts: (source_id, at_us)."""
    edges = recordings.select("source_id", F.lit(0).cast("long").alias("at_us")).unionByName(
        cuts.join(recordings.select("source_id", "duration_us"), "source_id").where("at_us > 0 and at_us < duration_us").select("source_id", "at_us")
    ).join(recordings.select("source_id", "duration_us"), "source_id")
    order = Window.partitionBy("source_id").orderBy("at_us")
    shots = edges.withColumns(
        {"shot": F.row_number().over(order), "until": F.coalesce(F.lead("at_us").over(order), F.col("duration_us")), "n": F.count("*").over(Window.partitionBy("source_id"))}
    )
    picks = F.transform(F.sequence(F.lit(0), F.lit(SHEET - 1)), lambda i: F.bround(i * (F.col("n") - 1) / float(SHEET - 1)).cast("long") + 1)
    kept = shots.where((F.col("n") <= SHEET) | F.array_contains(picks, F.col("shot").cast("long")))
    return kept.select("source_id", F.col("shot").cast("long").alias("shot"), F.floor((F.col("at_us") + F.col("until")) / 2).alias("at_us"), (F.col("until") - F.col("at_us")).alias("length_us"))


def brand_overrides(plans: DataFrame, contracts: DataFrame, fields: tuple[str, ...] = ("accent_color", "text_color", "background_color", "font_family", "style")) -> DataFrame:
    """(edit_id, field, mine, theirs): values of a motion plan that the brand's contract replaces, compared without case. Both tables: edit_id and `fields`."""
    tall = lambda df, name: df.select("edit_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias(name)) for f in fields])).alias("x")).select("edit_id", "x.*")
    return tall(plans, "mine").join(tall(contracts, "theirs"), ["edit_id", "field"]).where(F.lower("mine") != F.lower("theirs"))


def movement_limits(ranges: DataFrame, punch_ins: DataFrame, limits: DataFrame) -> DataFrame:
    """(edit_id, what, at_us, scale_pct): ranges (edit_id, output_start, zoom_pct) and punch-ins (edit_id, start_us, scale_pct) above the limit, and punch-ins where none are allowed.

    limits: (edit_id, most_pct, intensity_pct).
    """
    zooms = ranges.join(limits, "edit_id").where("zoom_pct > most_pct").select("edit_id", F.lit("zoom").alias("what"), F.col("output_start").alias("at_us"), F.col("zoom_pct").cast("long").alias("scale_pct"))
    moved = punch_ins.join(limits, "edit_id")
    over = moved.where("intensity_pct > 0 and scale_pct > most_pct").select("edit_id", F.lit("punch-in").alias("what"), F.col("start_us").alias("at_us"), F.col("scale_pct").cast("long").alias("scale_pct"))
    still = moved.where("intensity_pct <= 0").groupBy("edit_id").agg(F.lit("no movement allowed").alias("what"), F.min("start_us").alias("at_us"), F.max("scale_pct").cast("long").alias("scale_pct"))
    return zooms.unionByName(over).unionByName(still)


def review_moments(elements: DataFrame, punch_ins: DataFrame, transitions: DataFrame) -> DataFrame:
    """(edit_id, at_us, label): where each graphic (edit_id, kind, start_us, end_us), punch-in (edit_id, start_us, end_us, scale_pct) and transition (edit_id, at_us, style) is at its fullest."""
    half = F.floor((F.col("end_us") - F.col("start_us")) / 2)
    return (
        elements.select("edit_id", (F.col("start_us") + F.least(F.lit(600_000), half)).alias("at_us"), F.col("kind").alias("label"))
        .unionByName(punch_ins.select("edit_id", (F.col("start_us") + half).alias("at_us"), F.concat(F.lit("punch-in "), F.col("scale_pct").cast("string")).alias("label")))
        .unionByName(transitions.select("edit_id", "at_us", F.concat(F.col("style"), F.lit(" transition")).alias("label")))
    )


def variant_lines(rows: DataFrame) -> DataFrame:
    """(brief_id, nth, line): two openings at most: the first on-screen text of a brief's first row and the first sentence said in it, unless they differ in case only. rows: (brief_id, row_idx, on_screen array, said)."""
    first = rows.groupBy("brief_id").agg(F.min_by(F.struct("on_screen", "said"), "row_idx").alias("r"))
    lines = F.array(F.trim(F.coalesce(F.try_element_at("r.on_screen", F.lit(1)), F.lit(""))), F.trim(first_sentence(F.coalesce("r.said", F.lit("")))))
    each = first.select("brief_id", F.posexplode(lines).alias("pos", "line")).where("line <> ''")
    # a sharp s is two in capitals
    same = Window.partitionBy("brief_id", F.replace(F.lower("line"), F.lit("ß"), F.lit("ss"))).orderBy("pos")
    once = each.withColumn("k", F.row_number().over(same)).where("k = 1")
    return once.select("brief_id", F.row_number().over(Window.partitionBy("brief_id").orderBy("pos")).cast("long").alias("nth"), "line")


def align_running_seams(ranges: DataFrame, fps: int = 30) -> DataFrame:
    """ranges (with frames) with start_us and end_us moved so that seams a recording runs on across lie on the frame grid.

    A seam moves by a frame at most, only at normal speed before it, and leaves 40 ms of what follows. The next seam is measured from where this one went, so the
    rule runs in order per edit.
    """

    def run(rows):
        before = None
        for r in rows:
            start = r.start_us
            if before and r.source_id == before[0].source_id and r.start_us == before[0].end_us and before[0].speed_pct == 100:
                seam = before[1] + (before[0].frames * 1_000_000 + fps // 2) // fps
                if abs(seam - start) * fps <= 1_000_000 and seam < r.end_us - SEAM_LEFT_US:
                    start = seam
            if before:
                yield r.edit_id, before[0].range_idx, before[1], start if start != r.start_us else before[0].end_us
            before = r, start
        if before:
            yield before[0].edit_id, before[0].range_idx, before[1], before[0].end_us

    moved = fold(ranges.select("edit_id", "range_idx", "source_id", "start_us", "end_us", "speed_pct", "frames"), ["edit_id"], ["range_idx"], run, "edit_id long, range_idx long, start_us long, end_us long")
    return ranges.drop("start_us", "end_us").join(moved, ["edit_id", "range_idx"])


def verbatim_first_caption(cues: DataFrame, words: DataFrame, lines: DataFrame) -> DataFrame:
    """(edit_id, nth, start_us, end_us, text): the first caption of an edit cut down to an opening line that it says word for word; lines that it doesn't say are left out.

    cues: (edit_id, cue_idx, start_us, end_us, text); words: (edit_id, idx, word, out_start, out_end) on the output; lines: (edit_id, nth, line). Words are compared by letters and digits without case. The caption keeps its start
    and ends with the last word that is kept; the whole caption stays as it is. Of several places the first counts.
    """
    first = cues.groupBy("edit_id").agg(F.min_by(F.struct("start_us", "end_us", "text"), "cue_idx").alias("c")).select("edit_id", "c.*")
    inside = words.join(first.select("edit_id", F.col("start_us").alias("c0"), F.col("end_us").alias("c1")), "edit_id").where("out_start >= c0 and out_end <= c1")
    heard = inside.groupBy("edit_id").agg(F.array_sort(F.collect_list(F.struct("out_start", "idx", "out_end", "word"))).alias("ws"))
    token = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]", "")
    tokens = lambda c: F.filter(F.transform(F.split(c, r"\s+"), token), lambda t: t != "")
    df = first.join(lines, "edit_id").join(heard, "edit_id", "left").withColumns({"wanted": tokens(F.col("line")), "said": F.filter("ws", lambda w: token(w["word"]) != "")})
    m = F.size("wanted")
    places = F.when(F.size("said") >= m, F.sequence(F.lit(0), F.size("said") - m))
    at = F.get(F.filter(places, lambda o: F.transform(F.slice("said", o + 1, m), lambda w: token(w["word"])) == F.col("wanted")), F.lit(0))
    whole = tokens(F.col("text")) == F.col("wanted")
    df = df.where(m > 0).withColumns({"whole": whole, "at": at}).where("whole or at is not null")
    # words of no letters between kept ones stay
    lo, hi = F.get("said", F.col("at")), F.get("said", F.col("at") + m - 1)
    kept = F.filter("ws", lambda w: (w["out_start"] >= lo["out_start"]) & (w["out_start"] <= hi["out_start"]))
    return df.select(
        "edit_id", "nth", "start_us", F.when(F.col("whole"), F.col("end_us")).otherwise(hi["out_end"]).alias("end_us"),
        F.when(F.col("whole"), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda w: w["word"]), " ")).alias("text"),
    )


def opening_label(labels: DataFrame, openings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, displaced): labels with each edit's opening line (edit_id, line, end_us) over the beginning, and the text that stood there before.

    labels: (edit_id, start_us, end_us, text, opening). Labels of an earlier opening go. One that is on before the line ends begins then, or goes where under half a second of it would be left. Edits without an opening line keep their labels.
    displaced: (edit_id, before), before empty where nothing stood at the start.
    """
    asked = openings.select("edit_id", "line", F.col("end_us").alias("until"))
    met = labels.join(asked, "edit_id", "left").where("until is null or not opening")
    under = F.col("start_us") < F.col("until")
    stays = met.where(F.col("until").isNull() | ~under | (F.col("end_us") - F.col("until") >= LEAST_LABEL_US))
    moved = stays.select("edit_id", F.when(F.coalesce(under, F.lit(False)), F.col("until")).otherwise(F.col("start_us")).alias("start_us"), "end_us", "text", "opening")
    added = asked.select("edit_id", F.lit(0).cast("long").alias("start_us"), F.col("until").alias("end_us"), F.col("line").alias("text"), F.lit(True).alias("opening"))
    before = met.where("until > 0 and start_us = 0").groupBy("edit_id").agg(F.max("text").alias("before"))
    return moved.unionByName(added), asked.select("edit_id").join(before, "edit_id", "left").select("edit_id", F.coalesce("before", F.lit("")).alias("before"))


def editorial_stills(cuts: DataFrame, recordings: DataFrame, limit: int = STILLS) -> DataFrame:
    """(source_id, at_us, reason): where to look at a recording: its first frame, each half second of its first three, just behind each cut, the middle of each shot, its last frame.

    cuts: (source_id, at_us). No two are closer than 0.15 s; first, opening and last come first, then cuts, then middles, each by time. Where there are more of the latter than `limit` leaves room for, they are
    thinned evenly, the cuts alone if these would do. Spacing is a choice by islands.
    """
    lengths = recordings.select("source_id", "duration_us", F.greatest(F.lit(0).cast("long"), F.col("duration_us") - LAST_US).alias("last"))
    steps = F.filter(F.sequence(F.lit(OPENING_STEP_US), F.lit(OPENING_US), F.lit(OPENING_STEP_US)), lambda t: t <= F.col("last"))
    early = F.concat(F.array(F.lit(0).cast("long")), F.transform(steps, lambda t: t.cast("long")))
    lone = F.forall(early, lambda t: F.col("last") - t >= STILL_GAP_US)
    base = written(lengths.withColumn("fixed", F.when(lone, F.concat(early, F.array("last"))).otherwise(early)).withColumn("lone", lone), "stills")
    reason = lambda t: F.when(t == 0, "first").when(F.col("lone") & (t == F.col("last")), "last").otherwise("opening")
    fixed = base.select("source_id", "last", "lone", F.explode("fixed").alias("at_us")).select("source_id", "at_us", reason(F.col("at_us")).alias("reason"))

    inside = cuts.join(base, "source_id").where("at_us > 0 and at_us < duration_us").select("source_id", "at_us", "duration_us", "last", "fixed")
    behind = inside.select("source_id", "fixed", F.lit("cut").alias("reason"), F.least(F.col("at_us") + AFTER_CUT_US, F.col("last")).alias("at_us"))
    edges = inside.select("source_id", "at_us", "duration_us", "fixed").unionByName(base.select("source_id", F.lit(0).cast("long").alias("at_us"), "duration_us", "fixed"))
    until = F.coalesce(F.lead("at_us").over(Window.partitionBy("source_id").orderBy("at_us")), F.col("duration_us"))
    middles = edges.withColumn("until", until).select("source_id", "fixed", F.lit("middle").alias("reason"), F.floor((F.col("at_us") + F.col("until")) / 2).alias("at_us"))
    far = behind.unionByName(middles).where(F.forall("fixed", lambda t: F.abs(F.col("at_us") - t) >= STILL_GAP_US))
    whole = Window.partitionBy("source_id")
    order = whole.orderBy("reason", "at_us")  # cut comes before middle
    counted = far.withColumns({"room": F.greatest(F.lit(0), F.lit(limit) - F.size("fixed")), "nth": F.row_number().over(order), "n": F.count("*").over(whole), "n_cuts": F.sum((F.col("reason") == "cut").cast("long")).over(whole)})
    pool = F.when(F.col("n_cuts") >= F.col("room"), F.col("n_cuts")).otherwise(F.col("n"))
    place = lambda i: F.bround(i * (pool - 1) / F.greatest(F.col("room") - 1, F.lit(1)).cast("double")).cast("long") + 1
    picks = F.when(F.col("room") > 0, F.transform(F.sequence(F.lit(0), F.col("room") - 1), place)).otherwise(F.array().cast("array<bigint>"))
    thinned = counted.where((F.col("n") <= F.col("room")) | F.array_contains(picks, F.col("nth").cast("long")))
    spans = thinned.select("source_id", "nth", "reason", "at_us", (F.col("at_us") + STILL_GAP_US).alias("end_us"))
    return fixed.unionByName(choose_apart(spans, ["source_id"], ["nth"], "at_us", "end_us").select("source_id", "at_us", "reason"))
