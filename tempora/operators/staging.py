"""What is shown beside the speech: quoted lines, stages, props, and labels pinned to their scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ends_sentence, normalise
from .accents import stem_match
from .folds import fold
from .intervals import nearest, range_join

EARLIEST_US = 300_000
QUOTE_WORDS = 12
QUOTE_CHARS = 60
STAGE_GAP = 12
STAGES = 5
STAGE_CHARS = 12
STAGE_US = 2_500_000
PROP_US = 2_500_000
PIN_US = 1_500_000
MEET_US = 300_000
LEAST_LABEL_US = 500_000
CLOSE_US = 600_000


def _numbered(words: DataFrame) -> DataFrame:
    order = Window.partitionBy("source_id").orderBy("idx")
    return words.withColumns({"key": normalise(F.col("word")), "pos": F.row_number().over(order)})


def as_line(c: Column) -> Column:
    """Words as a line on screen: no marks at its ends, a capital first letter."""
    bare = F.regexp_replace(c, r"^[,;:.\- –]+|[,;:.\- –]+$", "")
    return F.concat(F.upper(F.substring(bare, 1, 1)), F.substr(bare, F.lit(2)))


def quotes(words: DataFrame, recordings: DataFrame, verbs: DataFrame, that: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source_id, start_us, end_us, text, why): lines for a speech bubble.

    Said: up to 12 words, two at least, to the end of the sentence, behind a verb of speech (key) that ends with a colon or is followed by a word of `that` (key). Quoted: the first place
    where a line of the brief (source_id, quote_id, text) is said word for word. Bubbles last 1.2 to 6 s, texts have 60 letters at most.
    """
    order = Window.partitionBy("source_id").orderBy("idx")
    w = _numbered(words)
    v, t = verbs.select("key").distinct().withColumn("verb", F.lit(True)), that.select("key").distinct().withColumn("that", F.lit(True))
    ahead = F.collect_list(F.struct("word", "start_us", "end_us", ends_sentence(F.col("word")).alias("e"))).over(order.rowsBetween(1, QUOTE_WORDS + 1))
    marked = w.join(v, "key", "left").join(t, "key", "left").withColumns({"ahead": ahead, "leads": F.lead("that").over(order)})
    met = marked.where("verb").where(F.col("leads") | F.trim("word").endswith(":"))
    line = F.slice("ahead", F.when(F.col("leads"), 2).otherwise(1), F.lit(QUOTE_WORDS))
    stop = F.array_position(F.transform("line", lambda x: x["e"]), F.lit(True)).cast("int")
    said = met.withColumn("line", line).withColumn("line", F.when(stop > 0, F.slice("line", F.lit(1), stop)).otherwise(F.col("line"))).where(F.size("line") >= 2)
    said = said.select(
        "source_id", F.col("line")[0]["start_us"].alias("first"), F.element_at("line", -1)["end_us"].alias("last"), F.array_join(F.transform("line", lambda x: x["word"]), " ").alias("text"),
        F.lit("said").alias("why"),
    )
    parts = wanted.select("source_id", "quote_id", F.filter(F.transform(F.split("text", r"\s+"), normalise), lambda x: x != "").alias("ks"))
    each = parts.select("source_id", "quote_id", F.size("ks").alias("n"), F.posexplode("ks").alias("k", "key"))
    places = each.join(w.select("source_id", "key", "pos"), ["source_id", "key"]).groupBy("source_id", "quote_id", "n", (F.col("pos") - F.col("k")).alias("at")).count().where("count = n")
    spans = places.groupBy("source_id", "quote_id", "n").agg(F.min("at").alias("at"))
    inside = spans.select("source_id", "quote_id", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("pos")).join(w, ["source_id", "pos"])
    quoted = inside.groupBy("source_id", "quote_id").agg(
        F.min("start_us").alias("first"), F.max_by("end_us", "pos").alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("text")
    )
    every = said.unionByName(quoted.drop("quote_id").withColumn("why", F.lit("quoted"))).join(recordings.select("source_id", "duration_us"), "source_id")
    start = F.greatest(F.lit(EARLIEST_US), F.col("first")).cast("long")
    end = F.least(F.col("duration_us"), start + 6_000_000, F.greatest(F.col("last") + 800_000, start + 1_500_000))
    shown = every.select("source_id", start.alias("start_us"), end.alias("end_us"), as_line(F.col("text")).alias("text"), "why")
    return shown.where((F.length("text") > 0) & (F.length("text") <= QUOTE_CHARS) & (F.col("end_us") - F.col("start_us") >= 1_200_000))


def sequences(words: DataFrame, recordings: DataFrame, markers: DataFrame, skipped: DataFrame) -> DataFrame:
    """(source_id, start_us, end_us, n_stages, stages, times): a bar of up to five stages where a recording says first, then, last.

    markers: (key, kind) of single words, kind first, then or last. A run begins at a first and goes on while at most 12 words lie between markers; two make a bar. A stage is the next
    word that isn't `skipped` (key), at the time it is said; one of no letters or of more than 12 leaves the run without a bar.
    """
    order = Window.partitionBy("source_id").orderBy("idx")
    s = skipped.select("key").distinct().withColumn("skip", F.lit(True))
    w = _numbered(words).join(s, "key", "left")
    # from the last word back: a frame that only grows, one step a word
    ahead = Window.partitionBy("source_id").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, -1)
    stage = F.last(F.when(F.col("skip").isNull(), F.struct("word", "start_us")), ignorenulls=True).over(ahead)
    marks = w.withColumn("stage", stage).join(markers.groupBy("key").agg(F.min("kind").alias("kind")), "key")
    run = F.sum((F.col("kind") == "first").cast("long")).over(order)
    by_run = Window.partitionBy("source_id", "run").orderBy("pos")
    apart = (F.col("kind") != "first") & (F.col("pos") - F.col("before") - 1 > STAGE_GAP)
    near = marks.withColumns({"run": run, "before": F.lag("pos").over(order)}).where("run > 0").withColumn("broken", F.max(F.coalesce(apart, F.lit(False))).over(by_run)).where("not broken")
    label = F.regexp_replace(F.col("stage.word"), "^[,.;:!?\"'„”()…]+|[,.;:!?\"'„”()…]+$", "")
    told = near.withColumns({"label": label, "nth": F.row_number().over(by_run), "marks": F.count("*").over(Window.partitionBy("source_id", "run"))}).where(f"marks >= 2 and nth <= {STAGES}")
    fits = F.coalesce((F.length("label") > 0) & (F.length("label") <= STAGE_CHARS), F.lit(False))
    per = told.groupBy("source_id", "run").agg(
        F.bool_and(fits).alias("ok"), F.min("start_us").alias("first"), F.count("*").alias("n_stages"), F.array_sort(F.collect_list(F.struct("nth", "label", F.col("stage.start_us").alias("at")))).alias("xs")
    )
    start = F.greatest(F.lit(EARLIEST_US), F.col("first")).cast("long")
    bars = per.where("ok").join(recordings.select("source_id", "duration_us"), "source_id").withColumns({"start_us": start, "times": F.transform("xs", lambda x: x["at"])})
    end = F.least(F.col("duration_us"), F.greatest(F.element_at("times", -1), F.col("start_us")) + STAGE_US)
    return bars.withColumn("end_us", end).where((F.col("end_us") - F.col("start_us") >= STAGE_US) & (F.col("times")[0] >= F.col("start_us"))).select(
        "source_id", "start_us", "end_us", "n_stages", F.array_join(F.transform("xs", lambda x: x["label"]), " | ").alias("stages"), F.array_join(F.transform("times", lambda x: x.cast("string")), ",").alias("times")
    )


def props(words: DataFrame, recordings: DataFrame, library: DataFrame) -> DataFrame:
    """(source_id, prop_id, idx, start_us, end_us, exact): each prop once a recording, for 2.5 s from the first word that names it and isn't taken by a prop before it.

    library: (prop_id, ord, keyword), only props that may be shown. Names are keywords of three letters or more, or words of their stem. A word takes the first free prop by `ord`, so the rule runs
    in order, over the matches alone.
    """
    tags = library.select("prop_id", "ord", normalise(F.col("keyword")).alias("tag")).where(F.length("tag") >= 3).distinct()
    exact = _numbered(words).where(F.length("key") >= 3).select("source_id", "idx", F.col("key").alias("tag"), F.lit(True).alias("exact")).join(tags.select("tag").distinct(), "tag", "left_semi")
    stems = stem_match(words, tags).select("source_id", "idx", "tag", F.lit(False).alias("exact"))
    hits = exact.unionByName(stems).join(tags, "tag").groupBy("source_id", "idx", "prop_id", "ord").agg(F.max("exact").alias("exact"))
    timed = hits.join(words.select("source_id", "idx", "start_us"), ["source_id", "idx"]).join(recordings.select("source_id", "duration_us"), "source_id")
    shown = timed.where((F.col("start_us") >= EARLIEST_US) & (F.col("start_us") + PROP_US <= F.col("duration_us")))

    def first_free(rows):
        used, word = set(), None
        for r in rows:
            if r.idx != word and r.prop_id not in used:
                word = r.idx
                used.add(r.prop_id)
                yield r.source_id, r.prop_id, r.idx, r.start_us, r.start_us + PROP_US, r.exact

    matches = shown.select("source_id", "idx", "ord", "prop_id", "start_us", "exact")
    return fold(matches, ["source_id"], ["idx", "ord", "prop_id"], first_free, "source_id long, prop_id long, idx long, start_us long, end_us long, exact boolean")


def pin_labels(labels: DataFrame, line: DataFrame) -> DataFrame:
    """(edit_id, label_idx, text, start_us, end_us, n_joined, problem): labels moved onto the scenes of the edit they stand in.

    labels: (edit_id, label_idx, text, start_us, end_us); line: a timeline with beat. A label that is the beat of ranges spans these; the edges of others go to the nearest cut within 1.5 s. One that
    would last under half a second keeps its own time. Neighbours of one text less than 0.3 s apart are one; others that meet or nearly do end where the next begins, unless both begin within half
    a second of each other, which is a problem.
    """
    key = lambda c: F.lower(F.trim(F.col(c)))
    total = line.groupBy("edit_id").agg(F.max("output_end").alias("total"))
    scenes = line.groupBy("edit_id", key("beat").alias("key")).agg(F.min("output_start").alias("s0"), F.max("output_end").alias("s1"))
    cuts = line.select("edit_id", F.col("output_start").alias("cut_us")).unionByName(total.select("edit_id", F.col("total").alias("cut_us"))).distinct()
    given = labels.join(total, "edit_id").withColumns({"key": key("text"), "own_end": F.least("end_us", "total")}).join(scenes, ["edit_id", "key"], "left")
    loose = given.where("s0 is null").select("edit_id", "label_idx", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("start_us").alias("at")), F.struct(F.lit("b").alias("side"), F.col("own_end").alias("at")))).alias("x"))
    loose = loose.select("edit_id", "label_idx", "x.side", "x.at")
    near = nearest(loose, cuts, ["edit_id"], "at", "cut_us", PIN_US, "cut_us", ["edit_id", "label_idx", "side"])
    moved = near.groupBy("edit_id", "label_idx").agg(F.max(F.when(F.col("side") == "a", F.col("cut_us"))).alias("c0"), F.max(F.when(F.col("side") == "b", F.col("cut_us"))).alias("c1"))
    both = given.join(moved, ["edit_id", "label_idx"], "left").withColumns({"p0": F.coalesce("s0", "c0", "start_us"), "p1": F.least(F.coalesce("s1", "c1", "own_end"), F.col("total"))})
    short = F.col("p1") - F.col("p0") < LEAST_LABEL_US
    pinned = both.withColumns({"p0": F.when(short, F.col("start_us")).otherwise(F.col("p0")), "p1": F.when(short, F.col("own_end")).otherwise(F.col("p1"))})
    order = Window.partitionBy("edit_id").orderBy("p0", "p1", "label_idx")
    runs = pinned.withColumn("turn", (~F.col("key").eqNullSafe(F.lag("key").over(order))).cast("long")).withColumn("turn", F.sum("turn").over(order))
    inside = Window.partitionBy("edit_id", "turn").orderBy("p0", "p1", "label_idx")
    until = F.max("p1").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("p0") - until >= MEET_US, F.lit(True)).cast("long")
    islands = runs.withColumn("opens", opens).withColumn("island", F.sum("opens").over(inside))
    one = islands.groupBy("edit_id", "turn", "island").agg(
        F.min_by(F.struct("label_idx", "text"), F.struct("p0", "p1", "label_idx")).alias("l"), F.min("p0").alias("p0"), F.max("p1").alias("p1"), (F.count("*") - 1).alias("n_joined")
    )
    nxt = F.lead("p0").over(Window.partitionBy("edit_id").orderBy("turn", "island"))
    meets = (F.abs(nxt - F.col("p1")) < MEET_US) | (F.col("p1") > nxt)
    crowded = meets & (nxt - F.col("p0") < LEAST_LABEL_US)
    return one.select(
        "edit_id", "l.label_idx", "l.text", F.col("p0").alias("start_us"), F.when(meets & ~crowded, nxt).otherwise(F.col("p1")).alias("end_us"), "n_joined",
        F.when(crowded, "shares its scene with the next").alias("problem"),
    )


def first_shot(ranges: DataFrame, shots: DataFrame) -> DataFrame:
    """ranges with the shot (edit_id, source_id, start_us, end_us, snapped to words before) in the place of each edit's first one; other columns stay. Edits without a shot are left out."""
    new = shots.select("edit_id", F.col("source_id").alias("_source"), F.col("start_us").alias("_start"), F.col("end_us").alias("_end"))
    first = F.row_number().over(Window.partitionBy("edit_id").orderBy("range_idx")) == 1
    put = {c: F.when(F.col("_first"), F.col(n)).otherwise(F.col(c)) for c, n in (("source_id", "_source"), ("start_us", "_start"), ("end_us", "_end"))}
    return ranges.withColumn("_first", first).join(new, "edit_id").select(*[put[c].alias(c) if c in put else F.col(c) for c in ranges.columns])


def first_shot_warnings(ranges: DataFrame, shots: DataFrame, words: DataFrame) -> DataFrame:
    """(edit_id, warning, range_idx): what to check about a new first shot.

    It starts or ends inside a sentence that runs on within 0.6 s, its source has no words, it comes from another source than the shot it takes the place of, or it repeats footage of a later range
    (its range_idx). Each different span is held against the words once.
    """
    spans = shots.select("source_id", F.col("start_us").alias("s"), F.col("end_us").alias("e")).distinct()
    w = words.select("source_id", "idx", F.col("start_us").alias("w0"), F.col("end_us").alias("w1"), ends_sentence(F.col("word")).alias("full"))
    reach = spans.withColumns({"_lo": F.col("s") - CLOSE_US, "_hi": F.col("e") + CLOSE_US})
    met = range_join(reach, w, ["source_id"], ("_lo", "_hi"), ("w0", "w1"), (F.col("w1") > F.col("_lo")) & (F.col("w0") < F.col("_hi")))
    told = met.groupBy("source_id", "s", "e").agg(
        F.max_by("full", F.when(F.col("w1") <= F.col("s"), F.col("idx"))).alias("before"), F.max_by("full", F.when((F.col("w0") >= F.col("s")) & (F.col("w1") <= F.col("e")), F.col("idx"))).alias("last"),
        F.coalesce(F.bool_or(F.col("w0") >= F.col("e")), F.lit(False)).alias("goes_on"),
    )
    spoken = words.select("source_id", F.lit(True).alias("spoken")).distinct()
    old = ranges.groupBy("edit_id").agg(F.min_by("source_id", "range_idx").alias("old_source"), F.min("range_idx").alias("first"))
    of = shots.select("edit_id", "source_id", F.col("start_us").alias("s"), F.col("end_us").alias("e")).join(told, ["source_id", "s", "e"], "left").join(spoken, "source_id", "left").join(old, "edit_id")
    found = F.array_compact(
        F.array(
            F.when(~F.col("before"), "starts mid-sentence"), F.when(~F.col("last") & F.col("goes_on"), "ends mid-sentence"), F.when(F.col("spoken").isNull(), "no transcript"),
            F.when(F.col("source_id") != F.col("old_source"), "other source"),
        )
    )
    own = of.select("edit_id", F.explode(found).alias("warning"), F.lit(None).cast("long").alias("range_idx"))
    again = of.select("edit_id", "source_id", "s", "e", "first").join(ranges.select("edit_id", "source_id", "range_idx", "start_us", "end_us"), ["edit_id", "source_id"])
    again = again.where((F.col("range_idx") > F.col("first")) & (F.col("start_us") < F.col("e")) & (F.col("s") < F.col("end_us")))
    return own.unionByName(again.select("edit_id", F.lit("repeats footage").alias("warning"), "range_idx"))
