"""Openings and whole reels against what viewers stay for: a row per rule, and per thing it is about where there are several."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import leans_forward
from .graphics import longest_still, told

# Kinds that are cards, stills by suffix and codec, times in microseconds, brightness in tenths of a level, and beginnings of words that ask for something.
CARDS = ("hook", "hook_card", "chapter", "logo_reveal", "end_card")
STILL_SUFFIX = r"(?i)\.(png|jpg|jpeg|webp|gif|bmp|tif|tiff)$"
STILL_CODECS = ("png", "mjpeg", "bmp", "gif", "webp", "tiff")
OPENING, END_SLACK = 500_000, 100_000
FIRST_WORD, FIRST_CUE, TITLE_BY, SILENT_FROM = 500_000, 40_000, 1_000_000, 20_000
BLACK, WHITE, WHITE_DETAIL, FLAT, STATIC = 200, 2350, 100, 40, 5
HEARD_BY, DEAD_AIR, SPEECH_EDGE, TAIL, HOLD, END_CARD, ENDING, PHRASE_CUE, COVERAGE = 1_000_000, 700_000, 50_000, 600_000, 5_000_000, 2_000_000, 4_000_000, 2_500_000, 950
SHARE = "zapisz|zachowaj|udostępnij|udostepnij|wyślij|wyslij|podeślij|prześlij|przeslij|oznacz|save|share|send|tag"
FOLLOW = "obserwuj|zaobserwuj|follow|subscribe|subskrybuj"

OUT = ["edit_id", "severity", "rule", "ref", "passed", "measured", "expected"]


def asks(c: Column, words: str) -> Column:
    return F.coalesce(c.rlike(rf"(?i)(^|[^\p{{L}}\p{{N}}_])({words})"), F.lit(False))


def found(df: DataFrame, severity: str, rule: str, ref: Column, measured: Column, expected: Column) -> DataFrame:
    """Rows that break a rule."""
    none = F.lit(False).alias("passed")
    return df.select("edit_id", F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), ref.cast("string").alias("ref"), none, measured.cast("long").alias("measured"), expected.cast("long").alias("expected"))


def end_card_chain(elements: DataFrame, edits: DataFrame) -> DataFrame:
    """Cards (elements of kind end_card) with `at_end`: a card stands at the end if it reaches, to 0.1 s, the end of the edit or the start of the cards behind it that all stand there themselves.

    From the last end backwards, two running windows and no state: the earliest start behind a card, and whether all behind it hold.
    """
    order = Window.partitionBy("edit_id").orderBy(F.desc("end_us"), "element_id")
    behind = F.least("duration_us", F.coalesce(F.min("start_us").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("duration_us")))
    cards = elements.where("kind = 'end_card'").join(edits.select("edit_id", "duration_us"), "edit_id").withColumn("_meets", (F.col("end_us") >= behind - END_SLACK).cast("int"))
    return cards.withColumn("at_end", F.min("_meets").over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("_meets")


def first_frame(pictures: DataFrame) -> DataFrame:
    """pictures (edit_id, mean, detail, change: tenths of a level in frame 0 and to 0.4 s later; null where not decoded) with `note`: black, white, flat, still, undecoded or moving."""
    white = (F.col("mean") > WHITE) & (F.col("detail") < WHITE_DETAIL)
    note = F.when(F.col("mean").isNull(), "undecoded").when(F.col("mean") < BLACK, "black").when(white, "white").when(F.col("detail") < FLAT, "flat").when(F.coalesce("change", F.lit(0)) < STATIC, "still").otherwise("moving")
    return pictures.withColumn("note", note)


def _bag(c: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))


def opening_audit(edits: DataFrame, elements: DataFrame, overlays: DataFrame, ranges: DataFrame, cues: DataFrame, words: DataFrame, pictures: DataFrame, silences: DataFrame) -> DataFrame:
    """(edit_id, severity, rule, ref, passed, measured, expected): the content-first rule by parts, warnings, and whether each edit is ready.

    edits: (edit_id, duration_us, policy, silence_limit_us, brief); elements: (edit_id, element_id, kind, start_us, end_us); overlays: (edit_id, overlay_id, kind, card, file, codec, start_us,
    end_us); ranges: (edit_id, range_idx, file, codec, fill); cues: (edit_id, cue_idx, c_start, text); words: (edit_id, w_start); silences: (edit_id, s_start, s_end). Rules about single
    things have a row only where one is broken; the others one an edit. An edit without a picture, caption or word breaks the rule about it; without a brief it has no row for it. Ready:
    policy isn't content_first, or no issue is open. Edits that aren't in edits have no rows; an empty table of edits gives an empty result.
    """
    e = edits.select("edit_id", "duration_us")
    still = F.col("file").rlike(STILL_SUFFIX) | F.lower("codec").isin(*STILL_CODECS)
    early = overlays.join(e, "edit_id").where(F.col("start_us") < OPENING)
    first = ranges.groupBy("edit_id").agg(F.min_by(F.struct("range_idx", "file", "codec"), "range_idx").alias("_f"), F.max("range_idx").alias("last"))
    begins, limit, zero = F.col("start_us"), F.lit(OPENING), F.lit(0)
    things = [
        found(early.where("kind = 'motion_film'"), "issue", "film at the start", F.col("overlay_id"), begins, limit),
        found(early.where(F.coalesce(F.col("kind") != "motion_film", F.lit(True)) & F.coalesce(still, F.lit(False))), "issue", "still at the start", F.col("overlay_id"), begins, limit),
        found(elements.join(e, "edit_id").where(F.col("kind").isin(*CARDS) & (begins < OPENING)), "issue", "card at the start", F.col("element_id"), begins, limit),
        found(first.select("edit_id", "_f.*").join(e, "edit_id").where(still), "issue", "opens on a still", F.col("range_idx"), zero, zero),
        found(end_card_chain(elements, edits).where(~F.col("at_end")), "issue", "end card before the end", F.col("element_id"), F.col("end_us"), F.col("duration_us")),
        found(overlays.join(e, "edit_id").where("kind = 'motion_film' and card = 'end_card'").where(F.col("end_us") < F.col("duration_us") - END_SLACK), "issue", "end film before the end", F.col("overlay_id"), F.col("end_us"), F.col("duration_us")),
        found(ranges.join(first.select("edit_id", "last"), "edit_id").join(e, "edit_id").where("fill = 'end_card' and range_idx < last"), "issue", "end card fill before the end", F.col("range_idx"), F.col("range_idx"), F.col("last")),
        found(elements.join(e, "edit_id").where((F.col("kind") == "hook_title") & (begins > TITLE_BY)), "warning", "late title", F.col("element_id"), begins, F.lit(TITLE_BY)),
    ]
    cue = cues.groupBy("edit_id").agg(F.min_by(F.struct("c_start", "text"), F.struct("c_start", "cue_idx")).alias("_c")).select("edit_id", "_c.*")
    heard = words.groupBy("edit_id").agg(F.min("w_start").alias("first_word"))
    quiet = silences.groupBy("edit_id").agg(F.min_by(F.struct("s_start", "s_end"), F.struct("s_start", "s_end")).alias("_q")).select("edit_id", F.when(F.col("_q.s_start") <= SILENT_FROM, F.col("_q.s_end")).alias("silence"))
    df = edits.join(first_frame(pictures), "edit_id", "left").join(cue, "edit_id", "left").join(heard, "edit_id", "left").join(quiet, "edit_id", "left")
    silence = F.coalesce("silence", zero)
    alike = (F.size(F.array_except(_bag("brief"), _bag("text"))) == 0) | (F.size(F.array_except(_bag("text"), _bag("brief"))) == 0)
    yes = F.lit(True)
    per = df.select(
        "edit_id",
        F.coalesce("note", F.lit("no picture")).alias("note"),
        F.array_compact(
            F.array(
                told(yes, "first frame", F.coalesce(F.col("note") == "moving", F.lit(False)), F.col("mean"), F.lit(BLACK)),
                told(yes, "first cue", F.coalesce(F.col("c_start") <= FIRST_CUE, F.lit(False)), F.col("c_start"), F.lit(FIRST_CUE)),
                told(yes, "leading silence", silence <= F.col("silence_limit_us"), silence, F.col("silence_limit_us")),
                told((F.coalesce("brief", F.lit("")) != "") & F.col("c_start").isNotNull(), "brief's first line", F.coalesce(alike, F.lit(False)), F.size(F.array_intersect(_bag("brief"), _bag("text"))), F.size(_bag("brief"))),
                told(yes, "first word", F.coalesce(F.col("first_word") <= FIRST_WORD, F.lit(False)), F.col("first_word"), F.lit(FIRST_WORD)),
            )
        ).alias("_v"),
    ).select("edit_id", "note", F.explode("_v").alias("_v"))
    severity = F.when(F.col("_v.rule") == "first word", "warning").otherwise("issue").alias("severity")
    per = per.select("edit_id", severity, "_v.rule", F.when(F.col("_v.rule") == "first frame", F.col("note")).alias("ref"), "_v.passed", "_v.measured", "_v.expected")
    rows = reduce(DataFrame.unionByName, [*things, per])
    open_ = rows.groupBy("edit_id").agg(F.count_if((F.col("severity") == "issue") & ~F.col("passed")).alias("n"))
    content = F.coalesce(F.col("policy") == "content_first", F.lit(False))
    ready = edits.join(open_, "edit_id").select("edit_id", F.lit("verdict").alias("severity"), F.lit("ready").alias("rule"), F.col("policy").alias("ref"), (~content | (F.col("n") == 0)).alias("passed"), F.col("n").alias("measured"), zero.cast("long").alias("expected"))
    return rows.unionByName(ready)


def reel_audit(
    edits: DataFrame, cues: DataFrame, words: DataFrame, silences: DataFrame, changes: DataFrame, elements: DataFrame, publish: DataFrame, platforms: DataFrame, leaning: DataFrame
) -> DataFrame:
    """(edit_id, severity, rule, ref, passed, measured, expected): advice about a whole reel, all of it warnings.

    edits: (edit_id, duration_us, mode, origin) of captions; cues: (edit_id, cue_idx, c_start, c_end, text); words: (edit_id, cue_idx, w_start, w_end); changes: (edit_id, at_us) of cuts that
    show, overlays, punch-ins, transitions and effects (those of elements are added); publish: (edit_id, cta, description); platforms: (platform, best_min_us, best_max_us), a fixed table of
    a few rows; leaning: (key) words that belong to the next. Rules about words have no row where an edit has none, but for the first word and captions, which are then missing. Cues of
    one start are taken by cue_idx. An empty table of edits gives an empty result.
    """
    said = words.groupBy("edit_id").agg(F.min("w_start").alias("first"), F.max("w_end").alias("last"))
    held = words.groupBy("edit_id", "cue_idx").agg((F.max("w_end") - F.min("w_start")).alias("_held"))
    end = edits.select("edit_id", F.greatest(F.lit(0), F.col("duration_us") - ENDING).alias("window"))
    order = Window.partitionBy("edit_id").orderBy("c_start", "cue_idx")
    tail = F.regexp_extract("text", r"(\S+)\s*$", 1)
    c = cues.join(held, ["edit_id", "cue_idx"], "left").withColumns({"nth": F.row_number().over(order), "after": F.lead("cue_idx").over(order), "span": F.coalesce(F.col("_held"), F.col("c_end") - F.col("c_start")), "word": tail}).join(end, "edit_id")
    c = leans_forward(c, leaning)
    long_ = (F.col("nth") > 1) & (F.col("span") > PHRASE_CUE)
    shown = c.groupBy("edit_id").agg(
        F.sum(F.col("c_end") - F.col("c_start")).alias("shown"), F.count_if(long_).alias("n_long"), F.max(F.when(long_, F.col("span"))).alias("longest"),
        F.count_if(F.col("leans") & F.col("after").isNotNull()).alias("n_hanging"), F.max_by("text", "cue_idx").alias("closing"),
        F.max((F.col("c_end") > F.col("window")) & asks(F.col("text"), f"{SHARE}|{FOLLOW}")).alias("spoken"),
    )
    gaps = silences.join(said, "edit_id").where((F.col("s_start") > F.col("first") + SPEECH_EDGE) & (F.col("s_end") < F.col("last") - SPEECH_EDGE)).groupBy("edit_id").agg(F.max(F.col("s_end") - F.col("s_start")).alias("dead"))
    closing = F.col("kind").isin("cta", "end_teaser", "end_card") & (F.col("end_us") > F.col("window"))
    card = F.max(F.when(F.col("kind") == "end_card", F.col("end_us") - F.col("start_us")))
    drawn = elements.join(end, "edit_id").groupBy("edit_id").agg(card.alias("card"), F.max(closing).alias("drawn"))
    copy = publish.groupBy("edit_id").agg(F.max(asks(F.concat_ws(" ", "cta", "description"), SHARE)).alias("copy"))
    still = longest_still(changes.unionByName(elements.select("edit_id", F.explode(F.array("start_us", "end_us")).alias("at_us"))), edits, HOLD).select("edit_id", F.col("measured").alias("hold"))
    df = reduce(lambda a, b: a.join(b, "edit_id", "left"), [said, shown, gaps, drawn, copy, still], edits)

    zero, no, yes = F.lit(0).cast("long"), F.lit(False), F.lit(True)
    spoken, after = F.col("first").isNotNull(), F.greatest(zero, F.col("duration_us") - F.col("last"))
    spoken_us = F.coalesce(F.col("last") - F.col("first"), zero)
    share = F.when(F.col("shown").isNull(), zero).when(spoken_us > 0, F.least(F.lit(1000).cast("long"), F.expr("shown * 1000 div greatest(1, last - first)"))).otherwise(1000)
    card, dead, next_ = F.coalesce("card", zero), F.coalesce("dead", zero), F.coalesce("drawn", no) | F.coalesce("spoken", no)
    phrase = (F.col("mode") == "phrase") & F.col("shown").isNotNull()
    question = F.coalesce(F.col("closing").rlike(r"\?\s*$"), no)
    verdicts = F.array(
        told(yes, "situation heard at once", F.coalesce(F.col("first") <= HEARD_BY, no), F.col("first"), F.lit(HEARD_BY)),
        told(spoken, "no dead air inside the speech", dead <= DEAD_AIR, dead, F.lit(DEAD_AIR)),
        told(spoken, "ends on the payoff", after <= TAIL, after, F.lit(TAIL)),
        told(yes, "the picture changes every few seconds", F.col("hold") <= HOLD, F.col("hold"), F.lit(HOLD)),
        told(yes, "no lingering end card", card <= END_CARD, card, F.lit(END_CARD)),
        told(yes, "the end says what next", next_, next_.cast("int"), F.lit(1)),
        told(yes, "captioned for sound off", share >= COVERAGE, share, F.lit(COVERAGE)),
        told(phrase, "phrase captions change often", F.col("n_long") == 0, F.col("longest"), F.lit(PHRASE_CUE)),
        told(phrase, "captions end on whole phrases", F.col("n_hanging") == 0, F.col("n_hanging"), zero),
        told(F.col("origin") == "story", "the story ends on a question", question, question.cast("int"), F.lit(1)),
        told(F.col("copy").isNotNull(), "asks for a save or a send", F.col("copy"), F.col("copy").cast("int"), F.lit(1)),
    )
    one = df.select("edit_id", F.explode(F.array_compact(verdicts)).alias("_v")).select("edit_id", F.lit("warning").alias("severity"), "_v.rule", F.lit(None).cast("string").alias("ref"), "_v.passed", "_v.measured", "_v.expected")
    d = F.col("duration_us")
    best = edits.join(F.broadcast(platforms)).select("edit_id", F.lit("warning").alias("severity"), F.lit("length suits").alias("rule"), F.col("platform").alias("ref"), d.between(F.col("best_min_us"), F.col("best_max_us")).alias("passed"), d.cast("long").alias("measured"), F.col("best_max_us").cast("long").alias("expected"))
    return one.unionByName(best)
