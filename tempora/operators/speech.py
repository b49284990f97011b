"""Speech analysis over words and tokens: spacing, pauses, phrases, speakers, transcript quality, pace.

words: (source_id, idx, word, speaker, start_us, end_us, ...). Windows go over one recording, which is bounded; recordings spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ends_sentence, is_junk, normalise, word_key
from .folds import fold
from .intervals import merge, overlap_join

SPACING_US = 10_000
PHRASE_GAP_US = 500_000
PHRASE_WORDS = 28
SENTENCE_GAP_US = 600_000
LONG_WORD_US = 1_200_000
INNER_SILENCE_US = 300_000
REFINE_US = 500_000
LOOP_PHRASE = 4
LOOP_REPEATS = 4
# Models from small to large.
LADDER = ("tiny", "base", "small", "medium", "large-v3")


def by_word():
    return Window.partitionBy("source_id").orderBy("idx")


def _spaced(words: DataFrame) -> DataFrame:
    """words with the end and the speaker of the one before in time, and whether a gap of 10 ms or more lies between."""
    order = Window.partitionBy("source_id").orderBy("start_us", "end_us")
    after = words.withColumns({"prev_end": F.lag("end_us").over(order), "prev_speaker": F.lag("speaker").over(order)})
    return after.withColumn("spaced", F.coalesce(F.col("start_us") - F.col("prev_end") >= SPACING_US, F.lit(False)))


def synthesize_spacing(words: DataFrame) -> DataFrame:
    """A `spacing` token for each gap of 10 ms or more before a word, owned by the speaker before it."""
    return _spaced(words).where("spaced").select(
        "source_id", F.lit("spacing").alias("kind"), F.lit("").alias("text"), F.col("prev_end").alias("start_us"), F.col("start_us").alias("end_us"), F.col("prev_speaker").alias("speaker")
    )


def build_tokens(words: DataFrame) -> DataFrame:
    """Words and the spacing between them, numbered in time. No word ends before it starts.

    A spacing stands right before its word, so tokens are numbered while words are in order, and are never sorted themselves.
    """
    slim = _spaced(words.select("source_id", "word", "start_us", "end_us", "speaker"))
    order = Window.partitionBy("source_id").orderBy("start_us", "end_us")
    upto = F.row_number().over(order) + F.sum(F.col("spaced").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    token = lambda kind, text, start, end, speaker, n: F.struct(
        F.lit(kind).alias("kind"), text.alias("text"), F.col(start).alias("start_us"), F.col(end).alias("end_us"), F.col(speaker).alias("speaker"), n.cast("long").alias("token_idx")
    )
    said = token("word", F.col("word"), "start_us", "end_us", "speaker", F.col("_upto"))
    gap = token("spacing", F.lit(""), "prev_end", "start_us", "prev_speaker", F.col("_upto") - 1)
    return slim.withColumn("_upto", upto).select("source_id", F.explode(F.when(F.col("spaced"), F.array(gap, said)).otherwise(F.array(said))).alias("t")).select("source_id", "t.*")


def has_word_timestamps(words: DataFrame) -> DataFrame:
    """(source_id, n_words, has_timestamps): whether durations vary by more than 5 % of their mean."""
    d = F.col("end_us") - F.col("start_us")
    pos = F.when(d > 0, d)
    return words.groupBy("source_id").agg(
        F.count("*").alias("n_words"),
        F.coalesce((F.count("*") >= 2) & (F.stddev_pop(pos) / F.avg(pos) > 0.05), F.lit(False)).alias("has_timestamps"),
    )


def find_pauses(words: DataFrame, recordings: DataFrame, minimum_us: int = 500_000) -> DataFrame:
    """(source_id, place, start_us, end_us): gaps between words, and dead air before the first and after the last."""
    inner = synthesize_spacing(words).select("source_id", F.lit("inner").alias("place"), "start_us", "end_us")
    ends = words.groupBy("source_id").agg(F.min_by("start_us", "idx").alias("first"), F.max_by("end_us", "idx").alias("last"))
    lead = ends.select("source_id", F.lit("lead").alias("place"), F.lit(0).cast("long").alias("start_us"), F.col("first").alias("end_us"))
    tail = ends.join(recordings, "source_id").select("source_id", F.lit("tail").alias("place"), F.col("last").alias("start_us"), F.col("duration_us").alias("end_us"))
    return inner.unionByName(lead).unionByName(tail).where(F.col("end_us") - F.col("start_us") >= minimum_us)


def tighten_pause(pauses: DataFrame, keep_us: int) -> DataFrame:
    """The span to remove so that `keep_us` stays, half of it on either side; empty for pauses that short."""
    short = F.col("end_us") - F.col("start_us") <= keep_us
    return pauses.withColumns(
        {
            "cut_start": F.when(short, F.col("start_us")).otherwise(F.col("start_us") + keep_us // 2),
            "cut_end": F.when(short, F.col("start_us")).otherwise(F.col("end_us") - keep_us // 2),
        }
    )


def _islands(words: DataFrame, breaks: Column, name: str) -> DataFrame:
    """Numbers the runs of words between breaks, from 0."""
    flagged = words.withColumn("_break", F.coalesce(breaks, F.lit(False)).cast("long"))
    return flagged.withColumn(name, F.sum("_break").over(by_word().rowsBetween(Window.unboundedPreceding, 0))).drop("_break")


def group_phrases(words: DataFrame, silence_us: int = PHRASE_GAP_US, max_words: int = PHRASE_WORDS) -> DataFrame:
    """(source_id, phrase_idx, speaker, start_us, end_us, n_words, text): a phrase ends at a silence, a change of speaker or `max_words`."""
    gap = F.col("start_us") - F.lag("end_us").over(by_word()) >= silence_us
    other = ~F.col("speaker").eqNullSafe(F.lag("speaker").over(by_word())) & F.lag("idx").over(by_word()).isNotNull()
    runs = _islands(words, gap | other, "_run")
    inside = Window.partitionBy("source_id", "_run").orderBy("idx")
    parts = runs.withColumn("_part", F.floor((F.row_number().over(inside) - 1) / max_words))
    grouped = parts.groupBy("source_id", "_run", "_part").agg(
        F.first("speaker").alias("speaker"), F.min("start_us").alias("start_us"), F.max_by("end_us", "idx").alias("end_us"),
        F.count("*").alias("n_words"), F.array_sort(F.collect_list(F.struct("idx", "word"))).alias("_w"),
    )
    number = Window.partitionBy("source_id").orderBy("_run", "_part")
    return grouped.select(
        "source_id", (F.row_number().over(number) - 1).cast("long").alias("phrase_idx"), "speaker", "start_us", "end_us", "n_words",
        F.array_join(F.transform("_w", lambda w: w["word"]), " ").alias("text"),
    )


def sentence_numbers(words: DataFrame) -> DataFrame:
    """words with sentence_idx: a sentence ends at its mark or a gap of 0.6 s."""
    gap = F.col("start_us") - F.lag("end_us").over(by_word()) >= SENTENCE_GAP_US
    return _islands(words, gap | ends_sentence(F.lag("word").over(by_word())), "sentence_idx")


def sentences(words: DataFrame) -> DataFrame:
    """(source_id, sentence_idx, start_us, end_us, n_words, text)."""
    return sentence_numbers(words).groupBy("source_id", "sentence_idx").agg(
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count("*").alias("n_words"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda w: w["word"]), " ").alias("text"),
    )


def label_speakers(words: DataFrame, turns: DataFrame) -> DataFrame:
    """words with `label`: S1, S2... by first appearance, the diarized speaker who overlaps the word longest (ties: the earliest turn's); null where none does."""
    t = turns.select("source_id", F.col("start_us").alias("t_start"), F.col("end_us").alias("t_end"), F.col("label").alias("who"))
    shared = (
        overlap_join(words, t, ["source_id"], ("start_us", "end_us"), ("t_start", "t_end"))
        .groupBy("source_id", "idx", "who")
        .agg(F.sum(F.col("hi_us") - F.col("lo_us")).alias("us"), F.min("t_start").alias("t_start"), F.min("start_us").alias("start_us"))
    )
    best = Window.partitionBy("source_id", "idx").orderBy(F.desc("us"), "t_start", "who")
    main = shared.withColumn("_nth", F.row_number().over(best)).where("_nth = 1").select("source_id", "idx", "who")
    seen = main.groupBy("source_id", "who").agg(F.min("idx").alias("first"))
    names = seen.withColumn("label", F.concat(F.lit("S"), F.row_number().over(Window.partitionBy("source_id").orderBy("first")))).drop("first")
    return words.join(main.join(names, ["source_id", "who"]).drop("who"), ["source_id", "idx"], "left")


def turns_from_words(words: DataFrame, speaker: str = "speaker") -> DataFrame:
    """(source_id, turn_no, speaker, start_us, end_us): runs of one speaker over labelled words."""
    known = words.where(F.col(speaker).isNotNull())
    runs = _islands(known, F.col(speaker) != F.lag(speaker).over(by_word()), "turn_no")
    return runs.groupBy("source_id", "turn_no").agg(
        F.first(speaker).alias("speaker"), F.min("start_us").alias("start_us"), F.max_by("end_us", "idx").alias("end_us")
    )


def find_loops(words: DataFrame) -> DataFrame:
    """(source_id, idx, start_us, size, repeats): where a phrase of 1 to 4 words is said 4 times or more back to back.

    A loop of s words is an island of words that equal the word s places on: an island that lasts n more words from here repeats the phrase
    n div s + 1 times. Of the places where a loop can begin, with the shortest phrase each, the first is taken, then the first behind its end, and so on; only
    these places, and no words, go through the ordered choice.
    """
    order = by_word()
    keyed = words.withColumns({"key": word_key(F.col("word")), "pos": F.row_number().over(order)})
    for s in range(1, LOOP_PHRASE + 1):
        keyed = keyed.withColumn(f"_same{s}", F.coalesce(F.lead("key", s).over(order) == F.col("key"), F.lit(False)))
    # from the last word back: a frame that only grows, one step a word
    ahead = Window.partitionBy("source_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    may = F.lit(None).cast("struct<size:int,repeats:int>")
    for s in reversed(range(1, LOOP_PHRASE + 1)):
        # the last words of a recording equal nothing behind them, so every island ends
        lasts = F.min(F.when(~F.col(f"_same{s}"), F.col("pos"))).over(ahead) - F.col("pos")
        keyed = keyed.withColumn(f"_lasts{s}", lasts)
        n = (F.floor(F.col(f"_lasts{s}") / s) + 1).cast("int")
        may = F.when(n >= LOOP_REPEATS, F.struct(F.lit(s).alias("size"), n.alias("repeats"))).otherwise(may)
    starts = keyed.withColumn("loop", may).where("loop is not null and key <> ''")
    starts = starts.select("source_id", "idx", "start_us", "pos", "loop.size", "loop.repeats")

    def behind_each_other(rows):
        free = 0
        for r in rows:
            if r.pos >= free:
                free = r.pos + r.size * r.repeats
                yield r.source_id, r.idx, r.start_us, r.size, r.repeats

    return fold(starts, ["source_id"], ["pos"], behind_each_other, "source_id long, idx long, start_us long, size int, repeats int")


def suspect_words(words: DataFrame, quiet: DataFrame) -> DataFrame:
    """(source_id, idx, word, start_us, end_us, silent_us): words over 1.2 s, or holding 0.3 s of quiet (source_id, q_start, q_end)."""
    silent = overlap_join(words, quiet, ["source_id"], ("start_us", "end_us"), ("q_start", "q_end")).groupBy("source_id", "idx").agg(
        F.sum(F.col("hi_us") - F.col("lo_us")).alias("silent_us")
    )
    return (
        words.join(silent, ["source_id", "idx"], "left")
        .withColumn("silent_us", F.coalesce("silent_us", F.lit(0)))
        .where((F.col("end_us") - F.col("start_us") > LONG_WORD_US) | (F.col("silent_us") >= INNER_SILENCE_US))
        .select("source_id", "idx", "word", "start_us", "end_us", "silent_us")
    )


def refine_spans(suspects: DataFrame, recordings: DataFrame) -> DataFrame:
    """Passages half a second around suspect words, inside the recording, joined where they touch."""
    spans = suspects.join(recordings.select("source_id", "duration_us"), "source_id").select(
        "source_id",
        F.greatest(F.lit(0).cast("long"), F.col("start_us") - REFINE_US).alias("start_us"),
        F.least(F.when(F.col("duration_us") > 0, F.col("duration_us")), F.col("end_us") + REFINE_US).alias("end_us"),
    )
    return merge(spans, ["source_id"])


def next_model(model: Column) -> Column:
    """The next larger model; an English-only one keeps its suffix, but for the largest."""
    base, english = F.regexp_replace(model, r"\.en$", ""), model.endswith(".en")
    step = F.when(base == "large-v3-turbo", "large-v3")
    for a, b in zip(LADDER, LADDER[1:], strict=False):
        step = step.when(base == a, F.when(english & F.lit(b != "large-v3"), b + ".en").otherwise(b))
    return step


def assess_transcript(words: DataFrame, recordings: DataFrame, loops: DataFrame, suspects: DataFrame) -> DataFrame:
    """(source_id, n_words, junk, low, n_loops, n_suspects, warnings, suggested_model): warnings is an array of rule names."""
    per = words.groupBy("source_id").agg(
        F.count("*").alias("n_words"), F.count_if(is_junk(F.col("word"))).alias("junk"),
        F.count("confidence_pct").alias("scored"), F.count_if(F.col("confidence_pct") < 40).alias("low"),
    )
    n_loops = loops.groupBy("source_id").agg(F.count("*").alias("n_loops"))
    n_suspects = suspects.groupBy("source_id").agg(F.count("*").alias("n_suspects"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    df = recordings.join(per, "source_id", "left").join(n_loops, "source_id", "left").join(n_suspects, "source_id", "left")
    junk, low = zero(F.col("junk")) * 5 > zero(F.col("n_words")), zero(F.col("low")) * 4 > zero(F.col("scored"))
    loop, english = zero(F.col("n_loops")) > 0, F.col("provider_model").endswith(".en") & (F.col("language") != "en")
    larger = junk | low | loop
    suggested = F.when(english, F.regexp_replace("provider_model", r"\.en$", "")).when(larger, next_model(F.col("provider_model")))
    warnings = F.array_compact(
        F.array(
            F.when(junk, "junk"), F.when(low, "low_confidence"), F.when(loop, "loop"), F.when(english, "english_only"),
            F.when(F.col("language_confidence_pct") < 50, "language_unsure"), F.when(zero(F.col("n_suspects")) > 0, "stretched_words"),
            F.when(larger & suggested.isNull(), "no_larger_model"),
        )
    )
    return df.select(
        "source_id", *[zero(F.col(c)).alias(c) for c in ("n_words", "junk", "low", "n_loops", "n_suspects")],
        F.array_join(warnings, ",").alias("warnings"), suggested.alias("suggested_model"),
    )


def speech_rhythm(words: DataFrame, pauses: DataFrame, recordings: DataFrame) -> DataFrame:
    """Per recording: spoken time, its share of the whole (per mille), pauses and the longest, words a minute of speech, end of the first sentence."""
    spoken = words.groupBy("source_id").agg(
        F.count("*").alias("n_words"), F.sum(F.col("end_us") - F.col("start_us")).alias("spoken_us"),
        F.min(F.when(ends_sentence(F.col("word")), F.col("end_us"))).alias("first_sentence_end_us"),
    )
    still = pauses.groupBy("source_id").agg(F.count("*").alias("n_pauses"), F.max(F.col("end_us") - F.col("start_us")).alias("longest_pause_us"))
    return recordings.join(spoken, "source_id").join(still, "source_id", "left").select(
        "source_id", "n_words", "spoken_us", F.floor(F.col("spoken_us") * 1000 / F.col("duration_us")).alias("sound_permille"),
        F.coalesce("n_pauses", F.lit(0)).alias("n_pauses"), F.coalesce("longest_pause_us", F.lit(0)).alias("longest_pause_us"),
        F.floor(F.col("n_words") * 60_000_000 / F.col("spoken_us")).alias("words_per_minute"), "first_sentence_end_us",
    )


def keywords(words: DataFrame, keys: DataFrame) -> DataFrame:
    """words with `emphasis`: whether the normalised word is in keys (key), exactly."""
    listed = keys.select(normalise(F.col("key")).alias("_key")).distinct()
    return words.join(listed, normalise(F.col("word")) == F.col("_key"), "left").withColumn("emphasis", F.col("_key").isNotNull()).drop("_key")
