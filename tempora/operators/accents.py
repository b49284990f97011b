"""Accents proposed from what is said, library matches, and budgets over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import word_key
from .folds import choose_apart
from .intervals import nearest

STEM = 5
BEAT_US = 120_000


def hook(sentences: DataFrame) -> DataFrame:
    """(source_id, at_us, title, seconds_us): the first sentence, to its first comma where it is over 90 characters, shown 1.2 to 2.2 s."""
    first = sentences.where("sentence_idx = 0")
    short = F.when(F.length("text") > 90, F.split("text", ",")[0]).otherwise(F.col("text"))
    return first.select("source_id", F.col("start_us").alias("at_us"), short.alias("title"), F.greatest(F.lit(1_200_000), F.least(F.lit(2_200_000), F.col("end_us") - F.col("start_us"))).cast("long").alias("seconds_us"))


def questions(sentences: DataFrame) -> DataFrame:
    """Later sentences that ask, 80 characters at most."""
    return sentences.where("sentence_idx > 0 and length(text) <= 80").where(F.col("text").rlike(r"\?[\"')\]}]*$")).select("source_id", "start_us", "end_us", "text")


def punchlines(sentences: DataFrame) -> DataFrame:
    """Sentences of five words or fewer after a pause of 0.6 s that don't ask."""
    gap = F.col("start_us") - F.lag("end_us").over(Window.partitionBy("source_id").orderBy("sentence_idx"))
    return sentences.withColumn("gap_us", gap).where("gap_us >= 600000 and n_words <= 5 and not text like '%?'").select("source_id", "start_us", "end_us", "gap_us", "text")


def marked_words(words: DataFrame, lexicon: DataFrame, lead_us: int, length_us: int) -> DataFrame:
    """A move at each listed word (contrasts, word punches): from `lead_us` before it, for `length_us`. lexicon: (key)."""
    hit = words.withColumn("key", word_key(F.col("word"))).join(lexicon.select("key").distinct(), "key", "left_semi")
    start = F.greatest(F.lit(0).cast("long"), F.col("start_us") - lead_us)
    return hit.select("source_id", "idx", "key", start.alias("start_us"), (start + length_us).alias("end_us"))


def hook_punch(words: DataFrame) -> DataFrame:
    """The first word of five letters or more that starts between 1.0 and 1.5 s."""
    may = words.where("start_us between 1000000 and 1500000").where(F.length(word_key(F.col("word"))) >= STEM)
    return may.groupBy("source_id").agg(F.min_by(F.struct("idx", "word", "start_us"), "idx").alias("w")).select("source_id", "w.*")


def stem_match(words: DataFrame, tags: DataFrame) -> DataFrame:
    """(source_id, idx, key, tag): the first five letters agree, or the word is a tag of four letters or more and up to three further ones.

    Two equi-joins: on the stem, and on the word's prefixes of the possible lengths.
    """
    w = words.select("source_id", "idx", word_key(F.col("word")).alias("key")).where(F.length("key") >= 4)
    t = tags.select("tag").distinct()
    by_stem = w.where(F.length("key") >= STEM).withColumn("stem", F.substring("key", 1, STEM)).join(t.where(F.length("tag") >= STEM).withColumn("stem", F.substring("tag", 1, STEM)), "stem")
    n = F.length("key")
    prefixes = F.transform(F.sequence(F.greatest(F.lit(4), n - 3), n), lambda k: F.substring(F.col("key"), F.lit(1), k))
    by_prefix = w.withColumn("tag", F.explode(prefixes)).join(t, "tag")
    cols = ["source_id", "idx", "key", "tag"]
    return by_stem.select(*cols).unionByName(by_prefix.select(*cols)).distinct()


def snap_to_beat(points: DataFrame, beats: DataFrame, key: list[str]) -> DataFrame:
    """points with snapped_us: the nearest beat (source_id, beat_us) within 120 ms, else where they are."""
    on = nearest(points, beats, ["source_id"], "at_us", "beat_us", BEAT_US, "beat_us", key).select(*key, F.col("beat_us").alias("_b"))
    return points.join(on, key, "left").withColumn("snapped_us", F.coalesce("_b", "at_us")).drop("_b")


def space_accents(candidates: DataFrame, per_minute: int, gap_us: int) -> DataFrame:
    """The accents an edit keeps: by rank, confidence and time, within the budget of its length and `gap_us` apart.

    candidates: (source_id, rank, sure, at_us, duration_us). Only accents nearer than that to others go through the ordered rule; the budget takes the first of what it leaves.
    """
    spans = candidates.select("source_id", "rank", (~F.col("sure")).cast("int").alias("unsure"), "at_us", (F.col("at_us") + gap_us).alias("end_us"), "duration_us")
    apart = choose_apart(spans, ["source_id"], ["rank", "unsure", "at_us"], "at_us", "end_us")
    budget = F.greatest(F.lit(1), F.bround(F.lit(per_minute) * F.greatest(F.lit(1_000_000).cast("long"), F.col("duration_us")) / 60_000_000.0))
    nth = F.row_number().over(Window.partitionBy("source_id").orderBy("rank", "unsure", "at_us"))
    return apart.withColumn("nth", nth).where(F.col("nth") <= budget).select("source_id", "rank", "at_us")


def icons(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(source_id, idx, entry): the first word of a recording for each dictionary entry (form, entry) that it names."""
    hit = words.withColumn("form", word_key(F.col("word"))).join(dictionary.select("form", "entry").distinct(), "form")
    return hit.groupBy("source_id", "entry").agg(F.min("idx").alias("idx"))


def transitions(ranges: DataFrame) -> DataFrame:
    """(edit_id, range_idx, kind): cuts that change the recording or jump a second or more in it."""
    order = Window.partitionBy("edit_id").orderBy("range_idx")
    prev_source, prev_end = F.lag("source_id").over(order), F.lag("end_us").over(order)
    kind = F.when(prev_source != F.col("source_id"), "source").when(F.abs(F.col("start_us") - prev_end) >= 1_000_000, "jump")
    return ranges.withColumn("kind", kind).where("kind is not null").select("edit_id", "range_idx", "kind")


def sync_sfx(moments: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """A sound per moment (key, role, at_us), the role's files (role, file_no, peak_db10) in turn; quiet files are raised to -14 dB, by 6 dB at most."""
    n = F.count("*").over(Window.partitionBy("role"))
    library = files.withColumns({"slot": F.row_number().over(Window.partitionBy("role").orderBy("file_no")) - 1, "n": n})
    sizes = files.groupBy("role").agg(F.count("*").alias("size"))
    order = Window.partitionBy(key, "role").orderBy("at_us")
    turned = moments.dropDuplicates([key, "role", "at_us"]).join(sizes, "role").withColumn("slot", (F.row_number().over(order) - 1) % F.col("size"))
    gain = F.greatest(F.lit(0), F.least(F.lit(60), F.lit(-140) - F.col("peak_db10")))
    return turned.join(library.select("role", "slot", "file_no", "peak_db10"), ["role", "slot"]).select(key, "role", "at_us", "file_no", gain.cast("long").alias("gain_db10"))
