"""Phrases of any number of words in a recording, and habits that are replaced as they are said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import word_key
from ..sources.shared import written
from .folds import fold
from .intervals import range_join

#: Words that a habit has at most, words in which its replacement must begin, and words that are said instead at most.
HABIT, SEARCHED, INSTEAD = 8, 6, 8
LINE_CHARS = 40
EARLIEST_US = 300_000
LEAD_US, HOLD_US, LEAST_US = 200_000, 1_200_000, 1_500_000

CLAUSE_END = r"[,.!?;:…]\s*$"
SENTENCE_END = r"[.!?…]\s*$"


def match_phrases(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """(source_id, idx, kind, size): where a phrase (phrase, kind) of whole words begins, the longest one of its kind at each word.

    Words are compared by their letters and digits in lower case, parts of a phrase without any are left out. One equi-join for each number of words that phrases have.
    """
    parts = F.filter(F.transform(F.split(F.trim("phrase"), r"\s+"), word_key), lambda p: p != "")
    known = phrases.select("kind", F.array_join(parts, " ").alias("grams"), F.size(parts).alias("size")).where("size > 0").distinct()
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())  # a handful of lengths
    order = Window.partitionBy("source_id").orderBy("idx")
    keyed = words.select("source_id", "idx", word_key(F.col("word")).alias("key"))
    found = None
    for n in sizes:
        grams = F.concat_ws(" ", F.col("key"), *[F.lead("key", k).over(order) for k in range(1, n)])
        # words of no letters are words here: a phrase isn't found across them
        whole = F.lead("key", n - 1).over(order).isNotNull() if n > 1 else F.lit(True)
        here = keyed.select("source_id", "idx", F.when(whole, grams).alias("grams")).join(known.where(F.col("size") == n), "grams").select("source_id", "idx", "kind", "size")
        found = here if found is None else found.unionByName(here)
    if found is None:
        return keyed.select("source_id", "idx", F.lit("").alias("kind"), F.lit(0).alias("size")).where("false")
    return found.groupBy("source_id", "idx", "kind").agg(F.max("size").alias("size"))


def _line(words: Column) -> Column:
    """Words as a line on screen: no marks at its ends, a capital first."""
    text = F.regexp_replace(F.array_join(words, " "), "^[,;:.– -]+|[,;:.– -]+$", "")
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def replacements(words: DataFrame, sentences: DataFrame, recordings: DataFrame, phrases: DataFrame) -> DataFrame:
    """(source_id, idx, start_us, end_us, text, replacement, strike_us, replace_us): habits that are struck out on the word that replaces them.

    phrases: (phrase, kind), kind `from` (opens a habit: "instead of"), `with` (opens what to say: "rather say"), `alone` (a word that does so for the sentence before). words have idx without gaps. A habit begins
    behind `from` and runs to the end of its clause or to a `with`, 8 words at most; a `with` must follow within 6 words. After `alone`, or a `with` that ends in a colon, the habit is the last whole sentence
    before. What is said instead begins behind all `with` in a row and goes to the end of the sentence, 8 words at most. Lines of no letters or more than 40 go. A recording is read on behind what was found.

    Each opening word's result follows from the words close to it, by joins; only openings go through the ordered reading.
    """
    marks = match_phrases(words, phrases).groupBy("source_id", "idx").pivot("kind", ["from", "with", "alone"]).agg(F.max("size"))
    size = lambda c: F.coalesce(c, F.lit(0))
    marked = words.select("source_id", "idx", "word", "start_us", "end_us").join(marks, ["source_id", "idx"], "left").withColumns({"f": size("from"), "w": size("with"), "a": size("alone")})
    marked = written(marked.select("source_id", "idx", "word", "start_us", "end_us", "f", "w", "a"), "marked-words")
    opens = (F.col("f") > 0) | (F.col("a") > 0) | (F.col("w") > 0) & F.col("word").rlike(r":\s*$")
    openings = marked.where(opens).select("source_id", F.col("idx").alias("at"), F.col("f").alias("of"), F.col("start_us").alias("at_us"))

    # the words from an opening on, as far as its result can reach
    longest = phrases.agg(F.max(F.size(F.split("phrase", r"\s+")))).first()[0] or 0
    reach = longest + HABIT + SEARCHED + 8 * longest + INSTEAD
    near = openings.withColumn("idx", F.explode(F.sequence(F.col("at"), F.col("at") + reach))).join(
        marked.select("source_id", "idx", "word", "start_us", "end_us", "w"), ["source_id", "idx"]
    )
    word = F.struct("idx", "word", "w", "start_us", "end_us", F.col("word").rlike(CLAUSE_END).alias("clause"), F.col("word").rlike(SENTENCE_END).alias("stop"))
    read = near.groupBy("source_id", "at", "of", "at_us").agg(F.array_sort(F.collect_list(word)).alias("ws"))

    # the last sentence that ended before an opening
    whole = sentences.select("source_id", "sentence_idx", F.col("start_us").alias("s0"), F.col("end_us").alias("s1"))
    bounds = openings.where("of = 0").select("source_id", "at", F.col("at_us").alias("s1"), F.lit(None).cast("struct<s0:bigint,s1:bigint>").alias("s")).unionByName(
        whole.select("source_id", F.lit(None).cast("long").alias("at"), "s1", F.struct("s0", "s1").alias("s"))
    )
    order = Window.partitionBy("source_id").orderBy("s1", F.col("s").isNull())
    last = bounds.withColumn("s", F.last("s", ignorenulls=True).over(order)).where("at is not null and s is not null").select("source_id", "at", "s.s0", "s.s1")
    inside = range_join(last, words.select("source_id", F.col("idx").alias("w_idx"), "word", F.col("start_us").alias("w0"), F.col("end_us").alias("w1")), ["source_id"], ("s0", "s1"), ("w0", "w1"), (F.col("w0") >= F.col("s0")) & (F.col("w1") <= F.col("s1")))
    before = inside.groupBy("source_id", "at").agg(F.transform(F.array_sort(F.collect_list(F.struct("w_idx", "word"))), lambda x: x["word"]).alias("earlier"), F.min("w0").alias("earlier_us"))

    n = F.size("ws")
    offsets = lambda lo, hi: F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda i: F.get("ws", i)
    behind = F.col("of") > 0
    df = read.join(before, ["source_id", "at"], "left").join(recordings.select("source_id", "duration_us"), "source_id")
    end = F.aggregate(
        offsets(F.col("of"), F.least(n, F.col("of") + HABIT)), F.struct(F.col("of").alias("to"), F.lit(False).alias("done")),
        lambda s, i: F.when(s["done"], s).when(at(i)["w"] > 0, F.struct(s["to"].alias("to"), F.lit(True).alias("done"))).otherwise(F.struct((i + 1).alias("to"), at(i)["clause"].alias("done"))),
    )["to"]
    df = df.withColumn("to", F.when(behind, end))
    say = F.get(F.filter(offsets(F.col("to"), F.least(n, F.col("to") + SEARCHED)), lambda i: at(i)["w"] > 0), F.lit(0))
    df = df.withColumns(
        {"say": F.when(behind, say).otherwise(F.lit(0)), "habit": F.when(behind, F.transform(F.slice("ws", F.col("of") + 1, F.col("to") - F.col("of")), lambda x: x["word"])).otherwise(F.coalesce("earlier", F.array().cast("array<string>")))}
    )
    df = df.withColumn("said", F.aggregate("ws", F.col("say"), lambda s, _: s + F.coalesce(at(s)["w"], F.lit(0))))
    upto = F.aggregate(offsets(F.col("said"), F.least(n, F.col("said") + INSTEAD)), F.struct(F.col("said").alias("to"), F.lit(False).alias("done")), lambda s, i: F.when(s["done"], s).otherwise(F.struct((i + 1).alias("to"), at(i)["stop"].alias("done"))))["to"]
    df = df.withColumn("upto", upto).withColumn("instead", F.slice("ws", F.col("said") + 1, F.greatest(F.lit(0), F.col("upto") - F.col("said"))))
    begun = F.when(behind | F.col("earlier_us").isNull(), F.col("at_us")).otherwise(F.col("earlier_us"))
    df = df.withColumns(
        {
            "text": _line(F.col("habit")), "replacement": _line(F.transform("instead", lambda x: x["word"])), "start_us": F.greatest(F.lit(EARLIEST_US), begun - LEAD_US),
            "strike_us": at(F.col("say"))["start_us"], "replace_us": F.get("instead", F.lit(0))["start_us"],
        }
    )
    df = df.withColumn("end_us", F.least("duration_us", F.greatest(F.element_at(F.when(F.size("instead") > 0, F.col("instead")), -1)["end_us"] + HOLD_US, F.col("start_us") + LEAST_US)))
    pairs = (F.size("habit") > 0) & F.col("say").isNotNull()
    fits = F.length("text").between(1, LINE_CHARS) & F.length("replacement").between(1, LINE_CHARS)
    timed = (F.col("start_us") < F.col("strike_us")) & (F.col("strike_us") < F.col("replace_us")) & (F.col("replace_us") < F.col("end_us"))
    good = F.coalesce(pairs & (F.size("instead") > 0) & fits & timed, F.lit(False))
    onward = F.when(~pairs, F.col("at") + 1).when(good, F.col("at") + F.col("upto")).otherwise(F.greatest(F.col("at") + F.col("said"), F.col("at") + 1))
    told = written(df.select("source_id", "at", good.alias("good"), onward.alias("onward"), "start_us", "end_us", "text", "replacement", "strike_us", "replace_us"), "habits")

    def read_on(rows):
        free = 0
        for r in rows:
            if r.at >= free:
                free = r.onward
                if r.good:
                    yield r.source_id, r.at

    kept = fold(told.select("source_id", "at", "good", "onward"), ["source_id"], ["at"], read_on, "source_id long, at long")
    return told.join(kept, ["source_id", "at"], "left_semi").select("source_id", F.col("at").alias("idx"), "start_us", "end_us", "text", "replacement", "strike_us", "replace_us")
