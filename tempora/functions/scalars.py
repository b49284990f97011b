"""Column functions over words and texts: all stay inside Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks that end a sentence and a clause, and closing marks that may follow them.
SENTENCE_END = ".!?…"
CLAUSE_END = ",;:-–—"
CLOSING = r"[\"')\]}]*$"


def normalise(c: Column) -> Column:
    """Lower case without punctuation at either end. `lower` leaves the German sharp s alone where case folding would not."""
    return F.lower(F.regexp_replace(c, r"^\p{P}+|\p{P}+$", ""))


def word_key(c: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def bare_end(c: Column) -> Column:
    """The word without closing quotes and brackets at its end."""
    return F.regexp_replace(c, CLOSING, "")


def ends_sentence(c: Column) -> Column:
    return bare_end(c).rlike("[.!?…]$")


def ends_clause(c: Column) -> Column:
    return bare_end(c).rlike("[,;:\\-–—]$")


def is_junk(c: Column) -> Column:
    """No speech: blank, notes or the replacement character, a bracketed annotation, or nothing that makes a word."""
    s = F.regexp_replace(c, r"^\s+|\s+$", "")
    return (s == "") | s.rlike("[♪♫♬�]") | s.rlike(r"^[\[(*].*[\])*]$") | ~s.rlike(r"[\p{L}\p{N}_]")


def tidy_text(c: Column) -> Column:
    """Marks joined to the word before them, runs of blanks made one."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+([,.;:!?…])", "$1"), r"\s+", " "))


def apply_case(c: Column, case: str) -> Column:
    """As spoken, or in upper or lower case."""
    return {"upper": F.upper, "lower": F.lower}.get(case, lambda x: x)(c)


def first_sentence(c: Column) -> Column:
    """Up to the first mark that ends a sentence before white space or the end; the whole text without one."""
    found = F.regexp_extract(c, r"^([\s\S]*?[.!?…])(?:\s|$)", 1)
    return F.when(found == "", c).otherwise(found)


def placeholders(c: Column) -> Column:
    """The [[slots]] left in a template."""
    return F.regexp_extract_all(c, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))


def greatest_divisor(a: Column, b: Column) -> Column:
    """By Euclid's steps, folded over a bounded sequence: 48 steps suffice for 32-bit numbers."""
    start = F.struct(F.greatest(a, b).cast("long").alias("x"), F.least(a, b).cast("long").alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.when(s["y"] == 0, 1).otherwise(s["y"])).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(48)), start, step, lambda s: s["x"])


def aspect_label(w: Column, h: Column) -> Column:
    """9:16, 4:5, 1:1 or 16:9 where the ratio is within 2 % of it, else the reduced ratio."""
    near = lambda a, b: F.abs(w * b - h * a) * 50 <= h * a
    g = greatest_divisor(w, h)
    out = F.concat_ws(":", (w / g).cast("long"), (h / g).cast("long"))
    for a, b in reversed(((9, 16), (4, 5), (1, 1), (16, 9))):
        out = F.when(near(a, b), f"{a}:{b}").otherwise(out)
    return out


def rounded(c: Column, places: int) -> Column:
    """A double at so many places, half away from zero. It is scaled, rounded and scaled back in doubles; Spark's own `round` goes by the decimal digits."""
    scaled = F.abs(c * float(10**places))
    whole = F.floor(scaled)
    return F.signum(c) * (whole + (scaled - whole >= 0.5).cast("int")) / float(10**places)


def leans_forward(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """words with `leans`: listed (lexicon: key) and no mark after it. The lexicon is a small table of its own."""
    listed = lexicon.select(F.col("key").alias("_key")).distinct()
    open_end = ~(ends_sentence(F.col("word")) | ends_clause(F.col("word"))) & (bare_end(F.col("word")) != "")
    return words.join(listed, word_key(F.col("word")) == F.col("_key"), "left").withColumn("leans", open_end & F.col("_key").isNotNull()).drop("_key")
