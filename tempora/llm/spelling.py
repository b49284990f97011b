"""Spelling variants by a variable-length gram index.

A gram is a stretch of QMIN to QMAX code points of a word. The dictionary is pruned by frequency: a gram is extended only while more than PRUNE words hold it,
so frequent stretches are told apart by longer grams. Every word is in the list of each of its grams, by place and length of the word.
A word is decomposed into two dictionary grams that don't overlap, those with the shortest lists. One edit affects at most one of the two, so the other stands
unchanged in every near word, at its place or one further: merging the lists of both loses no pair. Candidates are verified by edit distance.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise

#: A run of letters: fixed by the contract. Shorter runs can't become words.
RUN = r"[A-Za-zÀ-ÿ]"
SHORTEST = 6
OFTEN = 5
#: One of so many occurrences loses a letter, and a form is so many times as frequent as its variant.
SPOILT = 199
TIMES = 5

QMIN, QMAX = 2, 6
#: Code points up to which words are cut and compared as short ones.
SUBSTRINGS = 64
#: Words that a gram may stand in before it is extended.
PRUNE = 32
#: Frequent grams that are broadcast at most; with more, PRUNE is doubled until they are as few. That lengthens lists, and loses nothing.
FREQUENT = 500_000


def words(docs: DataFrame, text: str = "text", shortest: int = SHORTEST, often: int = OFTEN, spoilt: int = SPOILT) -> DataFrame:
    """(word, n): the distinct runs of letters of whole texts, A-Z in lower case, of at least `shortest` code points that occur at least `often` times.

    An occurrence whose crc32 of `<doc_id>:<run>` is a multiple of `spoilt` loses the code point at that crc32 modulo the run's length; a null doc_id is written as nothing.
    Null and empty texts have no runs. Repeated rows count each time.
    """
    lower = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(lower, F.lit(f"{RUN}{{{shortest},}}"), F.lit(0))).alias("run"),
    )
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return (
        runs.withColumn("h", h)
        .select(F.when(F.col("h") % spoilt == 0, less).otherwise(F.col("run")).alias("word"))
        .where(F.length("word") >= shortest)
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= often)
    )


def _grams(word: Column) -> Column:
    """All (at, gram) of a word, QMIN to QMAX long. Cut out of the word itself while that's short, else out of its letters: substring counts from the start."""

    def cut(of: Column, gram) -> Column:
        def each(s):
            lengths = lambda at: F.sequence(F.lit(QMIN), F.least(F.lit(QMAX), s["n"] - at))
            return F.flatten(F.transform(F.sequence(F.lit(0), s["n"] - QMIN), lambda at: F.transform(lengths(at), lambda q: F.struct(at.alias("at"), gram(s["of"], at, q).alias("gram")))))

        return F.transform(F.array(F.struct(of.alias("of"), F.length(word).alias("n"))), each)[0]  # what a lambda names is computed once

    short = cut(word, lambda w, at, q: F.substring(w, at + 1, q))
    return F.when(F.length(word) <= SUBSTRINGS, short).otherwise(cut(F.split(word, ""), lambda x, at, q: F.aggregate(F.sequence(F.lit(0), q - 1), F.lit(""), lambda g, i: F.concat(g, F.get(x, at + i)))))


def frequent_grams(found: DataFrame, prune: int = PRUNE, most: int = FREQUENT) -> dict[str, int]:
    """Number of places of each gram that stands at more than `prune` places of the words: what the dictionary extends. `most` grams at most."""
    counted = found.select(F.explode(F.transform(_grams(F.col("word")), lambda g: g["gram"])).alias("gram")).groupBy("gram").agg(F.count("*").alias("places"))
    kept = materialise(counted.where(F.col("places") > prune), "spelling-grams")
    while kept.where(F.col("places") > prune).count() > most:
        prune *= 2
    return {r.gram: r.places for r in kept.where(F.col("places") > prune).toLocalIterator()}


def decompose(word: str, frequent: dict[str, int], rare: int = PRUNE) -> list[tuple[int, str]]:
    """The two dictionary grams (place, gram) of a word that don't overlap and stand in the fewest places together."""
    n = len(word)
    none = (1 << 60, 0, "")
    ends, starts = [none] * (n + 1), [none] * (n + 1)
    for at in range(n - QMIN + 1):
        for to in range(at + QMIN, min(n, at + QMAX) + 1):
            gram = word[at:to]
            places = frequent.get(gram)
            own = (rare if places is None else places, at, gram)
            ends[to], starts[at] = min(ends[to], own), min(starts[at], own)
            if places is None:
                break  # not extended
    for i in range(1, n + 1):
        ends[i] = min(ends[i], ends[i - 1])
        starts[n - i] = min(starts[n - i], starts[n - i + 1])
    cut = min(range(QMIN, n - QMIN + 1), key=lambda i: ends[i][0] + starts[i][0])
    return [ends[cut][1:], starts[cut][1:]]


def _key(gram, at, length) -> Column:
    return F.xxhash64(gram, at.cast("int"), length.cast("int"))


def _one_edit(a: Column, b: Column) -> Column:
    """Whether a and the other b, as long or one longer, are one edit apart. Beyond SUBSTRINGS their common start is found by bisection: the banded distance isn't linear."""
    powers = F.array(*[F.lit(1 << k) for k in range(27, -1, -1)])
    same = lambda n: F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n)
    start = F.aggregate(powers, F.lit(0), lambda n, p: F.when((n + p <= F.length(a)) & same(n + p), n + p).otherwise(n))
    rest = lambda w, at: F.substring(w, at, F.length(w))
    by_start = F.when(F.length(a) == F.length(b), rest(a, start + 2) == rest(b, start + 2)).otherwise(rest(a, start + 1) == rest(b, start + 2))
    return F.when(F.length(b) <= SUBSTRINGS, F.levenshtein(a, b, 1) == 1).otherwise(by_start)


def near_pairs(found: DataFrame, prune: int = PRUNE, most: int = FREQUENT) -> DataFrame:
    """(a, a_n, b, b_n): each pair of words (word, n; 2 * QMIN code points at least, each word once) at edit distance one, once.

    Of two words the shorter one, or that first in code-point order, looks for the other.
    """
    spark = found.sparkSession
    shared = spark.sparkContext.broadcast(frequent_grams(found, prune, most))  # at most `most` short strings

    def chosen(batches):
        for pdf in batches:
            two = [decompose(w, shared.value, prune) for w in pdf["word"]]
            yield pd.DataFrame({"a": pdf["word"], "a_n": pdf["n"], "at1": [x[0][0] for x in two], "gram1": [x[0][1] for x in two], "at2": [x[1][0] for x in two], "gram2": [x[1][1] for x in two]})

    tiles = found.select("word", "n").mapInPandas(chosen, "a string, a_n long, at1 int, gram1 string, at2 int, gram2 string")
    each = tiles.select("a", "a_n", F.inline(F.array(*[F.struct(F.col(f"at{i}").alias("at"), F.col(f"gram{i}").alias("gram")) for i in (1, 2)])))
    n = F.length("a")
    keys = F.array(_key(F.col("gram"), F.col("at"), n), _key(F.col("gram"), F.col("at"), n + 1), _key(F.col("gram"), F.col("at") + 1, n + 1))
    probes = each.select("a", "a_n", F.explode(keys).alias("key"))
    listed = found.select(F.col("word").alias("b"), F.col("n").alias("b_n"))
    g = F.explode(_grams(F.col("b"))).alias("g")
    key = _key(F.col("g.gram"), F.col("g.at"), F.col("n")).alias("key")
    ordered = (F.length("b") > F.length("a")) | (F.col("a") < F.col("b"))
    short = F.length("b") <= SUBSTRINGS
    lists = listed.where(short).select("b", "b_n", F.length("b").alias("n"), g).select("b", "b_n", key)
    # Spark sizes what is exploded or stands compressed in files far too low: none of it is to be broadcast
    met = probes.where(n <= SUBSTRINGS).join(lists.hint("merge"), "key").where(ordered & _one_edit(F.col("a"), F.col("b"))).select("a", "a_n", "b", "b_n")
    # very long words aren't carried along with each of their grams
    lists = listed.where(~short).select(F.xxhash64("b").alias("id_b"), F.length("b").alias("n"), g).select("id_b", key)
    some = probes.where(n >= SUBSTRINGS).select(F.xxhash64("a").alias("id_a"), "key").join(lists.hint("merge"), "key").select("id_a", "id_b").distinct()
    asking = found.where(F.length("word") >= SUBSTRINGS).select(F.xxhash64("word").alias("id_a"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    far = some.join(asking.hint("merge"), "id_a").join(listed.where(~short).withColumn("id_b", F.xxhash64("b")).hint("merge"), "id_b").where(ordered & _one_edit(F.col("a"), F.col("b")))
    return met.unionByName(far.select("a", "a_n", "b", "b_n")).distinct()


def variants(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of docs (doc_id, text, any more columns).

    n_near: number of words one inserted, deleted or replaced code point away. form: the most frequent of these (ties: first by code points) if it is TIMES as
    frequent, else null; form_n: its n. root: where forms lead in the end, the word itself without one. An empty table, or one of null and empty texts, gives no
    rows; very long runs are words like any other.
    """
    found = materialise(words(docs, text), "spelling-words")
    pairs = materialise(near_pairs(found), "spelling-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    near = both.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("rank"), F.col("b").alias("word"))).alias("best"), F.first("a_n").alias("n"))
    is_form = -F.col("best.rank") >= TIMES * F.col("n")
    near = materialise(
        near.select(F.col("a").alias("word"), "n_near", F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.rank")).alias("form_n")), "spelling-near"
    )
    # pointer doubling: every round leads twice as far
    lead = near.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = lead.select(F.col("word").alias("root"), F.col("root").alias("further"))
        lead = materialise(lead.join(onward.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        moved = lead.where("moved").limit(1).count()
        lead = lead.drop("moved")
        if not moved:
            break
    return (
        found.join(near.hint("merge"), "word", "left")
        .join(lead.hint("merge"), "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
    )
