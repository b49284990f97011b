"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

Each source's documents are put in a shuffled order (md5 of doc_id) and cut into blocks of equal tokens. The mix is a sequence
of slots; slot i belongs to the source whose stretch of the cumulative weights holds the i-th van der Corput
point, so every source is spread evenly over any prefix of the mix. A point's place in that stretch is its rank: ranks
of a source run from 0 to its number of slots less one without gaps, and rank r takes block r mod (blocks of the source) in epoch r div
blocks. The last slot of a source is cut to reach its target to the word.

No group is gathered anywhere: running sums go over about sqrt(rows) hash ranges of a source, first of their totals, then
inside each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, materialise

WEIGHTS = (5, 2, 1)
EPOCHS = 1.5
MOST = 2
BLOCK_TOKENS = 2048
SLOT_BIN = 4096


def word_count(text: Column) -> Column:
    """Words of a text, as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: float = EPOCHS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares of `epochs` x all words by weight, none over `most` x its size.

    Sources by code point, null last, take `weights` in turn. The excess of capped sources goes to the others by weight until none is above.
    Capped sources are those with the smallest size per weight: with sources in that order, the cap holds for a prefix, which
    running sums find. One row per source; no sources give no rows; a source of size 0 has target 0.
    """
    # one row per source: an ordering over them is small
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    named = sizes.withColumn("nth", F.row_number().over(by_name) - 1).withColumn("weight", w)
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "nth")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = (
        named.withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("capped", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("rate", (F.col("all_size") * epochs - F.col("capped") * most) / (F.col("all_weight") - F.col("gone")))
        .withColumn("above", F.col("rate") * F.col("weight") > F.col("source_size") * most)
    )
    rest = F.min(F.when(~F.col("above"), F.struct(F.col("source_size") / F.col("weight"), F.col("nth"), F.col("rate")))).over(everything)
    return ranked.withColumn("level", rest["rate"]).select(
        "source",
        "source_size",
        F.when(F.col("above") | F.col("level").isNull(), F.col("source_size") * float(most))
        .otherwise(F.col("level") * F.col("weight"))
        .alias("target"),
    )


def with_offsets(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds `start`: the words of the source before this row in its shuffled order.

    rows: (source, key md5 hex, size, ...); counts: (source, n_rows). Ties of the whole key stand in any order, which only equal doc_ids have.
    """
    share = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    binned = (
        rows.join(counts.select(F.col("source").alias("_s"), "n_rows"), F.col("source").eqNullSafe(F.col("_s")))
        .drop("_s")
        .withColumn("bin", F.floor(share * F.ceil(F.sqrt("n_rows"))).cast("long"))
    )
    by_bin = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (
        binned.groupBy("source", "bin")
        .agg(F.sum("size").alias("bin_size"))
        .select(F.col("source").alias("_s"), F.col("bin").alias("_b"), F.coalesce(F.sum("bin_size").over(by_bin), F.lit(0)).alias("base"))
    )
    inside = Window.partitionBy("source", "bin").orderBy("key", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        binned.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(bins, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bin") == F.col("_b")))
        .withColumn("start", (F.col("base") + F.col("within")).cast("long"))
        .drop("_s", "_b", "base", "within", "bin", "n_rows")
    )


def bit_reversed(i: Column, bits: int) -> Column:
    """The i-th van der Corput point in base 2, times 2**bits: i with its lowest `bits` bits reversed."""
    return F.reverse(F.lpad(F.bin(i), bits, "0")).alias("p") if bits else F.lit("0")


def schedule(plan: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(slot, source, rank, block, epoch, take) from (source, source_size, target).

    take is the words a slot takes from the front of its block: all of them, but for a source's last slot. Slots number the
    points of the smallest power of two that holds all slots of all sources, points past the last source being left out.
    """
    spark = plan.sparkSession
    b = block_tokens
    counted = (
        plan.where("source_size > 0")
        .withColumn("words", F.round("target").cast("long"))
        .withColumn("blocks", F.ceil(F.col("source_size") / b).cast("long"))
        .withColumn("full", F.floor(F.col("words") / F.col("source_size")).cast("long"))
        .withColumn("rest", F.col("words") - F.col("full") * F.col("source_size"))
        .withColumn("slots", F.col("full") * F.col("blocks") + F.ceil(F.col("rest") / b).cast("long"))
        .where("slots > 0")
    )
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    spans = counted.withColumn("hi", F.sum("slots").over(order)).withColumn("lo", F.col("hi") - F.col("slots"))
    total = spans.agg(F.max("hi")).first()[0] or 0
    bits = max(total - 1, 0).bit_length()
    points = spark.range(0, 1 << bits if total else 0).select(
        F.col("id").alias("slot"), F.conv(bit_reversed(F.col("id"), bits), 2, 10).cast("long").alias("point")
    )
    # a range join: spans go to every bin of points that they touch
    touched = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / SLOT_BIN), F.floor((F.col("hi") - 1) / SLOT_BIN))))
    placed = points.withColumn("bin", F.floor(F.col("point") / SLOT_BIN)).join(touched, "bin").where("point >= lo and point < hi")
    rank = F.col("point") - F.col("lo")
    return (
        placed.withColumn("rank", rank)
        .withColumn("block", F.col("rank") % F.col("blocks"))
        .withColumn("epoch", F.floor(F.col("rank") / F.col("blocks")).cast("long"))
        .withColumn("whole", F.least(F.lit(b), F.col("source_size") - F.col("block") * b))
        .withColumn("take", F.when(F.col("epoch") < F.col("full"), F.col("whole")).otherwise(F.least("whole", F.col("rest") - F.col("block") * b)))
        .select("slot", "source", "rank", "block", "epoch", F.col("take").cast("long").alias("take"))
    )


def pieces(placed: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(row key, source, block, lo, hi): the stretch of each block that a document's words fill, from its start and size.

    A very long document has as many pieces as it fills blocks."""
    b = block_tokens
    return (
        placed.where("size > 0")
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))))
        .withColumn("lo", F.greatest("start", F.col("block") * b) - F.col("block") * b)
        .withColumn("hi", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b) - F.col("block") * b)
    )


def mix(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, weights: tuple[int, ...] = WEIGHTS, epochs: float = EPOCHS, most: float = MOST) -> DataFrame:
    """Per row of docs (doc_id, text, source, any more columns): doc_id, source, size, source_size, target, taken.

    taken counts the words that the mix takes from the document over all epochs; it stays within `most` x size. A null or empty text has size
    0 and takes none; a null source is a source like any other, last in order; rows with equal doc_id count one by one; an empty table
    gives an empty one.
    """
    return _mix(docs, block_tokens, weights, epochs, most).drop("row")


def _mix(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, weights: tuple[int, ...] = WEIGHTS, epochs: float = EPOCHS, most: float = MOST) -> DataFrame:
    """The rows of `mix` with `row`, a hash of id, source and text."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    row = F.xxhash64("doc_id", "source", "text")
    rows = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"), row.alias("row")), "mix-sizes")
    counts = materialise(rows.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size")), "mix-sources")
    plan = materialise(targets(counts.select("source", "source_size"), weights, epochs, most), "mix-plan")
    placed = materialise(with_offsets(rows, counts), "mix-order")
    by_block = (
        schedule(plan, block_tokens)
        .groupBy("source", "block")
        .agg(F.collect_list("take").alias("takes"))
        .select(F.col("source").alias("_s"), F.col("block").alias("_k"), "takes")
    )
    cut = pieces(placed, block_tokens)
    # one slot list per block and a few pieces in it: an even join
    used = F.aggregate("takes", F.lit(0).cast("long"), lambda a, t: a + F.greatest(F.lit(0), F.least("hi", t) - F.col("lo")))
    taken = (
        cut.join(by_block, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_k")), "left")
        .withColumn("used", F.coalesce(used, F.lit(0)))
        .groupBy("doc_id", "source", "size", "row", "start")
        .agg(F.sum("used").cast("long").alias("taken"))
        .unionByName(placed.where("size = 0").select("doc_id", "source", "size", "row", "start", F.lit(0).cast("long").alias("taken")))
    )
    sources = plan.select(F.col("source").alias("_s"), "source_size", "target")
    return taken.join(sources, F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "source", "size", "row", "source_size", "target", "taken")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs with size, source_size, target and taken of `mix`; columns of docs with these names give way.

    Every row takes what its own place in the mix gives it: rows that repeat id, source and text are numbered, so a source's words come to its target. Null and empty
    texts take none; an empty table gives an empty one.
    """
    nth = lambda order: F.row_number().over(Window.partitionBy("__llm_row").orderBy(order))  # noqa: E731  rows of a hash are equal rows
    found = _mix(docs, **options).select(F.col("row").alias("__llm_row"), F.struct("size", "source_size", "target", "taken").alias("__llm_mix"))
    twins = found.groupBy("__llm_row").agg(F.count("*").alias("__llm_n")).where("__llm_n > 1").select(F.col("__llm_row").alias("__llm_twin"))
    old = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    asked = docs.withColumn("__llm_row", F.xxhash64("doc_id", "source", "text")).select(*old, "__llm_row")
    # rows without an equal one meet by hash alone; the few others are numbered on both sides
    one = asked.join(found.join(twins, F.col("__llm_row") == F.col("__llm_twin"), "left_anti"), "__llm_row")
    many = (
        asked.join(twins, F.col("__llm_row") == F.col("__llm_twin"), "left_semi").withColumn("__llm_k", nth(F.lit(1)))
        .join(found.join(twins, F.col("__llm_row") == F.col("__llm_twin"), "left_semi").withColumn("__llm_k", nth(F.col("__llm_mix"))), ["__llm_row", "__llm_k"])
    )
    return one.select(*old, "__llm_mix.*").unionByName(many.select(*old, "__llm_mix.*"))
