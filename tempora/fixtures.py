"""Speech-timeline tables derived from the given ones, in Spark and, under the same names, as DuckDB CTEs for the oracles.

Times are integer microseconds (`*_us`). One recording is a conversation: its words get times from their lengths and the
punctuation before them. Edits, measurements and deliveries come from the order and part tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, idx, word, speaker, turn, start_us, end_us, confidence_pct)."""
    order = Window.partitionBy("source_id").orderBy("turn", "pos")
    split = (
        table(spark, sf_dir, "conversations")
        .select(F.col("conv_id").alias("source_id"), "turn", F.col("role").alias("speaker"), F.split("text", r"\s+").alias("ws"))
        .select("source_id", "turn", "speaker", F.posexplode(F.filter("ws", lambda x: x != "")).alias("pos", "word"))
        .withColumn("idx", (F.row_number().over(order) - 1).cast("long"))
        .withColumn("before", F.lag("word").over(order))
    )
    n = F.length("word")
    gap = (
        F.when(F.col("before").isNull(), 400)
        .when(F.col("before").rlike(r"[.!?]$"), 300 + 150 * (n % 5))
        .when(F.col("before").rlike(r"[,;:]$"), 120 + 60 * (n % 4))
        .otherwise(10 * (n % 4))
    )
    timed = split.withColumn("dur_ms", 80 + 30 * n).withColumn("end_ms", F.sum(gap + F.col("dur_ms")).over(order))
    return timed.select(
        "source_id",
        "idx",
        "word",
        "speaker",
        "turn",
        (1000 * (F.col("end_ms") - F.col("dur_ms"))).cast("long").alias("start_us"),
        (1000 * F.col("end_ms")).cast("long").alias("end_us"),
        ((7 * n + F.col("source_id") + F.col("idx")) % 100).cast("int").alias("confidence_pct"),
    )


def recordings(w: DataFrame) -> DataFrame:
    """(source_id, duration_us, language, provider_model, language_confidence_pct) of words."""
    k = F.col("source_id") % 4
    return w.groupBy("source_id").agg((F.max("end_us") + 1_500_000).alias("duration_us")).select(
        "source_id",
        "duration_us",
        F.when(k == 0, "en").when(k == 1, "pl").when(k == 2, "de").otherwise("fr").alias("language"),
        F.when(F.col("source_id") % 3 == 0, "small.en").when(F.col("source_id") % 3 == 1, "small").otherwise("medium").alias("provider_model"),
        (F.col("source_id") * 37 % 100).cast("int").alias("language_confidence_pct"),
    )


def turns(w: DataFrame) -> DataFrame:
    """(source_id, turn, start_us, end_us, label): diarized turns, shifted against the words."""
    shift = F.col("source_id") % 3 * 100_000
    return w.groupBy("source_id", "turn", "speaker").agg(F.min("start_us").alias("s"), F.max("end_us").alias("e")).select(
        "source_id", "turn", (F.col("s") + shift).alias("start_us"), (F.col("e") + shift).alias("end_us"), F.concat(F.lit("spk-"), "speaker").alias("label")
    )


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(edit_id, range_idx, source_id, start_us, end_us, zoom_pct, speed_pct, beat): an edit per order, a range per line."""
    q = F.col("l_quantity").cast("long")
    start = 500_000 + (F.col("l_partkey") % 40) * 250_000
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    numbered = table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(order) - 1)
    return numbered.select(
        F.col("l_orderkey").cast("long").alias("edit_id"),
        F.col("n").cast("long").alias("range_idx"),
        (F.col("l_orderkey") % 50).cast("long").alias("source_id"),
        start.cast("long").alias("start_us"),
        (start + 300_000 + q * 60_000).cast("long").alias("end_us"),
        (100 + F.col("l_suppkey") % 3 * 10).cast("int").alias("zoom_pct"),
        (F.when(F.col("n") % 4 == 3, 125).otherwise(100)).cast("int").alias("speed_pct"),
        F.col("l_returnflag").alias("beat"),
    )


def scaled(x: Column, by: int = 1000) -> Column:
    """floor(x * by) of a vector's component, in the floats that the component is kept in; `x * 1000` alone would be a double, which falls to the other side of a whole number at times."""
    return F.floor((x * F.lit(by).cast("float")).cast("float"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings with source_id: recordings of 400 vectors at most within each label."""
    return table(spark, sf_dir, "embeddings").withColumn("source_id", (F.col("label") * 1_000_000 + F.floor(F.col("vec_id") / 400)).cast("long"))


SEGMENTS_CTE = "segments as (select *, (label * 1000000 + vec_id // 400)::bigint as source_id from embeddings)"

WORDS_CTE = r"""
ws as (
  select conv_id as source_id, turn, role as speaker,
         list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as ws from conversations
), wp as (
  select source_id, turn, speaker, unnest(ws) as word, generate_subscripts(ws, 1) as pos from ws
), wl as (
  select *, (row_number() over o - 1)::bigint as idx, lag(word) over o as before, length(word) as n
  from wp window o as (partition by source_id order by turn, pos)
), wt as (
  select *, 80 + 30 * n as dur_ms,
         sum(80 + 30 * n + case when before is null then 400
             when regexp_matches(before, '[.!?]$') then 300 + 150 * (n % 5)
             when regexp_matches(before, '[,;:]$') then 120 + 60 * (n % 4)
             else 10 * (n % 4) end) over (partition by source_id order by turn, pos) as end_ms
  from wl
), words as (
  select source_id, idx, word, speaker, turn, (1000 * (end_ms - dur_ms))::bigint as start_us, (1000 * end_ms)::bigint as end_us,
         ((7 * n + source_id + idx) % 100)::integer as confidence_pct from wt
)"""

RECORDINGS_CTE = """
recordings as (
  select source_id, max(end_us) + 1500000 as duration_us,
         case source_id % 4 when 0 then 'en' when 1 then 'pl' when 2 then 'de' else 'fr' end as language,
         case source_id % 3 when 0 then 'small.en' when 1 then 'small' else 'medium' end as provider_model,
         (source_id * 37 % 100)::integer as language_confidence_pct
  from words group by source_id
)"""

TURNS_CTE = """
turns as (
  select source_id, turn, min(start_us) + source_id % 3 * 100000 as start_us, max(end_us) + source_id % 3 * 100000 as end_us,
         'spk-' || speaker as label
  from words group by source_id, turn, speaker
)"""

RANGES_CTE = """
numbered as (
  select *, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1)::bigint as n
  from lineitem
), ranges as (
  select l_orderkey::bigint as edit_id, n as range_idx, (l_orderkey % 50)::bigint as source_id,
         (500000 + (l_partkey % 40) * 250000)::bigint as start_us,
         (500000 + (l_partkey % 40) * 250000 + 300000 + l_quantity::bigint * 60000)::bigint as end_us,
         (100 + l_suppkey % 3 * 10)::integer as zoom_pct,
         (case when n % 4 = 3 then 125 else 100 end)::integer as speed_pct, l_returnflag as beat
  from numbered
)"""
