"""Sources and sinks: typed tables with a version check, damaged JSON lines, timed text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 1
LOG = "renderer string, quality string, width int, height int, output_seconds double, elapsed_seconds double, at string"


def load_table(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A Parquet table that must have the columns of `schema` and, if it carries one, schema_version VERSION in every row.

    Column names and types are checked before any job runs; another version fails the job that meets it.
    """
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    found = spark.read.parquet(path)
    have = {f.name: f.dataType for f in found.schema}
    wrong = [f.name for f in wanted if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"{path}: missing or of another type: {', '.join(wrong)}")
    if "schema_version" in have:
        ok = F.when(F.col("schema_version") == VERSION, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("schema version "), F.col("schema_version").cast("string"))))
        found = found.where(ok)
    return found.select(*[f.name for f in wanted])


def save_table(df: DataFrame, path: str) -> None:
    """Write with the version beside the data; Spark's commit publishes all files or none."""
    df.withColumn("schema_version", F.lit(VERSION)).write.mode("errorifexists").parquet(path)


def read_render_log(lines: DataFrame) -> DataFrame:
    """Usable entries of JSON lines (column value); damaged lines, and those without positive sizes and times, are left out."""
    entry = F.from_json("value", LOG, {"mode": "PERMISSIVE"})
    return lines.select(entry.alias("e")).select("e.*").where(
        "renderer is not null and quality is not null and output_seconds > 0 and elapsed_seconds > 0 and width > 0 and height > 0"
    )


def _number(c) -> F.Column:
    return F.replace(c, F.lit(","), F.lit(".")).cast("decimal(12,3)")


def _time_ms(c) -> F.Column:
    """Seconds, with a decimal comma or point, as milliseconds; null for anything else."""
    return F.when(c.rlike("^[0-9]+([.,][0-9]+)?$"), (_number(c) * 1000).cast("long"))


#: The first words of a brief's sections.
BRIEF_SECTIONS = {"nagranie": "recording", "scenariusz": "scenario", "montaż": "montage", "montaz": "montage", "okładka": "cover", "okladka": "cover"}


def brief_sections(texts: DataFrame, key: str, sections: dict[str, str] | None = None) -> DataFrame:
    """(key, line_no, section, line): the lines of each section of a text. A line whose first word, whatever its case and any # before it, is one of `sections` opens one; what follows its colon, or without one the word,
    is the section's first line, if there is any. Lines before the first such line are in none."""
    names = BRIEF_SECTIONS if sections is None else sections
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    rows = texts.select(key, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    plain = F.ltrim(F.regexp_replace(F.ltrim("line"), "^#+", ""))
    word = F.lower(F.element_at(F.split(plain, r"[^\p{L}\p{N}_]"), 1))
    opened = rows.withColumn("opens", known[word])
    colon = F.instr("line", ":")
    rest = F.when(colon > 0, F.substring(F.col("line"), colon + 1, F.length("line"))).otherwise(F.substring(plain, F.length(word) + 1, F.length("line")))
    order = Window.partitionBy(key).orderBy("line_no")
    line = F.when(F.col("opens").isNull(), F.col("line")).otherwise(F.trim(rest))
    placed = opened.select(key, "line_no", F.last("opens", ignorenulls=True).over(order).alias("section"), line.alias("line"), F.col("opens").isNotNull().alias("head"))
    return placed.where("section is not null and not (head and line = '')").drop("head")


def parse_brief_rows(texts: DataFrame, key: str) -> DataFrame:
    """(key, line_no, start_ms, end_ms, shot, said, on_screen, off_screen) of timed rows `a-b s | shot | said | on screen`.

    The first cell is two times with a dash of any length between them, each with or without its unit. A row lasts 100 ms at least; on-screen text is split at ` / `; a said part that begins with `off` and a colon
    isn't heard in the picture. Other lines are left out.
    """
    rows = texts.select(key, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^[-*•|\s]+|[|\s]+$", ""), r"\|"), lambda x: F.trim(x))
    ends = F.transform(F.split(F.translate(F.col("c")[0], "–—", "--"), "-"), lambda x: _time_ms(F.trim(F.regexp_replace(F.trim(x), "s$", ""))))
    timed = rows.withColumn("c", cells).where(F.size("c") >= 3).withColumn("t", ends).where((F.size("t") == 2) & F.col("t")[0].isNotNull() & F.col("t")[1].isNotNull())
    screen = F.filter(F.transform(F.split(F.coalesce(F.try_element_at("c", F.lit(4)), F.lit("")), " / "), lambda x: F.trim(x)), lambda x: x != "")
    return timed.select(
        key, "line_no", F.col("t")[0].alias("start_ms"), F.greatest(F.col("t")[1], F.col("t")[0] + 100).alias("end_ms"), F.col("c")[1].alias("shot"), F.col("c")[2].alias("said"),
        F.array_join(screen, "|").alias("on_screen"), F.lower(F.col("c")[2]).rlike(r"^off\s*:").alias("off_screen"),
    )


def _without_quote(c: F.Column) -> F.Column:
    """Text without one quotation mark at either end."""
    opened = F.when(F.left(c, F.lit(1)).isin(*'"\'“„'), F.substring(c, 2, 1 << 20)).otherwise(c)
    return F.when(F.right(opened, F.lit(1)).isin(*'"\'“”'), F.left(opened, F.length(opened) - 1)).otherwise(opened)


def parse_story_rows(texts: DataFrame, key: str) -> DataFrame:
    """(key, line_no, sentence, clip, at_ms, hold_ms) of lines `"sentence" -> clip @ at hold s`; others are left out.

    The last arrow of a line parts the sentence from the rest; its first word is the clip. What follows are `@` and a time, then a time and `s`, either of
    which may be absent; with anything else left over it is no story line.
    """
    rows = texts.select(key, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    halves = F.split(F.replace("line", F.lit("→"), F.lit("->")), "->")
    sides = rows.withColumn("h", halves).where(F.size("h") > 1).select(
        key, "line_no", F.trim(F.array_join(F.slice("h", F.lit(1), F.size("h") - 1), "->")).alias("said"),
        F.filter(F.split(F.element_at("h", -1), r"\s+"), lambda x: x != "").alias("t"),
    )
    # after the clip: marks and units stand by themselves
    loose = F.split(F.trim(F.regexp_replace(F.array_join(F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))), " "), "(@|s$)", " $1 ")), " +")
    told = sides.where("size(t) > 0 and said <> ''").select(key, "line_no", "said", F.col("t")[0].alias("clip"), F.filter(loose, lambda x: x != "").alias("t"))
    has_at = F.coalesce(F.try_element_at("t", F.lit(1)) == "@", F.lit(False))
    parted = told.withColumn("hold", F.when(has_at, F.slice("t", F.lit(3), F.greatest(F.size("t") - 2, F.lit(0)))).otherwise(F.col("t")))
    at = F.when(has_at, _time_ms(F.try_element_at("t", F.lit(2)))).otherwise(F.lit(0).cast("long"))
    held = F.when((F.size("hold") == 2) & (F.try_element_at("hold", F.lit(2)) == "s"), _time_ms(F.try_element_at("hold", F.lit(1))))
    out = parted.select(
        key, "line_no", F.trim(F.regexp_replace(_without_quote(F.col("said")), r"\s+", " ")).alias("sentence"), "clip", at.alias("at_ms"), held.alias("hold_ms"), F.size("hold").alias("n"),
    )
    return out.where("sentence <> '' and at_ms is not null and (n = 0 or hold_ms is not null)").drop("n")
