"""The corpus pipeline: documents in, a mixed corpus out. STAGES lists its stages in order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents. A stage's result is written to the
shared folder and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import decontaminate, line_dedup, mixing, quality, simhash
from tempora.llm.shared import materialise

#: Some stages can't be put in SQL: learned scores, edit distances, fingerprints, templates.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts are scored as empty ones, very long ones whole; equal texts, and so repeated rows, stay or go together. Without labels of both kinds
    every document stays. A null doc_id is no label's. An empty table gives an empty one; other columns pass through, whatever their names.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat, nearly or exactly, an earlier one. No document goes here, even if no line is left.

    Earlier: smaller doc_id (null first), then row, then line. Null texts stay null, blank lines stay; rows that repeat id and text keep the same lines. An
    empty table gives an empty one; n_chars follows the text, other columns pass through.
    """
    return line_dedup.dedup(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id.

    Null, empty and blank texts are one group. Of rows that repeat the kept doc_id one stays; rows with a null doc_id all stay. An empty table gives an empty
    one; other columns pass through.
    """
    return simhash.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item.

    Null and empty texts repeat nothing. All rows of a doc_id (null too) go if one of them repeats an item. Empty tables take nothing away; other columns pass
    through.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words from, with size, source_size, target and taken, which take the place of columns of those names.

    Null and empty texts have no words and go. A null source is a source like any other; repeated rows each take their own words. An empty table gives an empty
    one.
    """
    return mixing.mixed(docs).where(F.col("taken") > 0)


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near-duplicates", near_duplicate_stage),
    ("benchmark", benchmark_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
