"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of at most so many rows, elements of arrays counted singly, are sent to every executor.
SENT_ROWS = 500_000
#: Folders of our own by application, where none is named.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset in local mode, one of our own for each application. On a cluster it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _OWN[app] = _OWN.get(app) or "file://" + tempfile.mkdtemp(prefix="tempora-shared-")
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def table_path(spark: SparkSession, tag: str, kind: str = "tables") -> str:
    """A new path in this application's folder, which goes when the application ends: results may be read until then."""
    root = f"{shared_dir(spark)}/{kind}-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.mkdirs(path):
        files.deleteOnExit(path)
    return f"{root}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, kind: str = "tables") -> DataFrame:
    """df written into the shared folder and read back: lineage ends there, and lost executors cost nothing."""
    path = table_path(df.sparkSession, tag, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent(df: DataFrame, size: Column | None = None) -> DataFrame:
    """A table read from files as a broadcast one if its rows, each counted `size` times, are SENT_ROWS at most; else as it is."""
    rows = df.agg(F.sum(F.lit(1) if size is None else size)).first()[0] or 0
    return F.broadcast(df) if rows <= SENT_ROWS else df
