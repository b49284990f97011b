"""Token counts kept up to date by signed batches.

A ledger is a folder of committed batches. A batch holds signed document rows (+1 for a count that holds from now on, -1 for one that no longer does)
and their sums by source, language and tokenizer version. Totals are sums of the batches' sums: inserts, deletes and revisions
all add up, in any order and grouping. What a change takes back is looked up in the ledger, so callers only state what is true now.

A batch is written into a folder of its own, then published by renaming a marker that names it; a batch id that has a marker
is never applied again, and what a failed attempt left behind is never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD, materialise

# Tokenizer versions that are patterns, a token per match.
PATTERNS = {"words-1": WORD, "pieces-1": r"\p{L}+|\p{N}|[^\x20\x09-\x0D\p{L}\p{N}]"}
DOC = "doc_id long, source string, lang string, tokenizer string, n_tokens long"
GROUP = ("source", "lang", "tokenizer")


def count(docs: DataFrame, versions: Iterable[str] = tuple(PATTERNS), text: Column | str = "text") -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens) for every row of docs and tokenizer version of PATTERNS; null texts have no tokens."""
    text = F.col(text) if isinstance(text, str) else text
    each = [F.struct(F.lit(v).alias("v"), F.coalesce(F.regexp_count(text, F.lit(PATTERNS[v])), F.lit(0)).cast("long").alias("n")) for v in versions]
    return docs.select("doc_id", "source", "lang", F.explode(F.array(*each)).alias("t")).select(
        "doc_id", "source", "lang", F.col("t.v").alias("tokenizer"), F.col("t.n").alias("n_tokens")
    )


def count_bpe(docs: DataFrame, vocabulary: str, version: str, pattern: str) -> DataFrame:
    """The same for a byte-pair tokenizer: `vocabulary` is the path of its ranks (base64 token and rank a line), read through Spark.

    pattern: the regular expression that cuts a text before merging. The vocabulary is broadcast (a few MB at any corpus size)."""
    import base64

    lines = docs.sparkSession.read.text(vocabulary).where("value <> ''").collect()
    ranks = {base64.b64decode(a): int(b) for a, b in (r["value"].split() for r in lines)}
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        import tiktoken

        coder = tiktoken.Encoding(version, pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        for pdf in batches:
            n = [len(coder.encode_ordinary(t)) if t else 0 for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "lang": pdf["lang"], "tokenizer": version, "n_tokens": n})

    return docs.select("doc_id", "source", "lang", "text").mapInPandas(run, DOC)


class Ledger:
    """Signed counts in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._fs_path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def batches(self) -> dict[str, str]:
        """Folder of each committed batch id."""
        root = self._fs_path(f"{self.path}/commits")
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return {b: f.replace("=", "/") for b, f in (n.split("@") for n in names if "@" in n and not n.startswith("."))}

    def _read(self, part: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{d}/{part}" for d in self.batches().values()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def documents(self) -> DataFrame:
        """Counts that hold now: (doc_id, source, lang, tokenizer, n_tokens), a row per document and tokenizer version."""
        net = self._read("rows", DOC + ", sign int").groupBy("doc_id", *GROUP, "n_tokens").agg(F.sum("sign").alias("held"))
        return net.where("held > 0").drop("held")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over the committed batches; groups with no document left are gone."""
        sums = self._read("sums", "source string, lang string, tokenizer string, n_docs long, n_tokens long")
        return sums.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs > 0")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it was committed before.

        changes: (op, doc_id, source, lang, tokenizer, n_tokens[, seq]); op is insert, revise or delete, any other is an error. Inserting or
        revising states the count of a document and tokenizer version, whether it was counted before or not; deleting a document (tokenizer null: under all versions)
        that isn't counted does nothing. Of several changes to one of them the largest seq holds, a delete among equals, then the largest count.
        Rows without doc_id or, unless deletes, without n_tokens are left out. Null sources and languages are groups of their own.
        """
        if "@" in batch_id or "/" in batch_id or batch_id.startswith("."):
            raise ValueError("a batch id can't hold @ or / or begin with a dot")
        if batch_id in self.batches():
            return False
        seq = F.col("seq") if "seq" in changes.columns else F.lit(0)
        known = F.col("op").isin("insert", "revise", "delete")
        given = changes.select(
            F.when(known, F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null"))))).alias("op"),
            "doc_id", "source", "lang", "tokenizer", "n_tokens", seq.alias("seq"),
        ).where("doc_id is not null and (op = 'delete' or n_tokens is not null)")
        given = materialise(given, "token-changes")  # it is read three times, and counting tokens is dear
        held = self.documents()
        whole = given.where("op = 'delete' and tokenizer is null").select("doc_id", "seq")
        spread = held.select("doc_id", "tokenizer").join(whole, "doc_id").select(
            F.lit("delete").alias("op"), "doc_id", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"),
            "tokenizer", F.lit(None).cast("long").alias("n_tokens"), "seq",
        )
        last = Window.partitionBy("doc_id", "tokenizer").orderBy(F.desc("seq"), F.desc(F.col("op") == "delete"), F.desc("n_tokens"), "source", "lang")
        now = (
            given.where("op <> 'delete' or tokenizer is not null")
            .unionByName(spread)
            .withColumn("nth", F.row_number().over(last))
            .where("nth = 1")
        )
        gone = held.join(now.select("doc_id", "tokenizer"), ["doc_id", "tokenizer"], "left_semi").withColumn("sign", F.lit(-1))
        come = now.where("op <> 'delete'").select("doc_id", *GROUP, "n_tokens").withColumn("sign", F.lit(1))
        folder = f"data/{uuid.uuid4().hex}"
        gone.unionByName(come).select("doc_id", *GROUP, "n_tokens", "sign").write.parquet(f"{self.path}/{folder}/rows")
        rows = self.spark.read.schema(DOC + ", sign int").parquet(f"{self.path}/{folder}/rows")
        sums = rows.groupBy(*GROUP).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
        sums.write.parquet(f"{self.path}/{folder}/sums")
        return self._publish(batch_id, folder)

    def _publish(self, batch_id: str, folder: str) -> bool:
        """Rename a marker into place. Committers of one ledger take turns; a repeated one finds the id taken."""
        root = f"{self.path}/commits"
        self._fs.mkdirs(self._fs_path(root))
        if batch_id in self.batches():
            return False
        temp = self._fs_path(f"{root}/.{uuid.uuid4().hex}")
        self._fs.create(temp, False).close()
        return self._fs.rename(temp, self._fs_path(f"{root}/{batch_id}@{folder.replace('/', '=')}"))
