import os
import subprocess
import sys

RUN = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {tmp!r}).getOrCreate()
import corpus_pipeline, __spark_entry__ as entry
for name in ("op5_quality", "op9_language", "op8_decontaminate"):
    assert entry.queries()[name](spark, {sf!r}).count() > 0
docs = spark.read.parquet({sf!r} + "/documents.parquet")
assert corpus_pipeline.STAGES[0][1](spark, docs, {sf!r}).count() > 0
print("all ran")
"""


def test_workers_need_no_copy_of_the_repository(sf, tmp_path):
    """The repository is on the driver's path only; workers start in another folder."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYTHONSTARTUP")}
    code = RUN.format(repo=repo, tmp=f"file://{tmp_path}", sf=sf)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "all ran" in done.stdout, done.stderr[-2000:]
