"""Streams in several micro-batches: silences past the watermark, lost words, words out of order; results equal the batch operators'."""

import time

import pytest
from pyspark.sql import functions as F

from tempora.operators import speech
from tempora.streaming import streams as S


def played(spark, tmp_path, batches, operator):
    """What operator gives when each of batches [(source_id, idx, second)] arrives in a trigger of its own."""
    folder = str(tmp_path / "in")
    for rows in batches:
        table(spark, rows).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)  # files are read in order of time
    stream = spark.readStream.schema(S.WORD).option("maxFilesPerTrigger", 1).parquet(folder)
    out, base = str(tmp_path / "out"), str(tmp_path / "state")
    operator(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", base).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def table(spark, rows):
    data = [(s, i, f"w{i}", "a", int(t * 1_000_000), int(t * 1_000_000) + 300_000) for s, i, t in rows]
    df = spark.createDataFrame(data, S.WORD.rsplit(",", 1)[0])
    return df.withColumn("ts", F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("start_us")))


def clock(*seconds):
    """Words of other recordings, which move the watermark."""
    return [(100 + int(t), 0, t) for t in seconds]


#: Recording 1 is silent for ten minutes, recording 2 loses its word 2 and has words out of order, recording 3 is ahead of the watermark all the time.
BATCHES = [
    [(1, 0, 0), (1, 1, 2), (2, 0, 0), (2, 1, 0.4), (2, 4, 9), (3, 0, 0), (3, 1, 60)],
    [(2, 3, 8.5), *clock(300)],
    [(2, 5, 301), *clock(320)],
    [*clock(500)],
    [(1, 2, 600), (1, 3, 603), (3, 2, 600.4), *clock(601)],
    [(1, 5, 606.2), *clock(640)],
    [*clock(650)],
    [(1, 4, 606), (3, 3, 645)],
    [*clock(2000)], [*clock(2100)], [*clock(9000)], [*clock(9100)],
]


@pytest.fixture
def whole(spark):
    words = table(spark, [w for b in BATCHES for w in b])
    # word 4 of recording 1 came after the watermark had passed it
    return words.where("not (source_id = 1 and idx = 4)")


def test_pauses(spark, tmp_path, whole):
    got = {tuple(r) for r in played(spark, tmp_path, BATCHES, S.stream_pauses).where("source_id < 100").collect()}
    rec = whole.groupBy("source_id").agg((F.max("end_us") + 1).alias("duration_us"))
    want = {(r.source_id, r.start_us, r.end_us) for r in speech.find_pauses(whole, rec, 500_000).where("place not in ('lead', 'tail')").collect() if r.source_id < 100}
    assert got == want and (1, 2_300_000, 600_000_000) in got and len(got) > 8


def test_phrases(spark, tmp_path, whole):
    cols = ["source_id", "phrase_idx", "start_us", "end_us", "n_words", "text"]
    got = {tuple(r) for r in played(spark, tmp_path, BATCHES, S.stream_phrases).where("source_id < 100").select(*cols).collect()}
    want = {tuple(r) for r in speech.group_phrases(whole).where("source_id < 100").select(*cols).collect()}
    assert got == want and len(got) > 8
