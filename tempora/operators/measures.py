"""Measurements turned into plans: levels, loudness, voice and picture corrections, rhythm. Decibels are tenths of one as integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def envelope(samples: DataFrame, hop: int) -> DataFrame:
    """(stream_id, hop_no, rms): root mean square of samples (stream_id, pos, value) on a grid."""
    return samples.groupBy("stream_id", F.floor(F.col("pos") / hop).alias("hop_no")).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))


def silent_tracks(samples: DataFrame, peak: float = 0.001) -> DataFrame:
    """Streams whose peak stays below -60 dBFS."""
    return samples.groupBy("stream_id").agg(F.max(F.abs("value")).alias("peak")).where(F.col("peak") < peak)


def speech_mask(levels: DataFrame, least_frames: int = 3) -> DataFrame:
    """(stream_id, frame_no, level_db10, voiced) of levels: louder than the p10 floor by 8 dB or a fifth of the range to p95, in runs of three frames; nothing in streams with
    under 10 dB of range."""
    edges = levels.groupBy("stream_id").agg(F.percentile("level_db10", 0.1).alias("floor"), F.percentile("level_db10", 0.95).alias("top"))
    span = F.col("top") - F.col("floor")
    loud = (span >= 100) & (F.col("level_db10") > F.col("floor") + F.greatest(F.lit(80.0), span / 5))
    order = Window.partitionBy("stream_id").orderBy("frame_no")
    df = levels.join(edges, "stream_id").withColumn("loud", loud)
    change = F.coalesce((F.col("loud") != F.lag("loud").over(order)).cast("int"), F.lit(0))
    runs = df.withColumn("_c", change).withColumn("run", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.count("*").over(Window.partitionBy("stream_id", "run"))
    return runs.withColumn("voiced", F.col("loud") & (n >= least_frames)).select("stream_id", "frame_no", "level_db10", "voiced")


def quiet_spans(mask: DataFrame, least_frames: int = 30) -> DataFrame:
    """(stream_id, first_frame, n_frames): unvoiced runs of `least_frames` or more."""
    order = Window.partitionBy("stream_id").orderBy("frame_no")
    change = F.coalesce((F.col("voiced") != F.lag("voiced").over(order)).cast("int"), F.lit(0))
    runs = mask.withColumn("_c", change).withColumn("run", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.where("not voiced").groupBy("stream_id", "run").agg(F.min("frame_no").alias("first_frame"), F.count("*").alias("n_frames")).where(F.col("n_frames") >= least_frames).drop("run")


def plan_levels(measured: DataFrame) -> DataFrame:
    """(edit_id, source_id, gain_db10): to the mean level weighted by seconds heard, 6 dB at most, none under 0.5 dB; edits with one recording stay.

    measured: (edit_id, source_id, level_db10, seconds).
    """
    per = measured.groupBy("edit_id").agg(F.count("*").alias("n"), F.sum("seconds").alias("total"), F.sum(F.col("level_db10") * F.col("seconds")).alias("weighted"))
    gain = F.greatest(F.lit(-60), F.least(F.lit(60), F.floor(F.col("weighted") / F.col("total")) - F.col("level_db10")))
    return measured.join(per, "edit_id").where("n > 1 and total > 0").withColumn("gain_db10", gain.cast("long")).where("abs(gain_db10) >= 5").select("edit_id", "source_id", "gain_db10")


def plan_loudness(loudness: DataFrame, target: int = -140, ceiling: int = -15, spread: int = 110) -> DataFrame:
    """loudness (id, input_i10, peak10, lra10, loss10) with mode and gain_db10: skip silent mixes, linear where peak and range fit, else gain into a limiter with up to 3 dB
    of make-up."""
    gain = F.lit(target) - F.col("input_i10")
    linear = (F.col("peak10") + gain <= ceiling) & (F.col("lra10") <= spread)
    mode = F.when(F.col("input_i10") <= -600, "skip").when(linear, "linear").otherwise("limited")
    makeup = F.least(F.lit(30), F.greatest(F.lit(0), F.col("loss10")))
    return loudness.withColumn("mode", mode).withColumn("gain_db10", F.when(F.col("mode") == "linear", gain).when(F.col("mode") == "limited", gain + makeup).cast("long"))


def plan_cleanup(voice: DataFrame) -> DataFrame:
    """A row per source and step (applied, amount): rumble, hum, noise, sibilance, dynamics, clipping (reported only).

    voice: (source_id, low10, hum50_10, hum60_10, floor10, snr10, sibilance10, lra10, peak10).
    """
    hum = F.greatest("hum50_10", "hum60_10")
    steps = {
        "rumble": (F.col("low10") > -150, F.lit(80)),
        "mains hum": ((hum > -180) & (hum >= F.col("low10") - 15), F.when(F.col("hum50_10") >= F.col("hum60_10"), 50).otherwise(60)),
        "broadband noise": ((F.col("floor10") > -550) & (F.col("snr10") < 200), F.least(F.lit(10), F.greatest(F.lit(4), F.bround((200 - F.col("snr10")) / 10.0)))),
        "sibilance": (F.col("sibilance10") > -80, F.lit(15)),
        "dynamics": (F.coalesce(F.col("lra10") > 120, F.lit(False)), F.lit(2)),
        "clipping": (F.lit(False), F.when(F.col("peak10") >= -1, 1).otherwise(0)),
    }
    rows = [F.struct(F.lit(k).alias("step"), a.alias("applied"), F.when(a | F.lit(k == "clipping"), n).otherwise(0).cast("long").alias("amount")) for k, (a, n) in steps.items()]
    return voice.select("source_id", F.explode(F.array(*rows)).alias("s")).select("source_id", "s.*")


def plan_correction(pictures: DataFrame, dark: int = 105) -> DataFrame:
    """pictures (edit_id, source_id, median, spread, bpp_milli, enlargement_pct, cast_milli) with level, lift, contrast, sharpen, denoise, cast flags.

    level is the upper median of the well-lit recordings of the edit, between 120 and 140 (120 without one).
    """
    lit = F.array_sort(F.collect_list(F.when(F.col("median") >= dark, F.col("median"))))
    edit = pictures.groupBy("edit_id").agg(lit.alias("_lit"))
    middle = F.try_element_at("_lit", (F.floor(F.size("_lit") / 2) + 1).cast("int"))
    level = F.coalesce(F.least(F.lit(140), F.greatest(F.lit(120), middle)), F.lit(120))
    return (
        pictures.join(edit.select("edit_id", level.alias("level")), "edit_id")
        .withColumns(
            {
                "lift": F.col("median") < dark,
                "flat": F.col("spread") < 105,
                "sharpen": F.col("enlargement_pct") >= 115,
                "denoise": F.coalesce(F.col("bpp_milli") < 50, F.lit(False)),
                "cast": F.when(F.abs("cast_milli") < 80, "neutral").when(F.col("cast_milli") > 0, "warm").otherwise("cool"),
            }
        )
        .select("edit_id", "source_id", "level", "lift", "flat", "sharpen", "denoise", "cast")
    )


def shot_rhythm(cuts: DataFrame) -> DataFrame:
    """Per source of cuts (source_id, at_us): number, median and quartiles of shot lengths, first cut."""
    shot = F.lead("at_us").over(Window.partitionBy("source_id").orderBy("at_us")) - F.col("at_us")
    return cuts.withColumn("shot", shot).groupBy("source_id").agg(
        F.count("*").alias("n_cuts"), F.min("at_us").alias("first_us"),
        *[F.percentile("shot", p).alias(n) for n, p in (("p25_us", 0.25), ("median_us", 0.5), ("p75_us", 0.75))],
    )


def recommend(rhythm: DataFrame) -> DataFrame:
    """rhythm with energy and target_us: bold under 2 s of median shot, lively under 5 s, else calm; the target is the median between 1 and 10 s.

    Without two cuts there is no shot to measure: calm, 8 s.
    """
    m = F.col("median_us")
    energy = F.when(m.isNull(), "calm").when(m < 2_000_000, "bold").when(m < 5_000_000, "lively").otherwise("calm")
    target = F.when(m.isNull(), 8_000_000.0).otherwise(F.greatest(F.lit(1_000_000.0), F.least(F.lit(10_000_000.0), m)))
    return rhythm.withColumns({"energy": energy, "target_us": target})


def scene_cuts(scores: DataFrame, threshold: Column, least: int) -> DataFrame:
    """(stream_id, frame_no): frames whose score reaches the threshold, at least `least` frames after the frame that reached it before."""
    hit = scores.where(F.col("score") >= threshold)
    gap = F.col("frame_no") - F.coalesce(F.lag("frame_no").over(Window.partitionBy("stream_id").orderBy("frame_no")), F.lit(0))
    return hit.withColumn("gap", gap).where(F.col("gap") >= least).select("stream_id", "frame_no")


def frame_change(frames: DataFrame) -> DataFrame:
    """(stream_id, frame_no, change): mean absolute difference of a frame's vector from the one before; null for the first."""
    before = F.lag("vec").over(Window.partitionBy("stream_id").orderBy("frame_no"))
    total = F.aggregate(F.zip_with("vec", before, lambda a, b: F.abs(a - b)), F.lit(0).cast("long"), lambda s, x: s + x)
    return frames.withColumn("change", (total / F.size("vec")).cast("double")).select("stream_id", "frame_no", "change")


def static_run(changes: DataFrame, still: float) -> DataFrame:
    """(stream_id, longest): the longest run of frames that change by `still` at most."""
    order = Window.partitionBy("stream_id").orderBy("frame_no")
    moving = F.coalesce(F.col("change") > still, F.lit(True)).cast("int")
    runs = changes.withColumn("_m", moving).withColumn("run", F.sum("_m").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("stream_id", "run").agg((F.count("*") - F.max("_m")).alias("n")).groupBy("stream_id").agg(F.max("n").alias("longest"))


def envelope_lag(ref: DataFrame, cand: DataFrame, reach: int, window: int) -> DataFrame:
    """(stream_id, win, lag, r): per window of a reference series (stream_id, pos, value) the shift within `reach` that correlates best, ties to the smaller shift."""
    shifted = cand.select("stream_id", F.col("value").alias("other"), "pos", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("lag")).select(
        "stream_id", "other", "lag", (F.col("pos") - F.col("lag")).alias("pos")
    )
    met = ref.join(shifted, ["stream_id", "pos"])
    r = met.groupBy("stream_id", F.floor(F.col("pos") / window).cast("long").alias("win"), "lag").agg(F.corr("value", "other").alias("r"), F.count("*").alias("n"))
    order = Window.partitionBy("stream_id", "win").orderBy(F.desc(F.round("r", 9)), "lag")
    return r.where("n >= 4 and r is not null").withColumn("nth", F.row_number().over(order)).where("nth = 1").select("stream_id", "win", "lag", F.round("r", 6).alias("r"))


def size_budget(jobs: DataFrame, floor_kbps: int = 400, audio_kbps: int = 128) -> DataFrame:
    """jobs (job_id, limit_bytes, seconds) with video_kbps that fits the limit, not under the floor."""
    fit = F.floor(F.col("limit_bytes") * 8 / 1000 / F.col("seconds")) - audio_kbps
    return jobs.withColumn("video_kbps", F.greatest(F.lit(floor_kbps), fit).cast("long"))


def estimate_render(log: DataFrame, jobs: DataFrame, sample: int = 20) -> DataFrame:
    """(job_id, seconds, samples): the median rate of the last comparable renders, scaled by output seconds and megapixels; null without one.

    log: (renderer, quality, width, height, output_s, elapsed_s, at, render_id); jobs the same with job_id. Unusable log rows are left out.
    """
    work = F.col("output_s") * F.col("width") * F.col("height") / 1_000_000.0
    usable = log.where("output_s > 0 and elapsed_s > 0 and width > 0 and height > 0 and renderer is not null and quality is not null")
    order = Window.partitionBy("renderer", "quality").orderBy(F.desc("at"), F.desc("render_id"))
    rates = usable.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= sample).withColumn("rate", F.col("elapsed_s") / work)
    per = rates.groupBy("renderer", "quality").agg(F.percentile("rate", 0.5).alias("rate"), F.count("*").alias("samples"))
    return jobs.join(per, ["renderer", "quality"], "left").select("job_id", F.round(F.col("rate") * work, 6).alias("seconds"), F.coalesce("samples", F.lit(0)).alias("samples"))
