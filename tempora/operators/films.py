"""Audit of whole rendered films: formats, packets of sound, still endings, black pictures, silent cuts and captions, a row per film and rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .audits import checks, rule, silence_at_cuts

#: A packet of 1,024 samples at 48 kHz, and what its median step and the length of the sound may differ by.
PACKET_US, STEP_US, LENGTH_US = 21_333, 2_000, 43_667
#: The ending looked at, the stillness it may have, the slack of approved spans, and a change too small to see (hundredths of a grey level).
ENDING_US, HOLD_US, SLACK_US, SAME = 10_000_000, 1_000_000, 300_000, 50


def packet_facts(packets: DataFrame) -> DataFrame:
    """(edit_id, n_packets, monotonic, median_us, sound_us) of packets (edit_id, pos, pts_us, dur_us); packets without a time don't count.

    The median is over rising steps only. The sound reaches from the first packet, where that lies before zero, or zero to the latest end.
    """
    order = Window.partitionBy("edit_id").orderBy("pos", "pts_us")
    timed = packets.where("pts_us is not null").withColumn("step", F.col("pts_us") - F.lag("pts_us").over(order))
    return timed.groupBy("edit_id").agg(
        F.count("*").alias("n_packets"), ((F.count("*") > 1) & F.coalesce(F.bool_and(F.col("step") > 0), F.lit(False))).alias("monotonic"),
        F.coalesce(F.floor(F.percentile(F.when(F.col("step") > 0, F.col("step")), 0.5)), F.lit(0)).alias("median_us"),
        (F.max(F.col("pts_us") + F.coalesce("dur_us", F.lit(0))) - F.least(F.lit(0), F.min(F.when(F.col("step").isNull(), F.col("pts_us"))))).alias("sound_us"),
    )


def longest_hold(samples: DataFrame, films: DataFrame) -> DataFrame:
    """(edit_id, hold_start, hold_end): the longest run of unchanged pictures among the samples (edit_id, at_us, change) of a film's last ten seconds, the first of equals.

    change is the mean difference to the sample before, in hundredths of a grey level. A run that reaches the last sample lasts to the end of the film (films: edit_id, container_us). Films without such a run have no row.
    """
    order = Window.partitionBy("edit_id").orderBy("at_us")
    late = samples.join(films.select("edit_id", "container_us"), "edit_id").where(F.col("at_us") >= F.greatest(F.lit(0), F.col("container_us") - ENDING_US))
    seen = late.withColumns({"prev": F.lag("at_us").over(order), "next": F.lead("at_us").over(order)})
    same = F.coalesce(F.col("change") <= SAME, F.lit(False)) & F.col("prev").isNotNull()
    runs = seen.withColumn("same", same).withColumn("run", F.sum(F.when(F.col("same"), 0).otherwise(1)).over(order)).where("same")
    end = F.when(F.col("next").isNull(), F.col("container_us")).otherwise(F.col("at_us"))
    each = runs.withColumn("end", end).groupBy("edit_id", "run").agg(F.min("prev").alias("s"), F.max("end").alias("e"), F.count("*").alias("n"))
    best = F.max_by(F.struct("s", "e"), F.struct(F.col("n"), -F.col("s")))
    return each.groupBy("edit_id").agg(best.alias("b")).select("edit_id", F.col("b.s").alias("hold_start"), F.col("b.e").alias("hold_end"))


def unapproved(holds: DataFrame, approved: DataFrame) -> DataFrame:
    """Holds that no approved span (edit_id, a_start, a_end) contains within 0.3 s: an anti join, as spans of one film are a few."""
    inside = (F.col("hold_start") >= F.col("a_start") - SLACK_US) & (F.col("hold_end") <= F.col("a_end") + SLACK_US)
    a = approved.select(F.col("edit_id").alias("_e"), "a_start", "a_end")
    return holds.join(a, (F.col("edit_id") == F.col("_e")) & inside, "left_anti")


def film_audit(
    films: DataFrame, packets: DataFrame, samples: DataFrame, approved: DataFrame, black: DataFrame, cuts: DataFrame, quiet: DataFrame, cues: DataFrame
) -> DataFrame:
    """(edit_id, check, severity, passed, measured): a row per film and rule.

    films: (edit_id, codec, pixels, rate and nominal in frames a 1,000 s, sound, sample_rate, channels, video_us, container_us); black: (edit_id, b_start, b_end); cuts: (edit_id, at_us); quiet: (edit_id, q_start, q_end);
    cues: (edit_id, c_start, c_end); the others as their functions state. Films without packets fail the rules about them; without black spans, cuts or cues they pass those rules, but captions must be there.
    Repeated rows of spans and cuts change nothing but counts; a repeated cue overlaps itself. Rows about films that aren't listed are left out.
    """
    one = films.dropDuplicates(["edit_id"])
    ends = one.select("edit_id", "container_us")
    hold = unapproved(longest_hold(samples, ends), approved).select("edit_id", (F.col("hold_end") - F.col("hold_start")).alias("hold"))
    inner = (F.col("b_start") > 250_000) & (F.col("b_end") < F.greatest(F.lit(0), F.col("container_us") - 250_000))
    dark = black.join(ends, "edit_id").groupBy("edit_id").agg(F.count_if(inner).alias("n_black"), F.max(F.when((F.col("b_start") <= 50_000) & (F.col("b_end") >= 250_000), F.col("b_end"))).alias("opening"))
    silent = silence_at_cuts(cuts.distinct(), quiet).groupBy("edit_id").agg(F.count_if("silent").alias("n_silent"))
    before = F.max("c_end").over(Window.partitionBy("edit_id").orderBy("c_start", "c_end").rowsBetween(Window.unboundedPreceding, -1))
    shown = cues.withColumn("before", before).join(ends, "edit_id").groupBy("edit_id").agg(
        F.count("*").alias("n_cues"), F.count_if(F.col("c_start") < F.col("before")).alias("n_overlap"), F.count_if(F.col("c_start") > F.col("container_us") + 50_000).alias("n_past")
    )
    df = one
    for part in (packet_facts(packets), hold, dark, silent, shown):
        df = df.join(part, "edit_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    steady = F.abs(F.col("rate") - F.col("nominal")) * 10_000 <= F.greatest(F.lit(10_000), F.col("nominal"))
    apart = F.greatest(F.abs(n("sound_us") - F.col("video_us")), F.abs(n("sound_us") - F.col("container_us")))
    given = lambda ok: F.coalesce(ok, F.lit(False))
    return checks(
        df, ["edit_id"],
        [
            rule("constant rate", "error", given(steady), F.col("rate")), rule("picture codec", "error", given((F.col("codec") == "h264") & (F.col("pixels") == "yuv420p")), F.lit(None)),
            rule("sound format", "error", given((F.col("sound") == "aac") & (F.col("sample_rate") == 48_000) & (F.col("channels") == 2)), F.col("sample_rate")),
            rule("packets rise", "error", given(F.col("monotonic")), n("n_packets")), rule("packet step", "error", F.abs(n("median_us") - PACKET_US) <= STEP_US, n("median_us")),
            rule("sound length", "error", given(apart <= LENGTH_US), n("sound_us")), rule("ending moves", "error", n("hold") <= HOLD_US, n("hold")), rule("no black inside", "warning", n("n_black") == 0, n("n_black")),
            rule("opens on an image", "warning", F.col("opening").isNull(), n("opening")), rule("cuts carry sound", "warning", n("n_silent") == 0, n("n_silent")), rule("captions present", "error", n("n_cues") > 0, n("n_cues")),
            rule("captions apart", "warning", n("n_overlap") == 0, n("n_overlap")), rule("captions inside", "warning", n("n_past") == 0, n("n_past")),
        ],
    )
