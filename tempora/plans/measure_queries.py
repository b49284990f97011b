"""Queries over measurements, with their oracles. Readings come from the supplier, part, order and embedding tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import SEGMENTS_CTE, scaled, segments, table
from ..operators import measures as M
from ..registry import query

# streams are stretches of a label's vectors; frames by vec_id; samples are the components
SAMPLES = SEGMENTS_CTE + """,
fr as (select source_id as stream_id, vec_id, embedding, row_number() over (partition by source_id order by vec_id) - 1 as frame_no from segments),
samples as (select stream_id, frame_no * 64 + generate_subscripts(embedding, 1) - 1 as pos, unnest(embedding)::double as value from fr),
levels as (select stream_id, frame_no, floor(embedding[1] * 1000)::bigint - 400 as level_db10 from fr)"""


def _frames(spark, sf_dir):
    from pyspark.sql import Window

    e = segments(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("source_id").orderBy("vec_id")) - 1
    return e.select(F.col("source_id").alias("stream_id"), n.cast("long").alias("frame_no"), "embedding")


def _samples(spark, sf_dir):
    f = _frames(spark, sf_dir).select("stream_id", "frame_no", F.posexplode("embedding").alias("k", "v"))
    return f.select("stream_id", (F.col("frame_no") * 64 + F.col("k")).alias("pos"), F.col("v").cast("double").alias("value"))


def _levels(spark, sf_dir):
    return _frames(spark, sf_dir).select("stream_id", "frame_no", (scaled(F.col("embedding")[0]) - 400).alias("level_db10"))


@query("with " + SAMPLES + " select stream_id, pos // 100 as hop_no, round(sqrt(avg(value * value)), 6) as rms from samples group by all")
def envelope(spark, sf_dir):
    return M.envelope(_samples(spark, sf_dir), 100).withColumn("rms", F.round("rms", 6))


@query("with " + SAMPLES + " select stream_id, max(abs(value)) as peak from samples group by all having max(abs(value)) < 0.45")
def silent_tracks(spark, sf_dir):
    return M.silent_tracks(_samples(spark, sf_dir), 0.45)


def _mask(levels, least):
    """CTEs up to mask: the levels of a table that are voiced, in runs of `least` frames."""
    return f""", ed as (select stream_id, quantile_cont(level_db10, 0.1) as fl, quantile_cont(level_db10, 0.95) as tp from {levels} group by all),
ld as (select l.*, tp - fl >= 100 and level_db10 > fl + greatest(80.0, (tp - fl) / 5) as loud from {levels} l join ed using (stream_id)),
rn as (select *, sum(c) over (partition by stream_id order by frame_no) as run from (select *, case when loud <> lag(loud) over (partition by stream_id order by frame_no) then 1 else 0 end as c from ld)),
mask as (select stream_id, frame_no, level_db10, loud and count(*) over (partition by stream_id, run) >= {least} as voiced from rn)"""


MASK = SAMPLES + _mask("levels", 1)


@query("with " + SAMPLES + """,
every as (select stream_id, frame_no * 64 + generate_subscripts(embedding, 1) - 1 as frame_no, floor(unnest(embedding) * 1000)::bigint - 400 as level_db10 from fr)""" + _mask("every", 3) + " select * from mask")
def speech_mask(spark, sf_dir):
    """Every component is the level of a frame; voice comes in runs of three."""
    f = _frames(spark, sf_dir).select("stream_id", "frame_no", F.posexplode("embedding").alias("k", "v"))
    return M.speech_mask(f.select("stream_id", (F.col("frame_no") * 64 + F.col("k")).alias("frame_no"), (scaled(F.col("v")) - 400).alias("level_db10")))


@query("with " + MASK + """, q as (select *, sum(c) over (partition by stream_id order by frame_no) as r2 from (select *, case when voiced <> lag(voiced) over (partition by stream_id order by frame_no) then 1 else 0 end as c from mask))
  select stream_id, min(frame_no) as first_frame, count(*) as n_frames from q where not voiced group by stream_id, r2 having count(*) >= 2""")
def quiet_spans(spark, sf_dir):
    return M.quiet_spans(M.speech_mask(_levels(spark, sf_dir), 1), 2)


LEVELS = """m as (select l_orderkey as edit_id, l_suppkey as source_id, (-300 + l_suppkey % 150)::bigint as level_db10, sum(l_quantity)::bigint as seconds from lineitem group by all)"""


@query("with " + LEVELS + """, p as (select edit_id, count(*) as n, sum(seconds) as total, sum(level_db10 * seconds) as wt from m group by all),
  g as (select m.*, greatest(-60, least(60, floor(wt / total)::bigint - level_db10)) as gain_db10 from m join p using (edit_id) where n > 1 and total > 0)
  select edit_id, source_id, gain_db10 from g where abs(gain_db10) >= 5""")
def plan_levels(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    m = li.groupBy(F.col("l_orderkey").alias("edit_id"), F.col("l_suppkey").alias("source_id")).agg(F.sum("l_quantity").cast("long").alias("seconds"))
    return M.plan_levels(m.withColumn("level_db10", -300 + F.col("source_id") % 150))


@query("""with l as (select p_partkey as id, -(p_partkey % 640)::bigint as input_i10, -(p_size)::bigint as peak10, (p_partkey % 160)::bigint as lra10, (p_size - 10)::bigint as loss10 from part),
  m as (select *, case when input_i10 <= -600 then 'skip' when peak10 - 140 - input_i10 <= -15 and lra10 <= 110 then 'linear' else 'limited' end as mode from l)
  select id, mode, case mode when 'linear' then -140 - input_i10 when 'limited' then -140 - input_i10 + least(30, greatest(0, loss10)) end as gain_db10 from m""")
def plan_loudness(spark, sf_dir):
    k = F.col("p_partkey")
    l = table(spark, sf_dir, "part").select(k.alias("id"), (-(k % 640)).alias("input_i10"), (-F.col("p_size")).alias("peak10"), (k % 160).alias("lra10"), (F.col("p_size") - 10).alias("loss10"))  # noqa: E741
    return M.plan_loudness(l).select("id", "mode", "gain_db10")


@query("""with v as (select p_partkey as source_id, -(p_partkey % 300) as low10, -(p_partkey % 370) as h50, -(p_partkey % 230) as h60, -(p_partkey % 700) as floor10,
    (p_partkey % 310) as snr10, -(p_partkey % 170) as sib10, case when p_partkey % 5 <> 0 then p_partkey % 190 end as lra10, -(p_partkey % 7) as peak10 from part),
  s as (
    select source_id, 'rumble' as step, low10 > -150 as applied, 80 as n from v
    union all select source_id, 'mains hum', greatest(h50, h60) > -180 and greatest(h50, h60) >= low10 - 15, case when h50 >= h60 then 50 else 60 end from v
    union all select source_id, 'broadband noise', floor10 > -550 and snr10 < 200, least(10, greatest(4, round_even((200 - snr10) / 10.0::double, 0)))::integer from v
    union all select source_id, 'sibilance', sib10 > -80, 15 from v union all select source_id, 'dynamics', coalesce(lra10 > 120, false), 2 from v)
  select source_id, step, applied, (case when applied then n else 0 end)::bigint as amount from s
  union all select source_id, 'clipping', false, case when peak10 >= -1 then 1 else 0 end from v""")
def plan_cleanup(spark, sf_dir):
    k = F.col("p_partkey")
    neg = {"low10": 300, "hum50_10": 370, "hum60_10": 230, "floor10": 700, "sibilance10": 170, "peak10": 7}
    v = table(spark, sf_dir, "part").select(
        k.alias("source_id"), *[(-(k % n)).alias(c) for c, n in neg.items()], (k % 310).alias("snr10"), F.when(k % 5 != 0, k % 190).alias("lra10")
    )
    return M.plan_cleanup(v)


@query("""with p as (select p_partkey % 97 as edit_id, p_partkey as source_id, (60 + p_partkey % 120)::integer as median, 60 + p_size * 2 as spread,
    case when p_size % 4 <> 0 then p_size * 3 end as bpp, (90 + p_partkey % 61)::integer as enl, (p_partkey % 201 - 100)::integer as ca from part),
  e as (select edit_id, list_sort(list(median) filter (median >= 105)) as lit from p group by all)
  select p.edit_id, source_id, coalesce(least(140, greatest(120, lit[len(lit) // 2 + 1])), 120) as level, median < 105 as lift, spread < 105 as flat, enl >= 115 as sharpen,
    coalesce(bpp < 50, false) as denoise, case when abs(ca) < 80 then 'neutral' when ca > 0 then 'warm' else 'cool' end as cast from p join e using (edit_id)""")
def plan_correction(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(
        (k % 97).alias("edit_id"), k.alias("source_id"), (60 + k % 120).cast("int").alias("median"), (60 + F.col("p_size") * 2).alias("spread"),
        F.when(F.col("p_size") % 4 != 0, F.col("p_size") * 3).alias("bpp_milli"), (90 + k % 61).cast("int").alias("enlargement_pct"), (k % 201 - 100).cast("int").alias("cast_milli"),
    )
    return M.plan_correction(p)


RHYTHM = """c as (select user_id as source_id, epoch_us(ts) - epoch_us(timestamp '2024-01-01') as at_us from events),
s as (select *, lead(at_us) over (partition by source_id order by at_us) - at_us as shot from c),
rhythm as (select source_id, count(*) as n_cuts, min(at_us) as first_us, quantile_cont(shot, 0.25)::double as p25_us, quantile_cont(shot, 0.5)::double as median_us, quantile_cont(shot, 0.75)::double as p75_us from s group by all)"""


def _cuts(spark, sf_dir):
    origin = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), (F.unix_micros(F.col("ts").cast("timestamp")) - origin).alias("at_us"))


@query("with " + RHYTHM + """ select source_id, n_cuts, first_us, round(p25_us, 3) as p25_us, round(median_us, 3) as median_us, round(p75_us, 3) as p75_us,
  case when median_us is null then 'calm' when median_us < 2000000 then 'bold' when median_us < 5000000 then 'lively' else 'calm' end as energy,
  case when median_us is null then 8000000.0::double else greatest(1000000.0::double, least(10000000.0::double, median_us)) end as target_us from rhythm""")
def shot_rhythm(spark, sf_dir):
    got = M.recommend(M.shot_rhythm(_cuts(spark, sf_dir)))
    return got.withColumns({c: F.round(c, 3) for c in ("p25_us", "median_us", "p75_us")})


VEC = """v as (select stream_id, frame_no, list_transform(embedding, lambda x: floor(x * 1000)::bigint) as vec from fr),
ch as (
  select stream_id, frame_no, case when pv is null then null else list_sum(list_transform(list_zip(vec, pv), lambda z: abs(z[1] - z[2])))::bigint / 64.0::double end as change
  from (select *, lag(vec) over (partition by stream_id order by frame_no) as pv from v))"""


def _changes(spark, sf_dir):
    return M.frame_change(_frames(spark, sf_dir).withColumn("vec", F.transform("embedding", lambda x: scaled(x))))


@query("with " + SAMPLES + "," + VEC + " select * from ch")
def frame_change(spark, sf_dir):
    return _changes(spark, sf_dir)


@query("with " + SAMPLES + "," + VEC + """, m as (select *, case when coalesce(change > 130, true) then 1 else 0 end as mv from ch), r as (select *, sum(mv) over (partition by stream_id order by frame_no) as run from m)
  select stream_id, max(n) as longest from (select stream_id, run, count(*) - max(mv) as n from r group by all) group by all""")
def static_run(spark, sf_dir):
    return M.static_run(_changes(spark, sf_dir), 130)


@query("with " + SAMPLES + "," + VEC + """, h as (select *, frame_no - coalesce(lag(frame_no) over (partition by stream_id order by frame_no), 0) as gap from ch where change >= 145)
  select stream_id, frame_no from h where gap >= 2""")
def scene_cuts(spark, sf_dir):
    return M.scene_cuts(_changes(spark, sf_dir).withColumnRenamed("change", "score"), F.lit(145), 2)


@query("with " + SAMPLES + """, m as (select a.stream_id, a.pos // 640 as win, lag, corr(a.value, b.value) as r, count(*) as n from samples a, unnest(range(-4, 5)) as g(lag), samples b
    where b.stream_id = a.stream_id and b.pos + 2 = a.pos + lag group by all)
  select stream_id, win, lag::integer as lag, round(r, 6) as r from (select *, row_number() over (partition by stream_id, win order by round(r, 9) desc, lag) as nth from m where n >= 4 and r is not null and not isnan(r)) where nth = 1""")
def envelope_lag(spark, sf_dir):
    """Each stream against itself, two samples later."""
    s = _samples(spark, sf_dir)
    return M.envelope_lag(s, s.withColumn("pos", F.col("pos") + 2), 4, 640)


@query("select o_orderkey as job_id, greatest(400, floor((o_totalprice * 100)::bigint * 8 / 1000 / (10 + o_custkey % 300))::bigint - 128) as video_kbps from orders")
def size_budget(spark, sf_dir):
    j = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), (F.col("o_totalprice") * 100).cast("long").alias("limit_bytes"), (10 + F.col("o_custkey") % 300).alias("seconds"))
    return M.size_budget(j).select("job_id", "video_kbps")


RENDERS = """lg as (select o_orderkey as render_id, o_orderpriority as renderer, o_orderstatus as quality, 640 + o_custkey % 4 * 320 as width, 480 as height,
  (o_custkey % 90)::double as output_s, o_totalprice / 1000 as elapsed_s, o_orderdate as made from orders)"""


@query("with " + RENDERS + """, u as (select *, elapsed_s / (output_s * width * height / 1000000.0::double) as rate, row_number() over (partition by renderer, quality order by made desc, render_id desc) as nth from lg where output_s > 0 and elapsed_s > 0),
  p as (select renderer, quality, quantile_cont(rate, 0.5) as rate, count(*) as samples from u where nth <= 20 group by all)
  select render_id as job_id, round(p.rate * (output_s * width * height / 1000000.0::double), 6) as seconds, coalesce(samples, 0) as samples from lg left join p using (renderer, quality)""")
def estimate_render(spark, sf_dir):
    lg = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("render_id"), F.col("o_orderpriority").alias("renderer"), F.col("o_orderstatus").alias("quality"), (640 + F.col("o_custkey") % 4 * 320).alias("width"),
        F.lit(480).alias("height"), (F.col("o_custkey") % 90).cast("double").alias("output_s"), (F.col("o_totalprice") / 1000).alias("elapsed_s"), F.col("o_orderdate").alias("at"),
    )
    return M.estimate_render(lg, lg.withColumnRenamed("render_id", "job_id"))
