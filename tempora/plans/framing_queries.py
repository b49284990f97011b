"""Queries over faces, effects, clips and the larger audits, with oracles where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import RECORDINGS_CTE, SEGMENTS_CTE, WORDS_CTE, recordings, scaled, segments, table, turns, words
from ..operators import accents as A
from ..operators import audits as Q
from ..operators import framing as G
from ..operators import speech as P
from ..registry import query
from .audit_queries import MOVES, _common, _moves
from .measure_queries import SAMPLES, _frames
from .speech_queries import SENTENCES
from .timeline_queries import CUES, R, _cues, _line


def _faces(spark, sf_dir):
    """Eight faces per sample, each placed by eight components; samples are numbered within a recording."""
    from pyspark.sql import Window

    e = segments(spark, sf_dir).withColumn("sample_idx", F.row_number().over(Window.partitionBy("source_id").orderBy("vec_id")).cast("long"))
    v = F.transform("embedding", lambda x: scaled(x))
    each = e.select("source_id", "sample_idx", v.alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("face_idx"))
    at = lambda k: F.col("v")[(8 * F.col("face_idx") + k).cast("int")]
    return each.select(
        "source_id", "sample_idx", "face_idx", (at(0) + at(1) + at(2) + 300 * F.col("face_idx")).alias("x"), F.floor((at(3) + at(4) + at(5)) / 4).cast("long").alias("y"), (120 + F.abs(F.floor((at(6) + at(7)) / 10))).cast("long").alias("w"),
    )


@query()
def track_faces(spark, sf_dir):
    return G.track_faces(_faces(spark, sf_dir))


FACES = SEGMENTS_CTE + """, fv as (select source_id, row_number() over (partition by source_id order by vec_id) as sample_idx, list_transform(embedding, lambda x: floor(x * 1000)::bigint) as v from segments),
faces as (select source_id, sample_idx, k as face_idx, v[8 * k + 1] + v[8 * k + 2] + v[8 * k + 3] + 300 * k as x from fv, unnest(range(8)) as g(k))"""


@query("with " + FACES + """, p as (select source_id, face_idx as track_id, count(*) as seen, quantile_cont(x, 0.5) as x from faces where x % 3 <> face_idx % 4 group by all),
  n as (select source_id, count(distinct sample_idx) as samples from faces where x % 3 <> face_idx % 4 group by all),
  b as (select *, row_number() over (partition by source_id order by seen desc, track_id) as nth from p join n using (source_id) where seen * 10 >= samples * 3), c as (select *, count(*) over (partition by source_id) as k from b where nth <= 2)
  select source_id, row_number() over (partition by source_id order by x, track_id)::integer as pane, track_id::integer as track_id, x from c where k = 2""")
def split_panes(spark, sf_dir):
    """Faces stand for tracks; each is missing from about a third of the samples."""
    f = _faces(spark, sf_dir).where(F.col("x") % 3 != F.col("face_idx") % 4)
    return G.split_panes(f.withColumn("track_id", F.col("face_idx").cast("int")))


@query()
def assign_speakers(spark, sf_dir):
    """Words stand for samples: two tracks, one moving with the user's words, one with their lengths."""
    w = words(spark, sf_dir)
    user = (F.col("speaker") == "user").cast("int")
    m = w.select("source_id", F.col("start_us").alias("at_us"), F.explode(F.array(F.struct(F.lit(0).alias("t"), (user * 5 + F.length("word") % 4).alias("m")), F.struct(F.lit(1).alias("t"), F.length("word").alias("m")))).alias("s"))
    return G.assign_speakers(m.select("source_id", F.col("s.t").alias("track_id"), "at_us", F.col("s.m").cast("double").alias("motion")), turns(w))


@query("with recursive " + WORDS_CTE + "," + RECORDINGS_CTE + "," + SENTENCES + """, e as (
    select source_id, duration_us, case source_id % 3 when 0 then [] when 1 then ['frame_in_frame', 'tilt', 'split_mirror'] else ['frame_in_frame', 'speed_lines', 'triptych', 'bw_flash', 'tilt', 'device_frame'] end as kinds,
      (case source_id % 3 when 0 then 0 when 1 then 2 else 4 end * greatest(duration_us, 1000000)) // 30000000 as most from recordings
  ), s as (select source_id, start_us, kinds, most from sentences join e using (source_id) where sentence_idx > 0 and start_us + 1200000 <= duration_us), r as (
    select source_id, 0 as n, min(start_us) as at_us, true as sure from s where most > 0 group by 1
    union all select r.source_id, r.n + 1, min(s.start_us), min(s.start_us) - r.at_us <= 10000000 from r join s on s.source_id = r.source_id and s.start_us - r.at_us >= 6000000 and r.n + 1 < s.most group by r.source_id, r.n, r.at_us
  ) select source_id, at_us, kinds[n % len(kinds) + 1] as effect, sure from r join e using (source_id)""")
def effects(spark, sf_dir):
    w = words(spark, sf_dir)
    e = F.element_at(F.array(F.lit("calm"), F.lit("lively"), F.lit("bold")), (F.col("source_id") % 3 + 1).cast("int"))
    return G.effects(P.sentences(w), recordings(w).select("source_id", e.alias("energy"), "duration_us"))


@query()
def find_broll(spark, sf_dir):
    """Clips named after the 60 most frequent words, over the recordings themselves."""
    from pyspark.sql import Window

    w = words(spark, sf_dir)
    tags = _common(w, 60).withColumn("clip_id", F.row_number().over(Window.orderBy("key")).cast("long"))
    hit = A.stem_match(w, tags.select(F.col("key").alias("tag"))).join(tags.withColumnRenamed("key", "tag"), "tag").join(w.select("source_id", "idx", "start_us"), ["source_id", "idx"])
    m = hit.select(F.col("source_id").alias("edit_id"), "idx", F.col("start_us").alias("at_us"), "clip_id", (F.col("key") == F.col("tag")).alias("exact"), (F.col("clip_id") * 200_000).alias("clip_us"))
    return G.find_broll(m, recordings(w).select(F.col("source_id").alias("edit_id"), F.col("duration_us").alias("total_us")), density_pct=40)


@query("with recursive " + SAMPLES + """, u as (select stream_id, frame_no, list_transform(embedding, lambda x: ln(1 + abs(x::double))) as v, lag(list_transform(embedding, lambda x: ln(1 + abs(x::double)))) over (partition by stream_id order by frame_no) as w from fr),
  x as (select stream_id, frame_no, round(list_sum(list_transform(list_zip(v, w), lambda z: greatest(0.0, z[1] - z[2]))), 9) as flux from u where w is not null),
  m as (select *, avg(flux) over (o rows between 8 preceding and 8 following) as local, stddev_pop(flux) over (partition by stream_id) as spread, lag(flux) over o as b, lead(flux) over o as a from x window o as (partition by stream_id order by frame_no)),
  p as (select stream_id, frame_no from m where flux >= a and flux >= b and flux > local + 0.5 * spread),
  r as (select stream_id, min(frame_no) as frame_no from p group by 1 union all select r.stream_id, min(p.frame_no) from r join p on p.stream_id = r.stream_id and p.frame_no >= r.frame_no + 4 group by r.stream_id, r.frame_no)
  select stream_id, frame_no from r""")
def onsets(spark, sf_dir):
    f = _frames(spark, sf_dir).withColumn("stream_id", F.col("stream_id").cast("long"))
    return G.onsets(f.withColumnRenamed("embedding", "vec"))


@query("with " + SAMPLES + """, v as (select stream_id, frame_no, list_transform(embedding, lambda x: floor(x * 1000)::bigint) as vec from fr), c as (select stream_id, frame_no - s as frame_no, vec as other, s as shift from (select *, unnest(range(-3, 4)) as s from (select stream_id, frame_no + 2 as frame_no, vec from v))),
  m as (select stream_id, shift, floor(sum(list_sum(list_transform(list_zip(vec, other), lambda z: abs(z[1] - z[2]))))::bigint * 1000 / sum(64))::bigint as diff from (select * from v where vec[1] < 200) v join c using (stream_id, frame_no) group by all)
  select stream_id, shift::integer as shift, diff from (select *, row_number() over (partition by stream_id order by diff, abs(shift), shift) as nth from m) where nth = 1""")
def frame_offset(spark, sf_dir):
    """Each stream against itself, two frames later; frames with a large first component are busy."""
    f = _frames(spark, sf_dir).select("stream_id", "frame_no", F.transform("embedding", lambda x: scaled(x)).alias("vec"))
    return G.frame_offset(f, f.withColumn("frame_no", F.col("frame_no") + 2), f.where(F.col("vec")[0] >= 200).select("stream_id", "frame_no"))


@query("""with r as (select o_orderkey as id, o_custkey % 3 as s, case o_custkey % 4 when 0 then 30 when 1 then 30000 when 2 then 25 else 29 end as num, case o_custkey % 4 when 1 then 1001 else 1 end as den, 720 + o_custkey % 3 as w, 1280 as h,
    (o_totalprice * 100)::bigint as p, (o_totalprice * 100)::bigint + o_custkey % 91 * 1000 as m, (o_totalprice * 100)::bigint + o_custkey % 220 * 1000 as a, -(o_custkey % 700) as pk, o_custkey % 400 * 1000 as b, o_custkey * 900 as c from orders)
  select id as edit_id, unnest(['picture stream', 'frame rate', 'even size', 'duration', 'sound length', 'peak', 'audible', 'opening black', 'first cue']) as "check",
    unnest(['error', 'warning', 'error', 'error', 'error', 'warning', 'error', 'error', 'warning']) as severity,
    unnest([s > 0, den = 1 and num in (24, 25, 30, 50, 60) or den = 1001 and num in (24000, 30000, 60000), w % 2 = 0 and h % 2 = 0, abs(m - p) <= 45000, abs(a - m) <= 100000, pk <= -5, pk > -600, b < 250000, c <= 1000000]) as passed,
    unnest([s, num, w, abs(m - p), abs(a - m), pk, pk, b, c])::bigint as measured from r""")
def technical_qa(spark, sf_dir):
    k, price = F.col("o_custkey"), F.round(F.col("o_totalprice") * 100).cast("long")
    r = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("edit_id"), (k % 3).alias("streams"), F.when(k % 4 == 0, 30).when(k % 4 == 1, 30000).when(k % 4 == 2, 25).otherwise(29).alias("fps_num"),
        F.when(k % 4 == 1, 1001).otherwise(1).alias("fps_den"), (720 + k % 3).alias("width"), F.lit(1280).alias("height"), price.alias("planned_us"), (price + k % 91 * 1000).alias("measured_us"),
        (price + k % 220 * 1000).alias("audio_us"), (-(k % 700)).alias("peak_db10"), (k % 400 * 1000).alias("black_us"), (k * 900).alias("first_cue_us"),
    )
    return Q.technical_qa(r)


@query(R + "," + MOVES + """, q as (select edit_id, start_us as q0, end_us as q1 from mv where kind = 'punch_in'), b as (select distinct edit_id, output_start as at_us from line)
  select edit_id, at_us, exists (from q where q.edit_id = b.edit_id and q0 <= at_us + 150000 and q1 >= at_us - 150000) as silent from b""")
def silence_at_cuts(spark, sf_dir):
    b = _line(spark, sf_dir).select("edit_id", F.col("output_start").alias("at_us")).distinct()
    return Q.silence_at_cuts(b, _moves(spark, sf_dir).where("kind = 'punch_in'").select("edit_id", F.col("start_us").alias("q_start"), F.col("end_us").alias("q_end")))


@query(CUES + """, el as (select source_id as edit_id, idx as element_id, start_us, end_us + 500000 as end_us, length(word) as chars, idx % 900 as x0, idx % 800 as y0, idx % 900 + 120 as x1, idx % 800 + 90 as y1 from words where word like '%.'),
  cv as (select e.edit_id, e.element_id, count(*) as n from el e join cues c on e.edit_id = c.edit_id and greatest(e.start_us, c.start_us) < least(e.end_us, c.end_us) where y0 < 900 and 700 < y1 group by all),
  p as (select edit_id, count(*) as k from el group by all), d as (select source_id as edit_id, max(end_us) + 1500000 as du from words group by all), x as (select el.*, coalesce(cv.n, 0) as cov, floor(k * 60000000 / greatest(du, 1000000))::bigint as rate from el left join cv using (edit_id, element_id) join p using (edit_id) join d using (edit_id))
  select edit_id, element_id, unnest(['reading time', 'inside the frame', 'clear of captions', 'per minute']) as "check", unnest(['warning', 'error', 'error', 'warning']) as severity,
    unnest([end_us - start_us >= 600000 + floor(chars * 1000000 / 15)::bigint, x0 >= 0 and y0 >= 0 and x1 <= 1000 and y1 <= 1000, cov = 0, rate <= 16]) as passed, unnest([end_us - start_us, x1, cov, rate])::bigint as measured from x""")
def motion_qa(spark, sf_dir):
    w = words(spark, sf_dir)
    i = F.col("idx")
    el = w.where(F.col("word").endswith(".")).select(
        F.col("source_id").alias("edit_id"), i.alias("element_id"), F.lit("label").alias("kind"), "start_us", (F.col("end_us") + 500_000).alias("end_us"), F.length("word").alias("chars"),
        (i % 900).alias("x0"), (i % 800).alias("y0"), (i % 900 + 120).alias("x1"), (i % 800 + 90).alias("y1"),
    )
    c = _cues(spark, sf_dir).select("edit_id", F.col("start_us").alias("c_start"), F.col("end_us").alias("c_end"), F.lit(700).alias("c_y0"), F.lit(900).alias("c_y1"))
    return Q.motion_qa(el, c, recordings(w).select(F.col("source_id").alias("edit_id"), "duration_us"))


@query("with " + MOVES + """, m as (select edit_id, min(case when kind = 'effect' then start_us end) as card, min(case when kind = 'title' then start_us end) as title from mv group by all),
  c as (select o_orderkey as edit_id, (o_custkey * 60)::bigint as cue from orders), x as (select m.*, cue from m left join c using (edit_id))
  select edit_id, unnest(['no early card', 'title in time', 'first cue']) as "check", unnest(['error', 'warning', 'warning']) as severity, unnest([coalesce(card >= 500000, true), coalesce(title <= 3000000, true), coalesce(cue <= 40000, true)]) as passed,
    unnest([card, title, cue]) as measured from x""")
def opening_qa(spark, sf_dir):
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("edit_id"), (F.col("o_custkey") * 60).alias("start_us"))
    return Q.opening_qa(_moves(spark, sf_dir), c)
