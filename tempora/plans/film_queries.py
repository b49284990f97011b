"""Audit of whole films, with its oracle. A film is a user, each event twelve packets of sound, a sampled picture, and, by its type and number, a cut, a cue, a black or a quiet span."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import table
from ..operators import films as M
from ..registry import query
from ..sources.shared import written

FILM = """with ev as (select user_id as edit_id, event_id as k, event_type as kind, (row_number() over (partition by user_id order by event_id) - 1)::bigint as n, event_id % 40 // 10 as z from events),
  films as (select edit_id, case when edit_id % 9 = 4 then 'hevc' else 'h264' end as codec, case when edit_id % 13 <> 5 then 'yuv420p' end as pixels, 30000 + edit_id % 6 as rate, 30000 as nominal, case when edit_id % 8 <> 1 then 'aac' else 'opus' end as sound,
      case when edit_id % 10 = 3 then 44100 else 48000 end as sample_rate, 2 - edit_id % 11 // 10 as channels, count(*) * 255996 + edit_id % 4 * 15000 as video_us, count(*) * 255996 + edit_id % 5 * 12000 as container_us from ev group by edit_id),
  packets as (select edit_id, n * 12 + j as pos, (n * 255996 + j * 21333) * (case when edit_id % 7 = 2 then 6 else 5 end) // 5 - case when edit_id % 3 = 1 and k % 97 = 0 then 30000 else 0 end as pts_us, 21333 as dur_us from ev, (select unnest(range(12)) as j) where edit_id % 17 <> 0),
  samples as (select edit_id, n * 255996 as at_us, case when z < 2 then k % 51 else 60 + k % 9 end as change from ev),
  approved as (select edit_id, container_us - 3000000 as a_start, container_us as a_end from films where edit_id % 3 = 0),
  black as (select edit_id, case when n < 3 then n * 30000 else n * 255996 end as b_start, n * 255996 + k % 4 * 120000 as b_end from ev where kind = 'error' and (n < 3 or k % 31 = 0)),
  cuts as (select edit_id, n * 255996 + k % 7 * 60000 as at_us from ev where k % 29 = 0), quiet as (select edit_id, n * 255996 as q_start, n * 255996 + 130000 as q_end from ev where k % 23 = 0),
  cues as (select edit_id, n * 255996 + case when k % 211 = 0 then 60000000 else k % 3 * 1000 end as c_start, n * 255996 + 200000 + case when k % 67 = 0 then 400000 else 0 end + case when k % 211 = 0 then 60000000 else 0 end as c_end from ev where edit_id % 6 <> 5)"""


def film(spark, sf_dir):
    """The tables by name."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").withColumn("n", (F.row_number().over(order) - 1).cast("long"))
    ev = written(e.select(F.col("user_id").alias("edit_id"), F.col("event_id").alias("k"), F.col("event_type").alias("kind"), "n"), "films-events")
    films = ev.groupBy("edit_id").agg(F.count("*").alias("c")).selectExpr(
        "edit_id", "if(edit_id % 9 = 4, 'hevc', 'h264') as codec", "if(edit_id % 13 <> 5, 'yuv420p', null) as pixels", "30000 + edit_id % 6 as rate", "30000 as nominal", "if(edit_id % 8 <> 1, 'aac', 'opus') as sound",
        "if(edit_id % 10 = 3, 44100, 48000) as sample_rate", "2 - edit_id % 11 div 10 as channels", "c * 255996 + edit_id % 4 * 15000 as video_us", "c * 255996 + edit_id % 5 * 12000 as container_us",
    )
    packets = ev.where("edit_id % 17 <> 0").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(11)))).selectExpr(
        "edit_id", "n * 12 + j as pos", "(n * 255996 + j * 21333) * if(edit_id % 7 = 2, 6, 5) div 5 - if(edit_id % 3 = 1 and k % 97 = 0, 30000, 0) as pts_us", "21333 as dur_us"
    )
    return {
        "films": films, "packets": packets, "samples": ev.selectExpr("edit_id", "n * 255996 as at_us", "if(k % 40 div 10 < 2, k % 51, 60 + k % 9) as change"),
        "approved": films.where("edit_id % 3 = 0").selectExpr("edit_id", "container_us - 3000000 as a_start", "container_us as a_end"),
        "black": ev.where("kind = 'error' and (n < 3 or k % 31 = 0)").selectExpr("edit_id", "if(n < 3, n * 30000, n * 255996) as b_start", "n * 255996 + k % 4 * 120000 as b_end"),
        "cuts": ev.where("k % 29 = 0").selectExpr("edit_id", "n * 255996 + k % 7 * 60000 as at_us"), "quiet": ev.where("k % 23 = 0").selectExpr("edit_id", "n * 255996 as q_start", "n * 255996 + 130000 as q_end"),
        "cues": ev.where("edit_id % 6 <> 5").selectExpr("edit_id", "n * 255996 + if(k % 211 = 0, 60000000, k % 3 * 1000) as c_start", "n * 255996 + 200000 + if(k % 67 = 0, 400000, 0) + if(k % 211 = 0, 60000000, 0) as c_end"),
    }


_RULES = [
    ("constant rate", "error", "abs(rate - nominal) * 10000 <= greatest(10000, nominal)", "rate"), ("picture codec", "error", "codec = 'h264' and pixels = 'yuv420p'", "null"),
    ("sound format", "error", "sound = 'aac' and sample_rate = 48000 and channels = 2", "sample_rate"), ("packets rise", "error", "p.rises", "coalesce(p.n, 0)"), ("packet step", "error", "abs(coalesce(p.step, 0) - 21333) <= 2000", "coalesce(p.step, 0)"),
    ("sound length", "error", "abs(coalesce(p.len, 0) - video_us) <= 43667 and abs(coalesce(p.len, 0) - container_us) <= 43667", "coalesce(p.len, 0)"), ("ending moves", "error", "coalesce(h.hold, 0) <= 1000000", "coalesce(h.hold, 0)"),
    ("no black inside", "warning", "coalesce(b.inside, 0) = 0", "coalesce(b.inside, 0)"), ("opens on an image", "warning", "b.opening is null", "coalesce(b.opening, 0)"), ("cuts carry sound", "warning", "coalesce(s.n, 0) = 0", "coalesce(s.n, 0)"),
    ("captions present", "error", "c.n is not null", "coalesce(c.n, 0)"), ("captions apart", "warning", "coalesce(c.over, 0) = 0", "coalesce(c.over, 0)"), ("captions inside", "warning", "coalesce(c.past, 0) = 0", "coalesce(c.past, 0)"),
]


@query(FILM + f""", st as (select *, pts_us - lag(pts_us) over (partition by edit_id order by pos) as step from packets),
  p as (select edit_id, count(*) as n, count(*) filter (step <= 0) = 0 and count(*) > 1 as rises, floor(quantile_cont(step, 0.5) filter (step > 0))::bigint as step, max(pts_us + dur_us) - least(0, arg_min(pts_us, pos)) as len from st group by edit_id),
  late as (select s.*, container_us, row_number() over o as i, lag(at_us) over o as prev, lead(at_us) over o as nxt from samples s join films using (edit_id) where at_us >= container_us - 10000000 window o as (partition by s.edit_id order by at_us)),
  still as (select *, i - row_number() over (partition by edit_id order by i) as island from late where change <= 50 and prev is not null),
  runs as (select edit_id, island, min(prev) as s, max(case when nxt is null then container_us else at_us end) as e, count(*) as n from still group by all),
  best as (select * from runs qualify row_number() over (partition by edit_id order by n desc, s) = 1),
  h as (select edit_id, e - s as hold from best where not exists (select 1 from approved a where a.edit_id = best.edit_id and s >= a_start - 300000 and e <= a_end + 300000)),
  b as (select edit_id, count(*) filter (b_start > 250000 and b_end < container_us - 250000) as inside, max(b_end) filter (b_start <= 50000 and b_end >= 250000) as opening from black join films using (edit_id) group by edit_id),
  s as (select edit_id, count(*) as n from (select distinct edit_id, at_us from cuts) c where exists (select 1 from quiet q where q.edit_id = c.edit_id and at_us between q_start - 150000 and q_end + 150000) group by edit_id),
  cc as (select *, max(c_end) over (partition by edit_id order by c_start, c_end rows between unbounded preceding and 1 preceding) as before from cues),
  c as (select edit_id, count(*) as n, count(*) filter (c_start < before) as over, count(*) filter (c_start > container_us + 50000) as past from cc join films using (edit_id) group by edit_id)
  select edit_id, r.check as "check", r.severity as severity, coalesce(r.passed, false) as passed, r.measured as measured from (
    select films.edit_id, unnest([{", ".join(f"{{'check': '{n}', 'severity': '{s}', 'passed': {ok}, 'measured': ({m})::bigint}}" for n, s, ok, m in _RULES)}]) as r
    from films left join p using (edit_id) left join h using (edit_id) left join b using (edit_id) left join s using (edit_id) left join c using (edit_id))""")
def film_audit(spark, sf_dir):
    t = film(spark, sf_dir)
    return M.film_audit(t["films"], t["packets"], t["samples"], t["approved"], t["black"], t["cuts"], t["quiet"], t["cues"])
