"""Queries over edges of speech in levels, with their oracles. Levels are made from the words: loud during a word, 50 ms late, quiet between words."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import recordings, words
from ..operators import acoustics as X
from ..registry import query
from .speech_queries import WR

LEVELS = """fw as (select *, start_us // 10000 + 5 as f0, end_us // 10000 + 5 as f1, coalesce(lag(end_us) over (partition by source_id order by idx) // 10000 + 6, 0) as fb from words),
  frames as (select source_id, f as frame_no, case when f >= f0 then -200 - f % 7 * 10 else -600 + f % 5 * 8 end as level from (select source_id, f0, unnest(range(fb, f1 + 1)) as f from fw)),
  turns as (select source_id * 1000 + turn as edit_id, source_id, min(start_us) + 150000 as start_us, max(end_us) - (turn % 3) * 60000 as end_us from words group by source_id, turn having max(end_us) - min(start_us) > 500000)"""


def voiced_sql(key: str) -> str:
    """voiced: the frames with voice of the windows in `win`."""
    return f"""met as (select {key}, frame_no, level, quantile_cont(level, 0.1) over (partition by {key}) as low, quantile_cont(level, 0.95) over (partition by {key}) as peak from win join frames using (source_id)
    where frame_no >= (w_lo + 5000) // 10000 and frame_no < w_hi // 10000),
  loud as (select {key}, frame_no, frame_no - row_number() over (partition by {key} order by frame_no) as run from met where peak - low >= 100 and level - low > greatest(80.0, (peak - low) / 5)),
  voiced as (select {key}, frame_no, max(frame_no) over (partition by {key}, run) + 1 as run_end from loud qualify count(*) over (partition by {key}, run) >= 3)"""


def _frames(w):
    """Stretches of frames, one for each word and the time before it."""
    before = F.lag("end_us").over(Window.partitionBy("source_id").orderBy("idx"))
    tiled = w.withColumns({"f0": F.floor(F.col("start_us") / 10_000) + 5, "f1": F.floor(F.col("end_us") / 10_000) + 5, "fb": F.coalesce(F.floor(before / 10_000) + 6, F.lit(0))}).where("fb <= f1")
    level = lambda f: F.when(f >= F.col("f0"), -200 - f % 7 * 10).otherwise(-600 + f % 5 * 8).cast("int")
    return tiled.select("source_id", F.col("fb").alias("frame_no"), F.transform(F.sequence("fb", "f1"), level).alias("levels"))


def _turns(w):
    t = w.groupBy("source_id", "turn").agg((F.min("start_us") + 150_000).alias("start_us"), (F.max("end_us") - F.col("turn") % 3 * 60_000).alias("end_us"), (F.max("end_us") - F.min("start_us")).alias("n"))
    return t.where("n > 500000").select((F.col("source_id") * 1000 + F.col("turn")).alias("edit_id"), "source_id", "start_us", "end_us")


@query(WR + "," + LEVELS + ", win as (select edit_id, source_id, greatest(0, end_us - 1500000) as w_lo, least(duration_us, end_us + 1500000) as w_hi from turns join recordings using (source_id) where end_us < duration_us - 10000)," + voiced_sql("edit_id") + """
  select t.edit_id, case when frame_no is null then 0 else least(run_end - frame_no, 30) * 10000 end as tail_us from turns t left join voiced v on v.edit_id = t.edit_id and v.frame_no = (t.end_us + 5000) // 10000""")
def check_tail(spark, sf_dir):
    """Conversation turns as edits, a third of them ended in a word."""
    w = words(spark, sf_dir)
    return X.check_tail(_turns(w), _frames(w), recordings(w))


@query(WR + "," + LEVELS + """, ww as (select source_id, idx, start_us as w0, end_us as w1, coalesce(lag(end_us) over o, 0) as pe, lead(start_us) over o as ns from words window o as (partition by source_id order by idx)),
  en as (select t.edit_id, t.source_id, duration_us, arg_min({'w0': w0, 'w1': w1, 'pe': pe}, idx) as a, arg_max({'w0': w0, 'w1': w1, 'ns': ns}, idx) as b from turns t join ww using (source_id) join recordings using (source_id) where w1 > t.start_us and w0 < t.end_us group by 1, 2, 3),
  sp as (select edit_id, source_id, duration_us, b.ns as ns, 'in' as side, greatest(a.pe, a.w0 - 400000) as lo, greatest(a.w0 + 400000, least(a.w1, a.w0 + 1000000)) as hi from en
    union all select edit_id, source_id, duration_us, b.ns, 'out', greatest(b.w0, b.w1 - 400000), least(coalesce(b.ns, duration_us), b.w1 + 400000, duration_us) from en),
  ok as (select * from sp where side = 'in' or hi - lo >= 30000),
  win as (select edit_id, side, source_id, greatest(0, lo - 1500000) as w_lo, hi + 1500000 as w_hi from ok),""" + voiced_sql("edit_id, side") + """,
  fo as (select edit_id, side, lo, hi, ns, duration_us, min(frame_no) * 10000 as onset, (max(frame_no) + 1) * 10000 as offs from ok join voiced using (edit_id, side) where frame_no >= (lo + 5000) // 10000 and frame_no < (hi + 5000) // 10000 group by 1, 2, 3, 4, 5, 6),
  mv as (select edit_id, max(case when side = 'in' and onset // 10000 > (lo + 5000) // 10000 then greatest(0, onset - least(100000, onset - lo)) end) as i,
    max(case when side = 'out' then least(offs + least(100000, case when ns is not null then greatest(0, hi - offs) else 100000 end), duration_us, coalesce(ns, duration_us)) end) as o from fo group by 1)
  select t.edit_id, 0::bigint as range_idx, case when coalesce(o, end_us) - coalesce(i, start_us) < 80000 then start_us else coalesce(i, start_us) end as start_us,
    case when coalesce(o, end_us) - coalesce(i, start_us) < 80000 then end_us else coalesce(o, end_us) end as end_us from turns t left join mv using (edit_id)""")
def acoustic_edges(spark, sf_dir):
    w = words(spark, sf_dir)
    return X.acoustic_edges(_turns(w).withColumn("range_idx", F.lit(0).cast("long")), w, _frames(w), recordings(w), 100_000)
