"""Queries over the output timeline and captions, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import RANGES_CTE, WORDS_CTE, ranges, words
from ..operators import cuts as C
from ..operators import timeline as T
from ..registry import query
from .speech_queries import KEY, W

LINE = RANGES_CTE + """, tl as (select *, floor((end_us - start_us) * 100 / speed_pct)::bigint as duration_us from ranges),
line as (
  select *, output_start + duration_us as output_end from (
    select *, coalesce(sum(duration_us) over (partition by edit_id order by range_idx rows between unbounded preceding and 1 preceding), 0)::bigint as output_start from tl)
)"""
R = "with " + LINE
RW = W + ", " + LINE


def _line(spark, sf_dir):
    return T.timeline(ranges(spark, sf_dir))


@query(R + " select edit_id, range_idx, duration_us, output_start, output_end from line")
def timeline(spark, sf_dir):
    return _line(spark, sf_dir).select("edit_id", "range_idx", "duration_us", "output_start", "output_end")


PTS = "pts as (select source_id, idx as point_id, start_us as at_us from words)"


@query(RW + "," + PTS + """ select edit_id, range_idx, p.source_id, point_id, at_us, (output_start + floor((at_us - start_us) * 100 / speed_pct))::bigint as output_us
  from pts p join line l on p.source_id = l.source_id and at_us between start_us and end_us""")
def map_to_output(spark, sf_dir):
    p = words(spark, sf_dir).select("source_id", F.col("idx").alias("point_id"), F.col("start_us").alias("at_us"))
    return T.map_to_output(_line(spark, sf_dir), p)


@query(RW + """, sp as (select source_id, idx as span_id, start_us as s_start, end_us as s_end from words)
  select edit_id, range_idx, p.source_id, span_id, (output_start + floor((greatest(s_start, start_us) - start_us) * 100 / speed_pct))::bigint as out_start,
  (output_start + floor((least(s_end, end_us) - start_us) * 100 / speed_pct))::bigint as out_end
  from sp p join line l on p.source_id = l.source_id and greatest(s_start, start_us) < least(s_end, end_us)""")
def map_interval(spark, sf_dir):
    s = words(spark, sf_dir).select("source_id", F.col("idx").alias("span_id"), F.col("start_us").alias("s_start"), F.col("end_us").alias("s_end"))
    return T.map_interval(_line(spark, sf_dir), s)


@query(R + """, p as (select l_orderkey::bigint as edit_id, l_linenumber * 1000 + l_partkey as point_id, (l_suppkey * 41000)::bigint as out_us from lineitem)
  select p.edit_id, range_idx, point_id, source_id, (start_us + floor((out_us - output_start) * speed_pct / 100))::bigint as source_us
  from p join line l on p.edit_id = l.edit_id and out_us between output_start and output_end""")
def map_to_source(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    p = li.select(F.col("l_orderkey").alias("edit_id"), (F.col("l_linenumber") * 1000 + F.col("l_partkey")).alias("point_id"), (F.col("l_suppkey") * 41000).cast("long").alias("out_us"))
    return T.map_to_source(_line(spark, sf_dir), p)


@query(R + """ select edit_id, range_idx, output_start from (select *, lag(source_id) over o as ls, lag(end_us) over o as le from line window o as (partition by edit_id order by range_idx))
  where ls is not null and not (ls = source_id and le = start_us)""")
def cut_boundaries(spark, sf_dir):
    return T.cut_boundaries(_line(spark, sf_dir))


@query(R + """ select edit_id, range_idx, source_id, start_us, case when output_end > 3000000 then (start_us + floor((3000000 - output_start) * speed_pct / 100))::bigint else end_us end as end_us
  from line where output_start < 3000000""")
def head_of(spark, sf_dir):
    return T.head_of(_line(spark, sf_dir), 3_000_000)


PLACED = """pw as (
  select edit_id, w.idx, w.word, w.speaker, range_idx, (output_start + floor((greatest(w.start_us, l.start_us) - l.start_us) * 100 / speed_pct))::bigint as out_start,
    (output_start + floor((least(w.end_us, l.end_us) - l.start_us) * 100 / speed_pct))::bigint as out_end
  from words w join line l on w.source_id = l.source_id and greatest(w.start_us, l.start_us) < least(w.end_us, l.end_us)
), placed as (
  select edit_id, idx, word, speaker, out_start, out_end from (select *, row_number() over (partition by edit_id, idx order by range_idx) as nth from pw) where nth = 1
)"""


def _placed(spark, sf_dir):
    return T.output_words(_line(spark, sf_dir), words(spark, sf_dir))


@query(RW + "," + PLACED + " select * from placed")
def output_words(spark, sf_dir):
    return _placed(spark, sf_dir)


@query(RW + "," + PLACED + f""" select edit_id, idx, {KEY} as key, row_number() over (partition by edit_id, {KEY} order by out_start, idx) as occurrence from placed""")
def word_anchor(spark, sf_dir):
    return T.word_anchor(_placed(spark, sf_dir)).select("edit_id", "idx", "key", "occurrence")


@query()
def build_cues(spark, sf_dir):
    return T.build_cues(_placed(spark, sf_dir))


@query()
def build_phrase_cues(spark, sf_dir):
    return T.build_cues(_placed(spark, sf_dir), frozenset(("and", "und", "et")), frozenset(("the", "of", "die", "de", "la")), max_words=8, max_chars=48, phrase=True)


@query()
def build_opening_cues(spark, sf_dir):
    return T.build_opening_cues(_placed(spark, sf_dir), LEANING)


LEANING = frozenset(("the", "of", "die", "de", "la", "und", "and", "y"))


@query(W + r""", p as (
  select source_id as edit_id, idx, word, speaker, start_us, end_us, row_number() over o - 1 as pos, coalesce(start_us - lag(end_us) over o > 1000000 or start_us < lag(end_us) over o or speaker is distinct from lag(speaker) over o, false) as parts,
    regexp_matches(regexp_replace(word, '["'')\]}}]*$', ''), '[.!?…]$') as stop,
    regexp_replace(lower(word), '[^\p{L}\p{N}]', '', 'g') in ('the', 'of', 'die', 'de', 'la', 'und', 'and', 'y') and not regexp_matches(regexp_replace(word, '["'')\]}}]*$', ''), '[.!?…,;:\-–—]$') as leans
  from words window o as (partition by source_id order by start_us, idx)
), m as (
  select edit_id, least(min(pos + 1) filter (stop), min(pos) filter (parts and pos > 0), count(*)) as least, bool_or(leans and pos = 7) as l1, bool_or(leans and pos = 6) as l2 from p where pos <= 8 group by edit_id
), c as (select edit_id, case when least <= 8 then least when not l1 then 8 when l2 then 6 else 7 end as cut from m)
select edit_id, 0::bigint as cue_idx, 0::bigint as start_us, greatest(max(end_us), min(start_us) + 300000) as end_us, arg_min(speaker, pos) as speaker, count(*) as n_words, string_agg(word, ' ' order by pos) as text
from p join c using (edit_id) where pos < cut group by edit_id""")
def opening_cue(spark, sf_dir):
    """A conversation as an edit of one range."""
    w = words(spark, sf_dir).select(F.col("source_id").alias("edit_id"), "idx", "word", "speaker", F.col("start_us").alias("out_start"), F.col("end_us").alias("out_end"))
    return T.opening_cue(w, LEANING)[0]


# cues of the caption queries: one per conversation turn, of its first words, stretched into the next
CUES = W + """, cues as (
  select source_id as edit_id, row_number() over (partition by source_id order by turn) - 1 as cue_idx, min(start_us) as start_us,
         max(end_us) + source_id % 4 * 150000 as end_us, string_agg(word, ' ' order by idx) as text
  from words where turn >= 0 group by source_id, turn
)"""


def _cues(spark, sf_dir):
    from pyspark.sql import Window

    w = words(spark, sf_dir)
    t = w.groupBy("source_id", "turn").agg(
        F.min("start_us").alias("start_us"), (F.max("end_us") + F.col("source_id") % 4 * 150_000).alias("end_us"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"]), " ").alias("text"),
    )
    n = F.row_number().over(Window.partitionBy("source_id").orderBy("turn")) - 1
    return t.select(F.col("source_id").alias("edit_id"), n.cast("long").alias("cue_idx"), "start_us", "end_us", "text")


@query(CUES + """, d as (select *, lead(start_us) over (partition by edit_id order by start_us, cue_idx) as nx from cues),
  e as (select edit_id, cue_idx, start_us, case when end_us > nx then greatest(nx - 10000, start_us + 50000) else end_us end as end_us from d)
  select * from e where end_us > start_us""")
def deoverlap(spark, sf_dir):
    return T.deoverlap(_cues(spark, sf_dir)).drop("text")


@query(CUES + """ select edit_id, cue_idx, next_idx from (select *, lead(cue_idx) over o as next_idx, lead(start_us) over o as nx from cues window o as (partition by edit_id order by start_us, cue_idx)) where nx < end_us""")
def overlapping_cues(spark, sf_dir):
    return T.overlapping_cues(_cues(spark, sf_dir))


@query(CUES + """, r as (select edit_id, cue_idx as range_idx, cue_idx * 20000000 as output_start, (cue_idx + 1) * 20000000 as output_end from cues),
  s as (select c.*, (select min(range_idx) from r where r.edit_id = c.edit_id and c.start_us >= output_start and c.start_us < output_end) as slot from cues c),
  n as (select *, lead(start_us) over o as nx, lead(slot) over o as ns from s window o as (partition by edit_id order by cue_idx))
  select edit_id, cue_idx, start_us, case when nx - end_us > 0 and nx - end_us <= 2000000 and slot is not distinct from ns then nx - 10000 else end_us end as end_us from n""")
def hold_through_pauses(spark, sf_dir):
    c = _cues(spark, sf_dir)
    r = c.select("edit_id", F.col("cue_idx").alias("range_idx"), (F.col("cue_idx") * 20_000_000).alias("output_start"), ((F.col("cue_idx") + 1) * 20_000_000).alias("output_end"))
    return T.hold_through_pauses(c, r).drop("text")


@query(CUES + """, l as (select distinct edit_id, 'Line ' || edit_id as line from cues),
  s as (select edit_id, line, speech from l join (select edit_id, min(start_us) as speech from cues group by 1) using (edit_id))
  select c.edit_id, c.cue_idx + case when speech >= 450000 then 1 else 0 end as cue_idx, case when speech < 450000 and cue_idx = 0 then 0 else start_us end as start_us, end_us, text
  from cues c left join s on c.edit_id = s.edit_id union all select edit_id, 0, 0, speech - 10000, line from s where speech >= 450000""")
def opening_line(spark, sf_dir):
    c = _cues(spark, sf_dir)
    lines = c.select("edit_id", F.concat(F.lit("Line "), "edit_id").alias("line")).distinct()
    return T.opening_line(c, lines, 450_000)


@query(CUES + """, w2 as (select edit_id, cue_idx, start_us, end_us, unnest(ws) as word, generate_subscripts(ws, 1) - 1 as pos from (
    select *, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as ws from cues)),
  u as (select *, sum(length(word) + 1) over (partition by edit_id, cue_idx order by pos) as upto, sum(length(word) + 1) over (partition by edit_id, cue_idx) as total from w2)
  select edit_id, cue_idx, pos::bigint as pos, word, (start_us + floor((end_us - start_us) * (upto - length(word) - 1) / total))::bigint as start_us,
    (start_us + floor((end_us - start_us) * upto / total))::bigint as end_us from u""")
def estimated_words(spark, sf_dir):
    return T.estimated_words(_cues(spark, sf_dir))


@query(CUES + """, t as (select *, (start_us + 500) // 1000 as a, (end_us + 500) // 1000 as b from cues)
  select edit_id, string_agg((cue_idx + 1) || chr(10) || printf('%02d:%02d:%02d,%03d', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000) || ' --> '
    || printf('%02d:%02d:%02d,%03d', b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000) || chr(10) || text || chr(10), chr(10) order by cue_idx) as srt from t group by edit_id""")
def export_srt(spark, sf_dir):
    return T.export_srt(_cues(spark, sf_dir))


@query(R + """, b as (select *, lag(beat) over (partition by edit_id order by range_idx) as lb, row_number() over (partition by edit_id order by range_idx) as rn from line),
  c as (select *, sum(case when rn = 1 or beat is distinct from lb then 1 else 0 end) over (partition by edit_id order by range_idx) as scene from b)
  select edit_id, scene::bigint as scene, beat, min(output_start) as start_us, max(output_end) as end_us from c group by edit_id, scene, beat
  having max(output_end) - min(output_start) >= 800000 and length(beat) <= 80""")
def labels_from_beats(spark, sf_dir):
    return T.labels_from_beats(_line(spark, sf_dir))


@query("with recursive " + RANGES_CTE + """, e as (
  select *, row_number() over o as i, round_even(sum(floor((end_us - start_us) * 100 / speed_pct)::bigint) over (partition by edit_id order by range_idx) * 30 / 1000000.0::double, 0)::bigint as b from ranges window o as (partition by edit_id order by range_idx)
), f as (
  select edit_id, range_idx, i, 0::bigint as before, greatest(1, b) as bound from e where i = 1
  union all select e.edit_id, e.range_idx, e.i, f.bound, greatest(f.bound + 1, e.b) from f join e on e.edit_id = f.edit_id and e.i = f.i + 1
), x as (select e.*, before, bound - before as frames, floor(start_us * 30 / 1000000)::bigint as src from e join f using (edit_id, range_idx))
select edit_id, range_idx, printf('%02d:%02d:%02d:%02d', src // 108000, src // 1800 % 60, src // 30 % 60, src % 30) as source_in, printf('%02d:%02d:%02d:%02d', before // 108000, before // 1800 % 60, before // 30 % 60, before % 30) as record_in,
  frames, concat_ws(',', case when speed_pct <> 100 then 'speed' end, case when zoom_pct <> 100 then 'zoom' end) as notes from x""")
def export_events(spark, sf_dir):
    return T.export_events(C.allocate_frames(T.range_durations(ranges(spark, sf_dir))))
