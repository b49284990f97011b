"""Queries over cut candidates, plans and ranges, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import RANGES_CTE, RECORDINGS_CTE, WORDS_CTE, ranges, recordings, table, words
from ..functions.scalars import normalise
from ..operators import cuts as C
from ..operators import intervals as I
from ..registry import ORACLES, query
from ..sources.shared import written
from .speech_queries import NORM, PAUSES, W, WR

# Fixture lexicons: the most frequent words stand for hesitations, as the test texts are invented.
LEX = rf"""
fr as (select n as key, row_number() over (order by c desc, n) as r from (select {NORM} as n, count(*) as c from words group by 1) where n <> ''),
fillers as (select key, r % 2 = 0 as ambiguous from fr where r <= 10), deliberate as (select key from fr where r between 11 and 20),
k as (
  select *, {NORM} as key, coalesce(greatest(end_us, lead(start_us) over o - 50000), end_us) as to_us, lead({NORM}) over o as next_key,
         coalesce(start_us - lag(end_us) over o, 150000) >= 150000 and coalesce(lead(start_us) over o - end_us, 150000) >= 150000 as alone
  from words window o as (partition by source_id order by idx)
)"""


def _lexicons(w):
    f = w.select(normalise(F.col("word")).alias("key")).where("key <> ''").groupBy("key").count().orderBy(F.desc("count"), "key").limit(20)
    from pyspark.sql import Window

    r = written(f.withColumn("r", F.row_number().over(Window.orderBy(F.desc("count"), "key"))), "lexicon")  # 20 rows, read more than once
    return r.where("r <= 10").select("key", (F.col("r") % 2 == 0).alias("ambiguous")), r.where("r > 10").select("key")


def _cuts(w):
    """Cuts for the interval queries: from 40 % into every word before a comma to 60 ms past its end."""
    d = F.col("end_us") - F.col("start_us")
    return w.where(F.col("word").endswith(",")).select(
        "source_id", F.concat(F.lit("c"), F.lpad(F.col("idx").cast("string"), 5, "0")).alias("cut_id"),
        (F.col("start_us") + F.floor(d * 2 / 5)).alias("cut_start"), (F.col("end_us") + 60_000).alias("cut_end"),
    )


CUTS = """
cuts as (
  select source_id, 'c' || lpad(idx::varchar, 5, '0') as cut_id, start_us + floor((end_us - start_us) * 2 / 5)::bigint as cut_start, end_us + 60000 as cut_end
  from words where word like '%,'
)"""


@query(W + "," + LEX + """ select source_id, 'stutter' as kind, case when key in (select key from deliberate) then 'medium' else 'high' end as confidence,
  start_us, to_us as end_us from k where key <> '' and key = next_key and key not in (select key from fillers)""")
def stutters(spark, sf_dir):
    w = words(spark, sf_dir)
    return C.stutters(w, *_lexicons(w))


@query(W + "," + LEX + """ select source_id, 'filler' as kind, case when alone then 'high' else 'medium' end as confidence, start_us, to_us as end_us
  from k join fillers using (key) where alone or not ambiguous""")
def fillers(spark, sf_dir):
    w = words(spark, sf_dir)
    return C.fillers(w, _lexicons(w)[0])


@query(WR + "," + PAUSES + """ select source_id, 'pause' as kind, 'high' as confidence,
  case place when 'lead' then 0 when 'tail' then start_us + 80000 else start_us + 125000 end as start_us,
  case place when 'lead' then greatest(0, end_us - 80000) when 'tail' then end_us else end_us - 125000 end as end_us
  from pauses where end_us - start_us >= 900000""")
def pause_cuts(spark, sf_dir):
    w = words(spark, sf_dir)
    return C.pause_cuts(w, recordings(w))


@query("with recursive " + WORDS_CTE + r""", k as (select source_id, idx, start_us, end_us, lower(regexp_replace(substr(word, 1, 1), '^\p{P}+|\p{P}+$', '', 'g')) as key from words),
  l as (select *, """ + ", ".join(f"lead(key, {j}) over o as k{j}, lead(end_us, {j}) over o as e{j}, lead(start_us, {j}) over o as s{j}" for j in range(10)) + r""" from k window o as (partition by source_id order by idx)),
  m as (select source_id, idx, start_us, case """ + " ".join(
    "when " + " and ".join(f"k{j} = k{j + n} and k{j} <> ''" for j in range(n)) + f" then struct_pack(n := {n}, e := e{n - 1}, s := s{n})" for n in (5, 4, 3, 2)
) + r""" end as m from l), d as (select source_id, idx, start_us, m.n as n, m.e as e, m.s as s from m where m is not null),
  r as (select source_id, min(idx) as idx from d group by 1 union all select x.source_id, min(y.idx) from r join d x on x.source_id = r.source_id and x.idx = r.idx join d y on y.source_id = x.source_id and y.idx >= x.idx + x.n group by x.source_id, x.idx)
  select source_id, 'false_start' as kind, case when n >= 3 then 'high' else 'medium' end as confidence, start_us, greatest(e, s - 50000) as end_us from d join r using (source_id, idx)""")
def false_starts(spark, sf_dir):
    """Words by their first letter, so that the invented texts repeat phrases."""
    return C.false_starts(words(spark, sf_dir).withColumn("word", F.substring("word", 1, 1)))


def _candidates(w):
    w = written(w, "words")
    hesitations, deliberate = _lexicons(w)
    return C.find_cut_candidates([C.false_starts(w), C.stutters(w, hesitations, deliberate), C.fillers(w, hesitations), C.pause_cuts(w, recordings(w))])


CHOSEN = """), c as (select *, row_number() over (partition by source_id order by priority, start_us, end_us, confidence) as i from every), k as (
  select source_id, i, [{'a': start_us, 'b': end_us}] as kept, true as stays from c where i = 1
  union all select source_id, i, case when ok then list_append(kept, {'a': a, 'b': b}) else kept end, ok from (
    select c.source_id, c.i, c.start_us as a, c.end_us as b, kept, len(list_filter(kept, lambda x: c.end_us > x.a and c.start_us < x.b)) = 0 as ok from k join c on c.source_id = k.source_id and c.i = k.i + 1)
)"""


def _all_kinds() -> str:
    kinds = ("false_starts", "stutters", "fillers", "pause_cuts")
    return "with recursive every as (" + " union all ".join(f"select {n} as priority, source_id, kind, confidence, start_us, end_us from ({ORACLES[k].replace('substr(word, 1, 1)', 'word')})" for n, k in enumerate(kinds)) + CHOSEN


@query(_all_kinds() + """ select c.source_id, 'cut-' || printf('%03d', row_number() over (partition by c.source_id order by start_us, end_us, kind)) as cut_id, kind, confidence, start_us, end_us from c join k using (source_id, i) where stays""")
def find_cut_candidates(spark, sf_dir):
    return _candidates(words(spark, sf_dir))


@query(WR + "," + PAUSES + """, p as (
  select source_id, case place when 'lead' then 0 when 'tail' then start_us + 80000 else start_us + 125000 end as start_us,
    case place when 'lead' then greatest(0, end_us - 80000) when 'tail' then end_us else end_us - 125000 end as end_us
  from pauses where end_us - start_us >= 900000
), c as (select *, 'cut-' || printf('%03d', row_number() over (partition by source_id order by start_us, end_us)) as cut_id from p)
select source_id, cut_id, 'pause' as kind, 'high' as confidence, start_us, end_us from c
where right(cut_id, 1) in ('1', '2', '3') and right(cut_id, 1) <> '2'""")
def accept_cuts(spark, sf_dir):
    """Pause cuts whose number ends in 1, 2 or 3 are asked for; those that end in 2 are in the plan already."""
    w = words(spark, sf_dir)
    c = C.find_cut_candidates([C.pause_cuts(w, recordings(w))])
    last = F.substring("cut_id", -1, 1)
    chosen = c.where(last.isin("1", "2", "3"))
    return C.accept_cuts(c, chosen, c.where(last == "2"))[0]


@query(W + "," + RANGES_CTE + "," + CUTS + """, hit as (
  select r.edit_id, r.range_idx, r.source_id, r.start_us, r.end_us, c.cut_id, c.cut_start, c.cut_end from ranges r join cuts c
  on r.source_id = c.source_id and c.cut_end > r.start_us and c.cut_start < r.end_us
), g as (
  select *, greatest(start_us, coalesce(max(cut_end) over (partition by edit_id, range_idx order by cut_start, cut_end, cut_id rows between unbounded preceding and 1 preceding), start_us)) as f from hit
), n as (select *, sum(case when cut_start > f then 1 else 0 end) over (partition by edit_id, range_idx order by cut_start, cut_end, cut_id rows unbounded preceding) as p from g),
ids as (select edit_id, range_idx, p, string_agg(cut_id, ',' order by cut_start, cut_end, cut_id) as cut_ids from n group by all),
pieces as (
  select edit_id, range_idx, source_id, p - 1 as piece, f as start_us, cut_start as end_us from n where cut_start > f
  union all select edit_id, range_idx, source_id, max(p), max(cut_end), min(end_us) from n group by edit_id, range_idx, source_id having max(cut_end) < min(end_us)
)
select pieces.edit_id, pieces.range_idx, source_id, piece::bigint as piece, start_us, end_us, coalesce(cut_ids, '') as cut_ids
from pieces left join ids on pieces.edit_id = ids.edit_id and pieces.range_idx = ids.range_idx and pieces.piece = ids.p where end_us - start_us >= 80000
union all select edit_id, range_idx, source_id, 0, start_us, end_us, '' from ranges r where not exists (
  from hit h where h.edit_id = r.edit_id and h.range_idx = r.range_idx) and end_us - start_us >= 80000""")
def subtract_cuts(spark, sf_dir):
    w = words(spark, sf_dir)
    got = I.subtract(ranges(spark, sf_dir), _cuts(w), "source_id", ["edit_id", "range_idx"], 80_000)
    return got.withColumn("cut_ids", F.array_join("cut_ids", ","))


MERGED = """
mf as (select *, case when start_us <= max(end_us) over (partition by edit_id, source_id order by start_us, end_us rows between unbounded preceding and 1 preceding) + 50000 then 0 else 1 end as b from ranges),
mi as (select *, sum(b) over (partition by edit_id, source_id order by start_us, end_us rows unbounded preceding) as island from mf),
merged as (select edit_id, source_id, min(start_us) as start_us, max(end_us) as end_us from mi group by edit_id, source_id, island)"""


@query("with " + RANGES_CTE + "," + MERGED + " select edit_id, source_id, start_us, end_us from merged")
def merge_ranges(spark, sf_dir):
    r = ranges(spark, sf_dir).select("edit_id", "source_id", F.col("start_us").alias("snap_start"), F.col("end_us").alias("snap_end"))
    return C.snap_merge(r)


ITEMS = """
items as (
  select edit_id, source_id, case when edit_id % 3 = 0 and range_idx % 2 = 0 then 'keep' else 'drop' end as action, start_us, end_us,
         case when range_idx % 5 = 4 then 'cut-x' end as cut_id from ranges
)"""


def _items(spark, sf_dir):
    keep = (F.col("edit_id") % 3 == 0) & (F.col("range_idx") % 2 == 0)
    return ranges(spark, sf_dir).select(
        "edit_id", "source_id", F.when(keep, "keep").otherwise("drop").alias("action"), "start_us", "end_us", F.when(F.col("range_idx") % 5 == 4, "cut-x").alias("cut_id")
    )


KEPT = ITEMS + """, fl as (select edit_id, source_id, bool_or(action = 'keep') as k from items group by all),
wh as (select fl.edit_id, fl.source_id, duration_us from fl join recordings using (source_id) where not k),
dr as (
  select i.edit_id, i.source_id, start_us, least(end_us, duration_us) as end_us from items i join wh using (edit_id, source_id)
  where action = 'drop' and cut_id is null and start_us < duration_us
  union all select edit_id, source_id, duration_us, duration_us from wh
), cm as (select *, coalesce(max(end_us) over (partition by edit_id, source_id order by start_us, end_us rows between unbounded preceding and 1 preceding), 0) as f from dr),
kept as (
  select edit_id, source_id, start_us, end_us from items where action = 'keep'
  union all select edit_id, source_id, f, start_us from cm where start_us - f > 50000
)"""


@query(WR + "," + RANGES_CTE + "," + KEPT + " select * from kept")
def keep_intervals(spark, sf_dir):
    return C.keep_intervals(_items(spark, sf_dir), recordings(words(spark, sf_dir)))


SNAPPED = """
ni as (select * from (select r.edit_id, r.range_idx, w.start_us as v, row_number() over (partition by r.edit_id, r.range_idx order by abs(r.start_us - w.start_us), w.idx) as nth
  from ranges r join words w on r.source_id = w.source_id and abs(r.start_us - w.start_us) <= 350000) where nth = 1),
no as (select * from (select r.edit_id, r.range_idx, w.end_us as v, row_number() over (partition by r.edit_id, r.range_idx order by abs(r.end_us - w.end_us), w.idx) as nth
  from ranges r join words w on r.source_id = w.source_id and abs(r.end_us - w.end_us) <= 350000) where nth = 1),
ii as (select r.edit_id, r.range_idx, arg_min(w.start_us, w.idx) as v from ranges r join words w on r.source_id = w.source_id and w.start_us < r.start_us and r.start_us < w.end_us group by all),
io as (select r.edit_id, r.range_idx, arg_min(w.end_us, w.idx) as v from ranges r join words w on r.source_id = w.source_id and w.start_us < r.end_us and r.end_us < w.end_us group by all),
mv as (
  select r.*, coalesce(ni.v, ii.v, r.start_us) as to_in, coalesce(no.v, io.v, r.end_us) as to_out from ranges r
  left join ni using (edit_id, range_idx) left join no using (edit_id, range_idx) left join ii using (edit_id, range_idx) left join io using (edit_id, range_idx)
), pv as (select m.edit_id, m.range_idx, max(w.end_us) as prev_end from mv m join words w on m.source_id = w.source_id and w.end_us <= m.to_in group by all),
nx as (select m.edit_id, m.range_idx, min(w.start_us) as next_start from mv m join words w on m.source_id = w.source_id and w.start_us >= m.to_out group by all),
snapped as (
  select m.edit_id, m.range_idx, m.source_id, m.start_us, m.end_us,
    case when to_out <= to_in then start_us else greatest(0, to_in - least(80000, greatest(0, to_in - coalesce(prev_end, 0)))) end as snap_start,
    case when to_out <= to_in then end_us else least(to_out + least(80000, greatest(0, coalesce(next_start, duration_us) - to_out)), coalesce(duration_us, to_out + least(80000, greatest(0, coalesce(next_start, duration_us) - to_out)))) end as snap_end
  from mv m left join pv using (edit_id, range_idx) left join nx using (edit_id, range_idx) left join recordings using (source_id)
)"""


@query(WR + "," + RANGES_CTE + "," + SNAPPED + " select * from snapped")
def snap_ranges(spark, sf_dir):
    w = words(spark, sf_dir)
    r = ranges(spark, sf_dir).select("edit_id", "range_idx", "source_id", "start_us", "end_us")
    return C.snap_ranges(r, w, recordings(w), ["edit_id", "range_idx"])


@query()
def compile_plan(spark, sf_dir):
    w = words(spark, sf_dir)
    r = recordings(w)
    c = C.find_cut_candidates([C.pause_cuts(w, r)]).select("source_id", "cut_id", F.col("start_us").alias("cut_start"), F.col("end_us").alias("cut_end"))
    return C.compile_plan(_items(spark, sf_dir), c, w, r)


@query("with recursive " + RANGES_CTE + """, e as (
  select edit_id, range_idx, row_number() over o as i,
    round_even(sum(floor((end_us - start_us) * 100 / speed_pct)::bigint) over (partition by edit_id order by range_idx) * 30 / 1000000.0::double, 0)::bigint as b
  from ranges window o as (partition by edit_id order by range_idx)
), f as (
  select edit_id, range_idx, i, greatest(1, b) as bound, greatest(1, b) as frames from e where i = 1
  union all select e.edit_id, e.range_idx, e.i, greatest(f.bound + 1, e.b), greatest(f.bound + 1, e.b) - f.bound from f join e on e.edit_id = f.edit_id and e.i = f.i + 1
) select edit_id, range_idx, frames from f""")
def allocate_frames(spark, sf_dir):
    r = ranges(spark, sf_dir).withColumn("duration_us", F.floor((F.col("end_us") - F.col("start_us")) * 100 / F.col("speed_pct")))
    return C.allocate_frames(r).select("edit_id", "range_idx", "frames")


@query("with recursive " + RANGES_CTE + """, e as (select *, row_number() over (partition by edit_id order by range_idx) as i from ranges), f as (
  select edit_id, i, start_us as a, end_us as b, null::bigint as seam, null::varchar as how from e where i = 1
  union all select edit_id, i, case when meets then mid else start_us end, end_us, case when meets then mid end, case when meets then case when zoom_pct = z then 'continuous' else 'punch' end end from (
    select *, coalesce(same and start_us - pb < 300000 and start_us > pa and end_us > pb and mid - pa >= 80000 and end_us - mid >= 80000, false) as meets from (
      select e.*, f.a as pa, f.b as pb, p.zoom_pct as z, (f.b + e.start_us) // 2 as mid, e.source_id = p.source_id and e.speed_pct = 100 and p.speed_pct = 100 as same
      from f join e on e.edit_id = f.edit_id and e.i = f.i + 1 join e p on p.edit_id = f.edit_id and p.i = f.i))
) select f.edit_id, range_idx, a as start_us, coalesce(lead(seam) over (partition by f.edit_id order by f.i), b) as end_us, how as transition_in from f join e using (edit_id, i)""")
def join_seams(spark, sf_dir):
    r = ranges(spark, sf_dir)
    return C.join_seams(r).select("edit_id", "range_idx", "start_us", "end_us", "transition_in")


@query(WR + "," + RANGES_CTE + """, p as (select source_id, duration_us * 9 // 10 as picture_us from recordings), x as (
  select *, floor((end_us - picture_us) * 100 / speed_pct)::bigint as gap, coalesce(end_us > picture_us + 1000 and picture_us > start_us, false) as past from ranges left join p using (source_id)
) select edit_id, range_idx, case when past and gap <= 750000 then 'freeze' when past then 'trim' else 'as_is' end as fit,
  case when past and gap <= 750000 then gap else 0 end as freeze_us, case when past and gap > 750000 then picture_us else end_us end as end_us from x""")
def fit_to_picture(spark, sf_dir):
    r = recordings(words(spark, sf_dir)).select("source_id", F.floor(F.col("duration_us") * 9 / 10).alias("picture_us"))
    return C.fit_to_picture(ranges(spark, sf_dir), r).select("edit_id", "range_idx", "fit", "freeze_us", "end_us")


@query(WR + "," + RANGES_CTE + """, x as (select r.*, d.duration_us from ranges r left join (select * from recordings where duration_us > 60000000) d using (source_id))
select edit_id, range_idx, unnest(list_filter([case when duration_us is null then 'unknown_source' end, case when start_us >= duration_us then 'starts_past_end' end,
  case when start_us < duration_us and end_us > duration_us + 250000 then 'ends_past_end' end, case when (end_us - start_us) * 100 < 50000 * speed_pct then 'too_short' end], lambda p: p is not null)) as problem from x""")
def validate_edits(spark, sf_dir):
    r = recordings(words(spark, sf_dir)).where("duration_us > 60000000")
    return C.validate_edits(ranges(spark, sf_dir), r)


@query("""
with c as (select p_partkey as clip_id, p_partkey % 20 as edit_id, p_size as a, case when p_partkey % 4 <> 0 then p_partkey % 101 end as b, case when p_partkey % 3 <> 0 then p_partkey % 83 end as need from part),
m as (select *, floor((coalesce(a, 0) + coalesce(b, 0) + coalesce(100 - need, 0)) * 100 / ((a is not null)::int + (b is not null)::int + (need is not null)::int))::bigint as mean_score from c)
select edit_id, clip_id, mean_score, row_number() over (partition by edit_id order by mean_score desc nulls last, clip_id) as rank from m""")
def rank_candidates(spark, sf_dir):
    k = F.col("p_partkey")
    c = table(spark, sf_dir, "part").select(
        k.alias("clip_id"), (k % 20).alias("edit_id"), F.col("p_size").alias("a"), F.when(k % 4 != 0, k % 101).alias("b"), F.when(k % 3 != 0, k % 83).alias("need")
    )
    return C.rank_candidates(c, ["a", "b"], "need").select("edit_id", "clip_id", "mean_score", "rank")
