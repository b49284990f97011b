"""Accepted moves, and the choices that islands make linear, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import RANGES_CTE, ranges
from ..operators import moves as M
from ..registry import query

KINDS = ("element", "title", "punch", "transition", "effect", "zoom")


def _moves(spark, sf_dir):
    """(chosen, proposed, plan): a move a range, at times that crowd; one in five stands in the plan. Some are chosen twice, some choices name no proposal."""
    r, n = ranges(spark, sf_dir), F.col("range_idx")
    q = F.floor(F.col("start_us") / 250_000)
    each = r.select(
        "edit_id", n.alias("n"), F.element_at(F.array(*map(F.lit, KINDS)), ((q + n) % 6 + 1).cast("int")).alias("kind"), (q % 9 * 30_000).alias("start_us"), F.floor((F.col("end_us") - F.col("start_us")) / 4).alias("len"),
        F.when(q % 3 > 0, F.concat(F.lit("look-"), (q % 2).cast("string"))).alias("look"),
    ).withColumn("end_us", F.when(F.col("kind") == "transition", F.col("start_us")).when(F.col("kind").isin("element", "title"), F.col("start_us") + F.col("len") % 2 * 60_000 + 60_000).otherwise(F.col("start_us") + F.col("len")))
    plan = each.where("n % 5 = 1 and kind <> 'zoom'").select("edit_id", "kind", "start_us", "end_us", "look")
    proposed = each.where("n % 5 <> 1").select("edit_id", F.concat(F.lit("m-"), F.col("n").cast("string")).alias("move_id"), "kind", "start_us", "end_us", "look")
    seq = (F.col("n") * 5 + F.col("edit_id")) % 11
    twice = F.explode(F.when(seq % 3 == 0, F.array(seq, seq + 20)).otherwise(F.array(seq)))
    chosen = each.select("edit_id", twice.alias("seq"), F.concat(F.lit("m-"), F.col("n").cast("string")).alias("move_id"))
    return chosen, proposed, plan


MOVES = "with recursive " + RANGES_CTE + """, each as (
  select *, case when kind = 'transition' then start_us when kind in ('element', 'title') then start_us + len % 2 * 60000 + 60000 else start_us + len end as end_us from (
    select edit_id, range_idx as n, ['element', 'title', 'punch', 'transition', 'effect', 'zoom'][(start_us // 250000 + range_idx) % 6 + 1] as kind, start_us // 250000 % 9 * 30000 as start_us, (end_us - start_us) // 4 as len,
      case when start_us // 250000 % 3 > 0 then 'look-' || (start_us // 250000 % 2) end as look from ranges)
), plan as (select edit_id, {'k': kind, 'a': start_us, 'b': end_us, 'l': look} as m from each where n % 5 = 1 and kind <> 'zoom'),
ch as (select edit_id, n, (n * 5 + edit_id) % 11 as seq, 'm-' || n as move_id from each),
c as (
  select ch.edit_id, move_id, seq, row_number() over (partition by ch.edit_id order by seq) as i, kind, start_us as a, end_us as b, look as l from ch left join (select * from each where n % 5 <> 1) e on ch.edit_id = e.edit_id and ch.n = e.n
), f as (
  select edit_id, 0::bigint as i, null::varchar as move_id, null::bigint as seq, null::varchar as kind, null::varchar as outcome, coalesce((select list(m) from plan p where p.edit_id = e.edit_id), []) as live from (select distinct edit_id from each) e
  union all select edit_id, i, move_id, seq, kind, outcome,
    case when kind = 'zoom' then list_filter(live, lambda x: x.k <> 'transition' or abs(x.a - a) >= 50000) when outcome = 'accepted' then list_append(live, {'k': kind, 'a': a, 'b': b, 'l': l}) else live end from (
    select c.*, live, case when kind is null then 'unknown' when kind = 'zoom' then 'accepted'
      when kind in ('element', 'title') then case when len(list_filter(live, lambda x: x.k = c.kind and x.a = c.a and x.b = c.b and x.l is not distinct from c.l)) > 0 then 'present' else 'accepted' end
      when kind = 'transition' then case when len(list_filter(live, lambda x: x.k = 'transition' and abs(x.a - c.a) < 50000)) > 0 then 'present' else 'accepted' end
      when len(list_filter(live, lambda x: x.k = c.kind and x.a < c.b and c.a < x.b)) > 0 then 'overlaps'
      when kind = 'effect' and len(list_filter(live, lambda x: x.k = 'title' and x.a < c.b and c.a < x.b)) > 0 then 'under_title' else 'accepted' end as outcome
    from (select edit_id as e, i as at, live from f) f join c on c.edit_id = f.e and c.i = f.at + 1)
)"""


@query(MOVES + " select edit_id, move_id, seq, kind, outcome from f where i > 0")
def accept_moves(spark, sf_dir):
    return M.accept_moves(*_moves(spark, sf_dir))[0]


@query(MOVES + " select edit_id, m.k as kind, m.a as start_us, m.b as end_us, m.l as look from (select edit_id, unnest(live) as m from (select edit_id, arg_max(live, i) as live from f group by edit_id))")
def accepted_plan(spark, sf_dir):
    return M.accept_moves(*_moves(spark, sf_dir))[1]


def _ranges_and_items(spark, sf_dir):
    """Ranges, every third with another recording's voice, and plan items around some of them, wide enough at times for a neighbour's range."""
    r, n = ranges(spark, sf_dir), F.col("range_idx")
    voiced = n % 3 == 2
    source = F.col("edit_id") % 7 + F.floor(n / 4)
    r = r.select(
        "edit_id", "range_idx", source.alias("source_id"), "start_us", "end_us", F.when(voiced, source + 1).alias("audio_source"), F.when(voiced, F.col("start_us") + 70_000).alias("audio_start"),
        F.when(voiced, F.col("end_us") + 70_000).alias("audio_end"), "zoom_pct",
    )
    wide = F.when(n % 4 == 0, 3_000_000).otherwise(0)
    return r, r.where("range_idx % 5 <> 3").select(
        "edit_id", F.col("range_idx").alias("item_idx"), F.when(n % 7 == 6, "drop").otherwise("keep").alias("action"), "source_id", (F.col("start_us") - wide).alias("start_us"), (F.col("end_us") + wide).alias("end_us"),
        "audio_source", F.col("audio_start").alias("audio_start"), (F.col("audio_end") - 400_000).alias("audio_end"), "zoom_pct",
    )


OWNED = "with " + RANGES_CTE.replace("ranges as (", "ranges0 as (") + """, r as (
  select edit_id, range_idx, edit_id % 7 + range_idx // 4 as source_id, start_us, end_us, case when range_idx % 3 = 2 then edit_id % 7 + range_idx // 4 + 1 end as audio_source,
    case when range_idx % 3 = 2 then start_us + 70000 end as audio_start, case when range_idx % 3 = 2 then end_us + 70000 end as audio_end, zoom_pct from ranges0
), items as (
  select edit_id, range_idx as item_idx, case when range_idx % 7 = 6 then 'drop' else 'keep' end as action, source_id, start_us - case when range_idx % 4 = 0 then 3000000 else 0 end as start_us,
    end_us + case when range_idx % 4 = 0 then 3000000 else 0 end as end_us, audio_source, audio_start, audio_end - 400000 as audio_end, zoom_pct from r where range_idx % 5 <> 3
), o as (
  select i.edit_id, item_idx, range_idx from items i join r on i.edit_id = r.edit_id and i.source_id = r.source_id and coalesce(i.audio_source, i.source_id) = coalesce(r.audio_source, r.source_id) and action <> 'drop'
    and coalesce(r.audio_start, r.start_us) >= coalesce(i.audio_start, i.start_us) - 500000 and coalesce(r.audio_end, r.end_us) <= coalesce(i.audio_end, i.end_us) + 500000
), own as (select edit_id, range_idx, count(*) as owners, max(item_idx) as item_idx from o group by all), spread as (select edit_id, item_idx, count(*) as n_ranges from o group by all),
z as (
  select edit_id, range_idx as seq, 'z-' || range_idx as move_id, case when range_idx = 4 then 3 else range_idx + case when edit_id % 5 = 0 then 1 else 0 end end as range_idx, 100 + range_idx * 7 as zoom_pct, start_us + 90000 * (range_idx + 1) as video_start from r
), n as (
  select z.*, item_idx, n_ranges, case when r.range_idx is null then 'no_range' when coalesce(owners, 0) <> 1 then 'no_single_item' when n_ranges > 1 then 'item_spans_ranges' else 'kept' end as outcome
  from z left join (select edit_id, range_idx from r) r using (edit_id, range_idx) left join own using (edit_id, range_idx) left join spread using (edit_id, item_idx)
), l as (select edit_id, range_idx, max(seq) as seq, arg_max(move_id, seq) as move_id, arg_max(video_start, seq) as video_start, arg_max(zoom_pct, seq) as zoom from z group by all)"""


def _asked(r):
    n = F.col("range_idx")
    return r.select(
        "edit_id", n.alias("seq"), F.concat(F.lit("z-"), n.cast("string")).alias("move_id"), F.when(n == 4, 3).otherwise(n + F.when(F.col("edit_id") % 5 == 0, 1).otherwise(0)).cast("long").alias("range_idx"),
        (100 + n * 7).cast("int").alias("zoom_pct"), (F.col("start_us") + 90_000 * (n + 1)).alias("video_start"),
    )


@query(OWNED + " select edit_id, move_id, outcome, case when outcome in ('kept', 'item_spans_ranges') then item_idx end as item_idx, case when outcome in ('kept', 'item_spans_ranges') then n_ranges end as n_ranges from n")
def zoom_notes(spark, sf_dir):
    r, i = _ranges_and_items(spark, sf_dir)
    return M.apply_zooms(_asked(r), r, i)[2]


@query(OWNED + """ select 'range' as held, edit_id, range_idx as idx, coalesce(zoom, zoom_pct)::integer as zoom_pct from r left join l using (edit_id, range_idx)
  union all select 'item', edit_id, item_idx, coalesce(zoom, zoom_pct)::integer from items left join (select edit_id, item_idx, arg_max(zoom_pct, seq) as zoom from n where outcome = 'kept' group by all) using (edit_id, item_idx)""")
def apply_zooms(spark, sf_dir):
    r, i = _ranges_and_items(spark, sf_dir)
    r, i, _ = M.apply_zooms(_asked(r), r, i)
    return r.select(F.lit("range").alias("held"), "edit_id", F.col("range_idx").alias("idx"), "zoom_pct").unionByName(i.select(F.lit("item").alias("held"), "edit_id", F.col("item_idx").alias("idx"), "zoom_pct"))


@query(OWNED + """ select 'range' as held, edit_id, range_idx as idx, coalesce(video_start, start_us) as start_us, end_us + case when audio_source is not null then coalesce(video_start - start_us, 0) else 0 end as end_us
    from r left join l using (edit_id, range_idx)
  union all select 'item', edit_id, item_idx, coalesce(s, start_us), end_us from items left join (select edit_id, item_idx, arg_max(video_start, seq) as s from o join l using (edit_id, range_idx) group by all) using (edit_id, item_idx)""")
def apply_starts(spark, sf_dir):
    r, i = _ranges_and_items(spark, sf_dir)
    r, i, _ = M.apply_starts(_asked(r), r, i)
    return r.select(F.lit("range").alias("held"), "edit_id", F.col("range_idx").alias("idx"), "start_us", "end_us").unionByName(i.select(F.lit("item").alias("held"), "edit_id", F.col("item_idx").alias("idx"), "start_us", "end_us"))
