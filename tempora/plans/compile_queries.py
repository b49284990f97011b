"""Plans compiled item by item, with their oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import RANGES_CTE, ranges, recordings, words
from ..operators import compiling as K
from ..registry import query
from .cut_queries import CUTS, SNAPPED, _cuts
from .speech_queries import WR


def _items(spark, sf_dir, r):
    """Items of several recordings an edit: some dropped, some with another recording's voice, some edits in an order of their own; a few that must be refused."""
    n, edit = F.col("range_idx"), F.col("edit_id")
    each = ranges(spark, sf_dir).crossJoin(F.broadcast(r.agg(F.max("source_id").alias("most"))))  # one row
    source = (edit * 7 + F.floor(n / 3)) % (F.col("most") + 1) + F.when(edit % 41 == 0, F.col("most") + 1).otherwise(0)
    length = F.col("end_us") - F.col("start_us")
    voiced = n % 4 == 2
    return each.select(
        "edit_id", F.col("range_idx").alias("item_idx"), F.when(edit % 3 == 0, 20 - n).alias("order_no"), F.when((n % 5 == 4) | (edit % 29 == 0), "drop").when(n % 5 == 3, "tighten").otherwise("keep").alias("action"),
        source.alias("source_id"), "start_us", (F.col("start_us") + F.when(voiced & (edit % 13 != 0), length * 2).otherwise(length)).alias("end_us"),
        F.when(voiced, (source + 1) % (F.col("most") + 1)).alias("audio_source"), F.when(voiced, F.col("start_us") - 200_000).alias("audio_start"), F.when(voiced, F.col("end_us")).alias("audio_end"),
        "speed_pct", "zoom_pct", "beat",
    )


ITEMS = """
most as (select max(source_id) as most from recordings), base as (
  select r.*, (edit_id * 7 + range_idx // 3) % (most + 1) + case when edit_id % 41 = 0 then most + 1 else 0 end as src, most, range_idx % 4 = 2 as voiced from ranges0 r, most
), items as (
  select edit_id, range_idx as item_idx, case when edit_id % 3 = 0 then 20 - range_idx end as order_no, case when range_idx % 5 = 4 or edit_id % 29 = 0 then 'drop' when range_idx % 5 = 3 then 'tighten' else 'keep' end as action,
    src as source_id, start_us, start_us + (end_us - start_us) * case when voiced and edit_id % 13 <> 0 then 2 else 1 end as end_us,
    case when voiced then (src + 1) % (most + 1) end as audio_source, case when voiced then start_us - 200000 end as audio_start, case when voiced then end_us end as audio_end, speed_pct, zoom_pct, beat from base
), kept as (select *, coalesce(audio_source, source_id) as heard, coalesce(audio_start, start_us) as lo, coalesce(audio_end, end_us) as hi from items where action in ('keep', 'tighten')),
ranges as (select edit_id, item_idx as range_idx, heard as source_id, lo as start_us, hi as end_us from kept where heard in (select source_id from recordings))"""

COMPILED = "with recursive " + WR.removeprefix("with ") + "," + RANGES_CTE.replace("ranges as (", "ranges0 as (") + "," + CUTS + "," + ITEMS + "," + SNAPPED + """,
held as (select k.*, s.snap_start as low, s.snap_end as high from kept k join snapped s on k.edit_id = s.edit_id and k.item_idx = s.range_idx),
dubbed as (select *, high - low as voice, high - low > floor((end_us - start_us) * 100 / speed_pct) + 1000 as outlasts from held where audio_source is not null),
refused as (
  select edit_id, item_idx, 'no_transcript' as problem, null::bigint as at_least_us, null::bigint as at_most_pct from kept where heard not in (select source_id from recordings)
  union all select edit_id, item_idx, 'voice_outlasts_picture', start_us + (voice * speed_pct) // 100, case when (end_us - start_us) * 100 // voice >= 25 then (end_us - start_us) * 100 // voice end from dubbed where outlasts
), own as (select * from held where audio_source is null),
hit as (select o.edit_id, o.item_idx, o.low, o.high, c.cut_id, c.cut_start, c.cut_end from own o join cuts c on o.source_id = c.source_id and c.cut_end > o.low and c.cut_start < o.high),
g as (select *, greatest(low, coalesce(max(cut_end) over (partition by edit_id, item_idx order by cut_start, cut_end, cut_id rows between unbounded preceding and 1 preceding), low)) as f from hit),
n as (select *, sum(case when cut_start > f then 1 else 0 end) over (partition by edit_id, item_idx order by cut_start, cut_end, cut_id rows unbounded preceding) as p from g),
ids as (select edit_id, item_idx, p, string_agg(cut_id, ',' order by cut_start, cut_end, cut_id) as cut_ids from n group by all),
cut_pieces as (
  select edit_id, item_idx, p - 1 as p, f as a, cut_start as b from n where cut_start > f
  union all select edit_id, item_idx, max(p), max(cut_end), min(high) from n group by edit_id, item_idx having max(cut_end) < min(high)
), pieces as (
  select edit_id, item_idx, p, a, b, coalesce(cut_ids, '') as cut_ids from cut_pieces left join ids using (edit_id, item_idx, p)
  union all select edit_id, item_idx, 0, low, high, '' from own o where not exists (from hit h where h.edit_id = o.edit_id and h.item_idx = o.item_idx)
), every as (
  select o.edit_id, o.item_idx, coalesce(order_no, o.item_idx) as place, p, source_id, a as start_us, b as end_us, null::bigint as audio_source, null::bigint as audio_start, null::bigint as audio_end, speed_pct, zoom_pct, beat, cut_ids,
    source_id as heard, a as s0, b as s1 from own o join pieces using (edit_id, item_idx) where b - a >= 80000
  union all select edit_id, item_idx, coalesce(order_no, item_idx), 0, source_id, start_us, start_us + (voice * speed_pct) // 100, audio_source, low, high, speed_pct, zoom_pct, beat, '', heard, low, high from dubbed where not outlasts
), good as (select * from every where edit_id not in (select edit_id from refused)),
refusals as (
  select * from refused union all select distinct edit_id, null::bigint, 'nothing_left', null::bigint, null::bigint from items where edit_id not in (select edit_id from good) and edit_id not in (select edit_id from refused)
)"""


@query(COMPILED + " select * from refusals")
def compile_refusals(spark, sf_dir):
    return K.compile_refusals(*_given(spark, sf_dir))


@query(COMPILED + """, q as (
  select s.heard, s0, s1, substr(string_agg(word, ' ' order by idx), 1, 300) as quote from (select distinct heard, s0, s1 from good) s join words w on w.source_id = s.heard and w.start_us >= s0 and w.end_us <= s1 group by all
), e as (select *, row_number() over (partition by edit_id order by place, item_idx, p) as i from good), f as (
  select edit_id, i, start_us as a, end_us as b, null::bigint as seam, null::varchar as how from e where i = 1
  union all select edit_id, i, case when meets then mid else start_us end, end_us, case when meets then mid end, case when meets then case when zoom_pct = z then 'continuous' else 'punch' end end from (
    select *, coalesce(same and start_us - pb < 300000 and start_us > pa and end_us > pb and mid - pa >= 80000 and end_us - mid >= 80000, false) as meets from (
      select e.*, f.a as pa, f.b as pb, p.zoom_pct as z, (f.b + e.start_us) // 2 as mid, e.source_id = p.source_id and e.speed_pct = 100 and p.speed_pct = 100 and e.audio_source is null and p.audio_source is null as same
      from f join e on e.edit_id = f.edit_id and e.i = f.i + 1 join e p on p.edit_id = f.edit_id and p.i = f.i))
) select f.edit_id, (f.i - 1)::bigint as range_idx, item_idx, source_id, a as start_us, coalesce(lead(seam) over (partition by f.edit_id order by f.i), b) as end_us, audio_source, audio_start, audio_end, speed_pct, zoom_pct, beat,
  coalesce(quote, '') as quote, cut_ids, how as transition_in from f join e using (edit_id, i) left join q using (heard, s0, s1)""")
def compile_items(spark, sf_dir):
    return K.compile_items(*_given(spark, sf_dir))[0]


def _given(spark, sf_dir):
    w = words(spark, sf_dir)
    r = recordings(w)
    return _items(spark, sf_dir, r), _cuts(w), w, r
