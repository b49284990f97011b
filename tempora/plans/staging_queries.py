"""Queries over quotes, stages, props and pinned labels, with their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import RANGES_CTE, ranges, recordings, table, words
from ..functions.scalars import word_key
from ..operators import staging as G
from ..operators import timeline as T
from ..registry import query
from .audit_queries import COMMON
from .speech_queries import BARE, NORM, W, WR
from .timeline_queries import R

N = "n as (select source_id, idx, word, start_us, end_us, " + NORM + " as key, row_number() over (partition by source_id order by idx) as pos from words)"
NQ = NORM.replace("word", "x")


def _ranked(w, n):
    """(key, r): the n most frequent words by rank."""
    k = w.select(word_key(F.col("word")).alias("key")).where(F.length("key") >= 4).groupBy("key").count().orderBy(F.desc("count"), "key").limit(n)
    return k.withColumn("r", F.row_number().over(Window.orderBy(F.desc("count"), "key"))).select("key", "r")


@query(WR + "," + COMMON + "," + N + rf""", a as (select *, lead(key) over o as after, list({{'w': word, 's': start_us, 'e': end_us, 'x': regexp_matches({BARE}, '[.!?…]$')}}) over f as ahead
    from n window o as (partition by source_id order by idx), f as (partition by source_id order by idx rows between 1 following and 13 following)),
  v as (select *, coalesce(after in (select key from lx where r between 21 and 60), false) as t from a where key in (select key from lx where r <= 20)),
  l as (select *, ahead[case when t then 2 else 1 end : case when t then 13 else 12 end] as line from v where t or trim(word) like '%:'),
  c as (select *, list_position(list_transform(line, lambda z: z.x), true) as stop from l),
  d as (select source_id, case when stop > 0 then line[1:stop] else line end as line from c),
  said as (select source_id, line[1].s as first, line[-1].e as last, array_to_string(list_transform(line, lambda z: z.w), ' ') as text, 'said' as why from d where len(line) >= 2),
  q as (select source_id, idx as quote_id, lower(word) || '  ' || lead(word) over o || ' ' || lead(word, 2) over o as text from words window o as (partition by source_id order by idx) qualify idx % 50 = 7),
  k as (select source_id, quote_id, list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda x: {NQ}), lambda x: x <> '') as ks from q where text is not null),
  s as (select a.source_id, quote_id, min(a.pos) as pos, any_value(len(ks)) as n from n a join k on a.source_id = k.source_id and len(ks) > 0 and a.key = ks[1]
    where (len(ks) < 2 or exists (from n b where b.source_id = a.source_id and b.pos = a.pos + 1 and b.key = ks[2])) and (len(ks) < 3 or exists (from n b where b.source_id = a.source_id and b.pos = a.pos + 2 and b.key = ks[3])) group by 1, 2),
  quoted as (select s.source_id, min(start_us) as first, max(end_us) as last, string_agg(word, ' ' order by n.pos) as text, 'quoted' as why from s join n on n.source_id = s.source_id and n.pos between s.pos and s.pos + s.n - 1 group by s.source_id, quote_id),
  u as (select e.*, duration_us, greatest(300000, first) as s from (from said union all from quoted) e join recordings using (source_id)),
  b as (select source_id, s as start_us, least(duration_us, s + 6000000, greatest(last + 800000, s + 1500000)) as end_us, regexp_replace(text, '^[,;:.\- –]+|[,;:.\- –]+$', '', 'g') as t, why from u)
  select source_id, start_us, end_us, case t[1] when 'ß' then 'SS' else upper(t[1]) end || substr(t, 2) as text, why from b where length(t) between 1 and 60 and end_us - start_us >= 1200000""")
def quotes(spark, sf_dir):
    """Frequent words as verbs of speech and as conjunctions; three words of every fifty as lines of a brief."""
    w = words(spark, sf_dir)
    r = _ranked(w, 60)
    order = Window.partitionBy("source_id").orderBy("idx")
    text = F.concat(F.lower("word"), F.lit("  "), F.lead("word").over(order), F.lit(" "), F.lead("word", 2).over(order))
    q = w.select("source_id", F.col("idx").alias("quote_id"), text.alias("text")).where("quote_id % 50 = 7 and text is not null")
    return G.quotes(w, recordings(w), r.where("r <= 20"), r.where("r > 20"), q)


@query(WR + "," + COMMON + "," + N + r""", m as (select n.*, r, case when r <= 10 then 'first' when r <= 40 then 'then' when r <= 60 then 'last' end as kind, coalesce(r between 61 and 80, false) as skip from n left join (select * from lx where r <= 80) using (key)),
  g as (select *, arg_min(case when not skip then {'w': word, 's': start_us} end, case when not skip then pos end) over (partition by source_id order by idx rows between 1 following and unbounded following) as stage from m),
  x as (select *, sum((kind = 'first')::int) over o as run, pos - lag(pos) over o - 1 as gap from g where kind is not null window o as (partition by source_id order by idx)),
  y as (select *, max(case when kind <> 'first' and gap > 12 then 1 else 0 end) over (partition by source_id, run order by pos) as broken from x where run > 0),
  z as (select *, row_number() over (partition by source_id, run order by pos) as nth, count(*) over (partition by source_id, run) as k, regexp_replace(stage.w, '^[,.;:!?"''„”()…]+|[,.;:!?"''„”()…]+$', '', 'g') as label from y where broken = 0),
  p as (select source_id, run, bool_and(coalesce(length(label) between 1 and 12, false)) as ok, min(start_us) as first, count(*) as n_stages, list(label order by nth) as ls, list(stage.s order by nth) as ts from z where k >= 2 and nth <= 5 group by 1, 2),
  e as (select p.*, greatest(300000, first) as s, least(duration_us, greatest(ts[-1], greatest(300000, first)) + 2500000) as e from p join recordings using (source_id) where ok)
  select source_id, s as start_us, e as end_us, n_stages, array_to_string(ls, ' | ') as stages, array_to_string(ts, ',') as times from e where e - s >= 2500000 and ts[1] >= s""")
def sequences(spark, sf_dir):
    """Frequent words by rank as first, then and last, and as words that are passed over."""
    w = words(spark, sf_dir)
    r = _ranked(w, 80)
    kind = F.when(F.col("r") <= 10, "first").when(F.col("r") <= 40, "then").otherwise("last")
    return G.sequences(w, recordings(w), r.where("r <= 60").select("key", kind.alias("kind")), r.where("r > 60"))


@query("with recursive " + WR[5:] + "," + COMMON + "," + N + """, lib as (select p_partkey as prop_id, p_partkey % 7 as ord, key as tag from part join lx on r = 1 + p_partkey % 90 where p_partkey <= 200),
  wk as (select source_id, idx, start_us, regexp_replace(lower(word), '[^\\p{L}\\p{N}]', '', 'g') as wkey, key from n),
  h as (select source_id, idx, start_us, prop_id, ord, max(key = tag) as exact from wk join lib on key = tag or wkey = tag or (length(wkey) >= 5 and length(tag) >= 5 and left(wkey, 5) = left(tag, 5)) or (length(tag) >= 4 and starts_with(wkey, tag) and length(wkey) - length(tag) <= 3) group by all),
  c as (select h.*, row_number() over (partition by source_id order by idx, ord, prop_id) as k from h join recordings using (source_id) where start_us >= 300000 and start_us + 2500000 <= duration_us),
  t as (select source_id, min(k) as k, 0::bigint as idx, [-1::bigint] as used from c group by 1
    union all select source_id, (select min(k) from c where c.source_id = b.source_id and c.idx > b.word and not list_contains(b.taken, c.prop_id)), word, taken
    from (select t.source_id, c.idx as word, list_append(used, c.prop_id::bigint) as taken from t join c on c.source_id = t.source_id and c.k = t.k) b)
  select c.source_id, c.prop_id::bigint as prop_id, c.idx, c.start_us, c.start_us + 2500000 as end_us, exact from t join c on c.source_id = t.source_id and c.k = t.k""")
def props(spark, sf_dir):
    """Parts as props, each named by one of the 90 most frequent words, so that many share a name."""
    w = words(spark, sf_dir)
    lib = table(spark, sf_dir, "part").where("p_partkey <= 200").withColumn("r", 1 + F.col("p_partkey") % 90).join(_ranked(w, 90), "r")
    return G.props(w, recordings(w), lib.select(F.col("p_partkey").cast("long").alias("prop_id"), (F.col("p_partkey") % 7).alias("ord"), F.col("key").alias("keyword")))


@query(R + """, b as (select edit_id, range_idx as label_idx, case when edit_id % 2 = 0 then lower(beat) || ' ' else 'Scene ' || range_idx % 4 // 2 end as text, range_idx * 1400000 as start_us, range_idx * 1400000 + 2700000 as end_us from line where range_idx % 3 < 2),
  t as (select edit_id, max(output_end) as total from line group by 1), sc as (select edit_id, lower(beat) as key, min(output_start) as s0, max(output_end) as s1 from line group by 1, 2),
  cu as (select distinct edit_id, output_start as cut from line union select edit_id, total from t),
  g as (select b.*, total, lower(trim(text)) as key, least(end_us, total) as own, s0, s1 from b join t using (edit_id) left join sc on sc.edit_id = b.edit_id and sc.key = lower(trim(text))),
  m as (select g.*, (select arg_min(cut, (abs(cut - start_us), cut)) from cu where cu.edit_id = g.edit_id and abs(cut - start_us) <= 1500000) as c0, (select arg_min(cut, (abs(cut - own), cut)) from cu where cu.edit_id = g.edit_id and abs(cut - own) <= 1500000) as c1 from g),
  n as (select *, coalesce(s0, c0, start_us) as q0, least(coalesce(s1, c1, own), total) as q1 from m),
  p as (select edit_id, label_idx, text, key, case when q1 - q0 < 500000 then start_us else q0 end as p0, case when q1 - q0 < 500000 then own else q1 end as p1 from n),
  r as (select *, sum(ch) over (partition by edit_id order by p0, p1, label_idx) as turn from (select *, case when key is not distinct from lag(key) over (partition by edit_id order by p0, p1, label_idx) then 0 else 1 end as ch from p)),
  i as (select *, sum(op) over (partition by edit_id, turn order by p0, p1, label_idx) as island from (select *, case when p0 - max(p1) over (partition by edit_id, turn order by p0, p1, label_idx rows between unbounded preceding and 1 preceding) < 300000 then 0 else 1 end as op from r)),
  o as (select edit_id, turn, island, arg_min(label_idx, (p0, p1, label_idx)) as label_idx, arg_min(text, (p0, p1, label_idx)) as text, min(p0) as p0, max(p1) as p1, count(*) - 1 as n_joined from i group by 1, 2, 3),
  x as (select *, lead(p0) over (partition by edit_id order by turn, island) as nx from o)
  select edit_id, label_idx, text, p0 as start_us, case when (abs(nx - p1) < 300000 or p1 > nx) and nx - p0 >= 500000 then nx else p1 end as end_us, n_joined,
    case when (abs(nx - p1) < 300000 or p1 > nx) and nx - p0 < 500000 then 'shares its scene with the next' end as problem from x""")
def pin_labels(spark, sf_dir):
    """Two labels for every three ranges: beats of the edit, or texts that are none."""
    line = T.timeline(ranges(spark, sf_dir))
    k = F.col("range_idx")
    text = F.when(F.col("edit_id") % 2 == 0, F.concat(F.lower("beat"), F.lit(" "))).otherwise(F.concat(F.lit("Scene "), F.floor(k % 4 / 2).cast("string")))
    labels = line.where(k % 3 < 2).select("edit_id", k.alias("label_idx"), text.alias("text"), (k * 1_400_000).alias("start_us"), (k * 1_400_000 + 2_700_000).alias("end_us"))
    return G.pin_labels(labels, line)


SHOTS = RANGES_CTE + """, shots as (select edit_id, source_id + case when edit_id % 5 = 0 then 60 else 0 end as source_id, start_us + 3210000 as start_us, start_us + 6000000 + edit_id % 7 * 310000 as end_us from ranges where range_idx = 0)"""


def _shots(r):
    k = F.col("edit_id")
    return r.where("range_idx = 0").select(
        "edit_id", (F.col("source_id") + F.when(k % 5 == 0, 60).otherwise(0)).alias("source_id"), (F.col("start_us") + 3_210_000).alias("start_us"), (F.col("start_us") + 6_000_000 + k % 7 * 310_000).alias("end_us")
    )


@query("with " + SHOTS + """ select r.edit_id, range_idx, case when range_idx = 0 then s.source_id else r.source_id end as source_id, case when range_idx = 0 then s.start_us else r.start_us end as start_us,
  case when range_idx = 0 then s.end_us else r.end_us end as end_us from ranges r join shots s using (edit_id)""")
def first_shot(spark, sf_dir):
    """A later piece of the same recording, or of another one in every fifth edit."""
    r = ranges(spark, sf_dir)
    return G.first_shot(r, _shots(r)).select("edit_id", "range_idx", "source_id", "start_us", "end_us")


@query(W + "," + SHOTS + rf""", m as (select s.edit_id, s.start_us as s, s.end_us as e, idx, w.start_us as w0, w.end_us as w1, regexp_matches({BARE}, '[.!?…]$') as ended from shots s join words w on w.source_id = s.source_id and w.end_us > s.start_us - 600000 and w.start_us < s.end_us + 600000),
  t as (select edit_id, arg_max(ended, idx) filter (w1 <= s) as before, arg_max(ended, idx) filter (w0 >= s and w1 <= e) as last, coalesce(bool_or(w0 >= e), false) as goes_on from m group by 1),
  o as (select s.*, t.before, t.last, t.goes_on, r.source_id as old from shots s join ranges r on r.edit_id = s.edit_id and r.range_idx = 0 left join t on t.edit_id = s.edit_id)
  select edit_id, 'starts mid-sentence' as warning, null::bigint as range_idx from o where not before union all select edit_id, 'ends mid-sentence', null from o where not last and goes_on
  union all select edit_id, 'no transcript', null from o where source_id not in (select source_id from words) union all select edit_id, 'other source', null from o where source_id <> old
  union all select o.edit_id, 'repeats footage', r.range_idx from o join ranges r on r.edit_id = o.edit_id and r.source_id = o.source_id and r.range_idx > 0 and r.start_us < o.end_us and o.start_us < r.end_us""")
def first_shot_warnings(spark, sf_dir):
    r = ranges(spark, sf_dir)
    return G.first_shot_warnings(r, _shots(r), words(spark, sf_dir))
