"""Queries over first drafts and variants, with their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import RANGES_CTE, WORDS_CTE, ranges, recordings, table, words
from ..operators import cuts as C
from ..operators import drafts as D
from ..operators import timeline as T
from ..registry import query
from ..sources.shared import written
from .audit_queries import COMMON, MOVES, _common, _moves
from .speech_queries import BARE, NORM, SPACING, W, WR
from .timeline_queries import CUES, R, _cues, _line

ENDS = rf"regexp_matches({BARE}, '[.!?…,;:\-–—]$')"


@query(WR + "," + SPACING + "," + COMMON + r""", k as (
  select source_id, idx, start_us, end_us, lower(regexp_replace(word, '^[.,!?;:]+|[.,!?;:]+$', '', 'g')) as key from words
),
e as (select source_id, arg_min(start_us, idx) as first, arg_max(end_us, idx) as final from words group by 1)
select source_id, 'dead air' as reason, start_us + 60000 as start_us, end_us - 60000 as end_us from sp where end_us - start_us >= 600000
union all select source_id, 'filler', start_us, end_us from k where key in (select key from lx where r <= 40)
  and exists (from sp where sp.source_id = k.source_id and sp.end_us = k.start_us) and exists (from sp where sp.source_id = k.source_id and sp.start_us = k.end_us)
union all select source_id, 'lead in', 0, greatest(0, first - 80000) from e where first > 600000
union all select source_id, 'tail', final + 80000, duration_us from e join recordings using (source_id) where duration_us - final > 600000""")
def draft_plan(spark, sf_dir):
    """The 40 most frequent words stand for fillers."""
    w = words(spark, sf_dir)
    return D.draft_plan(w, recordings(w), _common(w, 40), 600_000, 120_000, 80_000).where("reason <> 'false start'")


@query("with recursive " + WORDS_CTE + """, k as (select source_id, start_us, end_us, lower(regexp_replace(substr(word, 1, 1), '^[.,!?;:]+|[.,!?;:]+$', '', 'g')) as letter, idx, row_number() over (partition by source_id order by idx) as pos from words
), l as (select *, """ + ", ".join(f"lead(letter, {j}) over o as k{j}" for j in range(6)) + """, lead(end_us, 2) over o as last from k window o as (partition by source_id order by idx)),
d as (select * from l where k0 = k3 and k1 = k4 and k2 = k5 and k0 <> '' and k1 <> '' and k2 <> ''),
r as (select source_id, min(pos) as pos from d group by 1 union all select r.source_id, min(d.pos) from r join d on d.source_id = r.source_id and d.pos >= r.pos + 6 group by r.source_id, r.pos)
select source_id, 'false start' as reason, start_us, last as end_us from d join r using (source_id, pos)""")
def draft_repeats(spark, sf_dir):
    """Words by their first letter, so that the invented texts repeat phrases."""
    w = words(spark, sf_dir)
    return D.draft_plan(w.withColumn("word", F.substring("word", 1, 1)), recordings(w), _common(w, 1), 600_000, 120_000, 80_000).where("reason = 'false start'")


@query(R + """, q as (select *, beat || ' shot ' || range_idx as text, (output_start + 500) // 1000 * 1000 as a, (output_end + 500) // 1000 * 1000 as b from line),
  t as (select *, unnest(string_split(text, ' ')) as word, generate_subscripts(string_split(text, ' '), 1) - 1 as pos from q),
  u as (select *, sum(length(word) + 1) over (partition by edit_id, range_idx order by pos) as upto, sum(length(word) + 1) over (partition by edit_id, range_idx) as total from t)
  select edit_id, range_idx as cue_idx, pos::bigint as pos, word, (a + floor((b - a) * (upto - length(word) - 1) / total))::bigint as start_us, (a + floor((b - a) * upto / total))::bigint as end_us from u""")
def story_cues(spark, sf_dir):
    """The beat and number of each range as its quote, with estimated words."""
    quote = F.concat("beat", F.lit(" shot "), F.col("range_idx").cast("string"))
    return T.estimated_words(D.story_cues(_line(spark, sf_dir).withColumn("quote", quote)))


@query(CUES + """, t as (select *, (start_us + 500) // 1000 as a, (end_us + 500) // 1000 as b from cues)
  select edit_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(printf('%02d:%02d:%02d.%03d', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000) || ' --> '
    || printf('%02d:%02d:%02d.%03d', b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000) || chr(10) || text || chr(10), chr(10) order by start_us, cue_idx) as vtt from t group by edit_id""")
def export_vtt(spark, sf_dir):
    return D.export_vtt(_cues(spark, sf_dir))


@query("""select o_orderkey as candidate_id, o_custkey as source_id, 0::bigint as start_us, floor(o_totalprice)::bigint * 50 as end_us,
  case when c_custkey is null then 'unknown source' when floor(o_totalprice)::bigint * 50 < 3000000 then 'fragment' end as problem
  from orders left join (select c_custkey from customer where c_custkey % 3 > 0) on c_custkey = o_custkey where o_orderstatus <> 'F'""")
def select_shorts(spark, sf_dir):
    """Orders as candidates, two thirds of the customers as known sources."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("candidate_id"), F.col("o_custkey").alias("source_id"), F.lit(0).cast("long").alias("start_us"), (F.floor("o_totalprice") * 50).alias("end_us"), (F.col("o_orderstatus") != "F").alias("selected")
    )
    return D.select_shorts(o, table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("source_id")))


@query(WR + "," + COMMON + rf""" select source_id, idx, start_us, least(duration_us, start_us + 1300000) as end_us, 1105 as scale_permille from words join recordings using (source_id)
  where {NORM} in (select key from lx where r <= 20) and least(duration_us, start_us + 1300000) - start_us >= 400000""")
def contrasts(spark, sf_dir):
    w = words(spark, sf_dir)
    return D.contrasts(w, recordings(w), _common(w, 20), 115)


@query(WR + "," + COMMON + rf""", n as (select source_id, idx, word, start_us, end_us, {NORM} as key, {ENDS} as e, row_number() over (partition by source_id order by idx) as pos from words),
  a as (select *, lead(key) over o as after, list(word) over f as ws, list(e) over f as es from n window o as (partition by source_id order by idx), f as (partition by source_id order by idx rows between current row and 5 following)),
  mk as (select key as first, null as second from lx where r between 1 and 3 union all select a.key, b.key from lx a, lx b where a.r between 4 and 12 and b.r between 4 and 12),
  m as (select a.*, case when second is null then 1 else 2 end as size from a join mk on key = first and (second is null or second = after)),
  x as (select *, lead(pos) over (partition by source_id order by pos, size) as nxt from m),
  y as (select *, greatest(0, least(4, coalesce(nxt - pos - size, 4), len(ws) - size)) as room from x),
  z as (select *, ws[size + 1 : size + room] as said, list_position(es[size + 1 : size + room], true) as stop from y),
  i as (select *, substr(regexp_replace(array_to_string(case when stop > 0 then said[1:stop] else said end, ' '), '^[,.;:!?]+|[,.;:!?]+$', '', 'g'), 1, 60) as item from z),
  p as (select source_id, list_filter(list(item order by pos, size), lambda t: t <> '') as xs, min(start_us) as s, arg_max(end_us, pos) as last, count(*) as k from i group by 1)
  select source_id, s as start_us, least(duration_us, greatest(last + 2000000, s + 2500000)) as end_us, least(5, len(xs))::bigint as n_items, array_to_string(xs[1:5], ' | ') as items
  from p join recordings using (source_id) where k >= 2 and len(xs) >= 2""")
def steps(spark, sf_dir):
    """Three frequent words, and pairs of nine further ones, as markers."""
    w = words(spark, sf_dir)
    r = _common(w, 12)
    n = w.select(F.regexp_replace(F.lower("word"), r"[^\p{L}\p{N}]", "").alias("key")).groupBy("key").count().join(r, "key", "left_semi")
    k = n.withColumn("r", F.row_number().over(Window.orderBy(F.desc("count"), "key")))
    pairs = k.where("r > 3").select(F.col("key").alias("first"), F.lit(1).alias("j")).join(k.where("r > 3").select(F.col("key").alias("second"), F.lit(1).alias("j")), "j").select("first", "second")
    return D.steps(w, recordings(w), k.where("r <= 3").select(F.col("key").alias("first"), F.lit(None).cast("string").alias("second")).unionByName(pairs))


@query(WR + """, g as (select source_id, 0 as at_us from recordings union all select source_id, start_us from words join recordings using (source_id) where word like '%.' and start_us > 0 and start_us < duration_us),
  s as (select *, row_number() over o as shot, coalesce(lead(at_us) over o, duration_us) as until, count(*) over (partition by source_id) as n from g join recordings using (source_id) window o as (partition by source_id order by at_us))
  select source_id, shot, ((at_us + until) // 2)::bigint as at_us, (until - at_us)::bigint as length_us from s
  where n <= 12 or list_contains(list_transform(range(12), lambda i: round_even(i * (n - 1) / 11.0::double, 0)::bigint + 1), shot)""")
def sheet_moments(spark, sf_dir):
    """Sentence ends stand for cuts."""
    w = words(spark, sf_dir)
    return D.sheet_moments(w.where(F.col("word").endswith(".")).select("source_id", F.col("start_us").alias("at_us")), recordings(w))


@query("""with p as (select p_partkey as edit_id, p_brand as a, p_type as t, p_brand as b, p_name as f, p_type as s from part),
  c as (select edit_id, upper(a) as a, t || case when edit_id % 2 = 0 then 'x' else '' end as t, lower(b) as b, case when edit_id % 3 = 0 then 'Sans' else f end as f, s || '' as s from p)
  select * from (select p.edit_id, unnest(['text_color', 'font_family']) as field, unnest([p.t, p.f]) as mine, unnest([c.t, c.f]) as theirs from p join c using (edit_id))
  where lower(mine) <> lower(theirs)""")
def brand_overrides(spark, sf_dir):
    """Parts as plans; every second contract has another colour, every third another font, the rest differs in case only."""
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("edit_id"), F.col("p_brand").alias("accent_color"), F.col("p_type").alias("text_color"), F.col("p_brand").alias("background_color"), F.col("p_name").alias("font_family"), F.col("p_type").alias("style")
    )
    c = p.select(
        "edit_id", F.upper("accent_color").alias("accent_color"), F.concat("text_color", F.when(F.col("edit_id") % 2 == 0, "x").otherwise("")).alias("text_color"), F.lower("background_color").alias("background_color"),
        F.when(F.col("edit_id") % 3 == 0, "Sans").otherwise(F.col("font_family")).alias("font_family"), "style",
    )
    return D.brand_overrides(p, c)


@query(R + "," + MOVES + """, lim as (select o_orderkey as edit_id, 110 + o_custkey % 10 as most, o_custkey % 5 * 25 as intensity from orders),
  p as (select edit_id, start_us, 100 + move_id % 30 as scale from mv where kind = 'punch_in')
  select edit_id, 'zoom' as what, output_start as at_us, zoom_pct::bigint as scale_pct from line join lim using (edit_id) where zoom_pct > most
  union all select edit_id, 'punch-in', start_us, scale from p join lim using (edit_id) where intensity > 0 and scale > most
  union all select edit_id, 'no movement allowed', min(start_us), max(scale) from p join lim using (edit_id) where intensity <= 0 group by edit_id""")
def movement_limits(spark, sf_dir):
    lim = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("edit_id"), (110 + F.col("o_custkey") % 10).alias("most_pct"), (F.col("o_custkey") % 5 * 25).alias("intensity_pct"))
    p = _moves(spark, sf_dir).where("kind = 'punch_in'").select("edit_id", "start_us", (100 + F.col("move_id") % 30).alias("scale_pct"))
    return D.movement_limits(_line(spark, sf_dir), p, lim)


@query(R + "," + MOVES + """ select edit_id, start_us + least(600000, (end_us - start_us) // 2) as at_us, kind as label from mv where kind <> 'punch_in'
  union all select edit_id, start_us + (end_us - start_us) // 2, 'punch-in ' || (100 + move_id % 30) from mv where kind = 'punch_in'
  union all select edit_id, output_start, beat || ' transition' from line where range_idx > 0""")
def review_moments(spark, sf_dir):
    m = _moves(spark, sf_dir)
    return D.review_moments(
        m.where("kind <> 'punch_in'"), m.where("kind = 'punch_in'").withColumn("scale_pct", 100 + F.col("move_id") % 30),
        _line(spark, sf_dir).where("range_idx > 0").select("edit_id", F.col("output_start").alias("at_us"), F.col("beat").alias("style")),
    )


@query(r"""with b as (select item_id as brief_id, string_split(text, ' ')[1] as w, case when regexp_extract(text, '^([\s\S]*?[.!?…])(?:\s|$)', 1) = '' then text else regexp_extract(text, '^([\s\S]*?[.!?…])(?:\s|$)', 1) end as s from benchmark),
  t as (select brief_id, case item_id_mod when 0 then upper(s) when 1 then w else '' end as a, trim(s) as s from (select *, brief_id % 3 as item_id_mod from b))
  select brief_id, 1::bigint as nth, case when trim(a) <> '' then trim(a) else s end as line from t where trim(a) <> '' or s <> ''
  union all select brief_id, 2, s from t where trim(a) <> '' and s <> '' and lower(trim(a)) <> lower(s)""")
def variant_lines(spark, sf_dir):
    """Items as briefs: on screen the sentence in capitals (a capital sharp s, not two), its first word, or nothing."""
    from ..functions.scalars import first_sentence

    b = table(spark, sf_dir, "benchmark")
    k = F.col("item_id") % 3
    shown = F.when(k == 0, F.upper(F.translate(first_sentence(F.col("text")), "ß", "ẞ"))).when(k == 1, F.split("text", " ")[0]).otherwise("")
    rows = b.select(F.col("item_id").alias("brief_id"), F.lit(0).alias("row_idx"), F.array(shown).alias("on_screen"), F.col("text").alias("said"))
    later = rows.withColumns({"row_idx": F.lit(1), "said": F.lit("never the first row")})
    return D.variant_lines(rows.unionByName(later))


RUNNING = RANGES_CTE + """, ru as (select edit_id, range_idx, source_id, end_us - start_us + range_idx % 5 * 7001 as len, case when range_idx % 3 = 2 then 200000 else 0 end as gap, speed_pct, range_idx + 1 as i from ranges),
run as (select edit_id, range_idx, source_id, speed_pct, i, sum(len + gap) over o - len as start_us, sum(len + gap) over o as end_us from ru window o as (partition by edit_id order by range_idx)),
rb as (select *, round_even(sum(floor((end_us - start_us) * 100 / speed_pct)::bigint) over (partition by edit_id order by range_idx) * 30 / 1000000.0::double, 0)::bigint as b from run),
rf as (select edit_id, i, greatest(1, b) as bound, greatest(1, b) as frames from rb where i = 1
  union all select rb.edit_id, rb.i, greatest(rf.bound + 1, rb.b), greatest(rf.bound + 1, rb.b) - rf.bound from rf join rb on rb.edit_id = rf.edit_id and rb.i = rf.i + 1)"""


@query("with recursive " + RUNNING + """, e as (select * from run join rf using (edit_id, i)), f as (
  select edit_id, i, start_us as a, false as moved from e where i = 1
  union all select edit_id, i, case when ok then seam else start_us end, ok and seam <> start_us from (
    select e.*, f.a + (p.frames * 1000000 + 15) // 30 as seam,
      e.start_us = p.end_us and e.source_id = p.source_id and p.speed_pct = 100 and abs(f.a + (p.frames * 1000000 + 15) // 30 - e.start_us) * 30 <= 1000000 and f.a + (p.frames * 1000000 + 15) // 30 < e.end_us - 40000 as ok
    from f join e on e.edit_id = f.edit_id and e.i = f.i + 1 join e p on p.edit_id = f.edit_id and p.i = f.i)
) select edit_id, range_idx, a::bigint as start_us, (case when lead(moved) over w then lead(a) over w else end_us end)::bigint as end_us from f join e using (edit_id, i) window w as (partition by edit_id order by i)""")
def align_running_seams(spark, sf_dir):
    """Ranges that run on from each other, but for a gap before every third."""
    by = Window.partitionBy("edit_id").orderBy("range_idx").rowsBetween(Window.unboundedPreceding, 0)
    length = F.col("end_us") - F.col("start_us") + F.col("range_idx") % 5 * 7001
    gap = F.when(F.col("range_idx") % 3 == 2, 200_000).otherwise(0)
    r = ranges(spark, sf_dir).select("edit_id", "range_idx", "source_id", "speed_pct", length.alias("len"), F.sum(length + gap).over(by).alias("end_us"))
    run = r.withColumn("start_us", F.col("end_us") - F.col("len")).drop("len")
    return D.align_running_seams(C.allocate_frames(T.range_durations(run))).select("edit_id", "range_idx", "start_us", "end_us")


FIRST = r"""
fw as (select source_id as edit_id, idx, word, start_us as out_start, end_us as out_end from words where idx < 12),
fc as (select edit_id, 0 as cue_idx, min(out_start) as start_us, max(out_end) as end_us, string_agg(word, ' ' order by idx) as text from fw group by edit_id),
lines as (
  select edit_id, 0 as nth, string_agg(lower(word) || '!', ' ' order by idx) as line from fw where idx between 3 and 5 group by edit_id
  union all select edit_id, 1, lower(text) from fc union all select edit_id, 2, string_agg(word, ' ' order by idx desc) from fw where idx between 5 and 7 group by edit_id union all select edit_id, 3, '...' from fc
  union all select edit_id, 4, arg_min(word, idx) from fw group by edit_id
)"""


def _first_captions(spark, sf_dir):
    """(cues, words, lines): the first twelve words of each conversation as a caption; of the lines one is a run of it, one is all of it, one turns words round, one has no letters and one is a single word."""
    w = words(spark, sf_dir).where("idx < 12").select(F.col("source_id").alias("edit_id"), "idx", "word", F.col("start_us").alias("out_start"), F.col("end_us").alias("out_end"))
    ordered = F.array_sort(F.collect_list(F.struct("idx", "word")))
    per = w.groupBy("edit_id").agg(F.min("out_start").alias("start_us"), F.max("out_end").alias("end_us"), ordered.alias("ws"))
    said = lambda xs, f=lambda c: c: F.array_join(F.transform(xs, lambda x: f(x["word"])), " ")
    part = lambda lo, hi: F.filter("ws", lambda x: x["idx"].between(lo, hi))
    cues = per.select("edit_id", F.lit(0).alias("cue_idx"), "start_us", "end_us", said(F.col("ws")).alias("text"))
    run, turned = part(3, 5), F.reverse(part(5, 7))
    each = F.array(
        F.when(F.size(run) > 0, said(run, lambda c: F.concat(F.lower(c), F.lit("!")))), F.lower(said(F.col("ws"))), F.when(F.size(turned) > 0, said(turned)), F.lit("..."), F.col("ws")[0]["word"]
    )
    return cues, w, per.select("edit_id", F.posexplode(each).alias("nth", "line")).where("line is not null")


@query(W + "," + FIRST + r""", t as (
  select edit_id, nth, line, start_us, end_us, text, list_filter(list_transform(regexp_split_to_array(line, '\s+'), lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}_]', '', 'g')), lambda x: x <> '') as wanted from lines join fc using (edit_id)
), k as (select edit_id, list(struct_pack(word, out_start, out_end, k := key) order by idx) filter (key <> '') as said, list(struct_pack(word, out_start, out_end) order by idx) as ws from (select *, regexp_replace(lower(word), '[^\p{L}\p{N}_]', '', 'g') as key from fw) group by edit_id),
p as (
  select t.*, said, ws, list_filter(range(len(said) - len(wanted) + 1), lambda o: list_transform(said[o + 1:o + len(wanted)], lambda w: w.k) = wanted)[1] as spot, list_transform(said, lambda w: w.k) = wanted as whole from t join k using (edit_id) where len(wanted) > 0
)
select edit_id, nth, start_us, case when whole then end_us else said[spot + len(wanted)].out_end end as end_us,
  case when whole then text else array_to_string(list_transform(list_filter(ws, lambda w: w.out_start >= said[spot + 1].out_start and w.out_start <= said[spot + len(wanted)].out_start), lambda w: w.word), ' ') end as text
from p where whole or spot is not null""")
def verbatim_first_caption(spark, sf_dir):
    return D.verbatim_first_caption(*_first_captions(spark, sf_dir))


LABELLED = "with " + RANGES_CTE + """, labels as (
  select edit_id, range_idx * 1200000 as start_us, range_idx * 1200000 + 400000 + (end_us - start_us) // 2 as end_us, beat || range_idx as text, edit_id % 4 = 1 and range_idx = 0 as opening from ranges where edit_id % 5 > 0 or range_idx > 0
), openings as (select edit_id, 'opens ' || max(beat) as line, 2000000 + edit_id % 4 * 500000 as end_us from ranges where edit_id % 3 > 0 group by edit_id),
m as (select l.*, o.line, o.end_us as until from labels l left join openings o using (edit_id) where o.edit_id is null or not opening)"""


def _labels(spark, sf_dir):
    r, n = ranges(spark, sf_dir), F.col("range_idx")
    labels = r.where("edit_id % 5 > 0 or range_idx > 0").select(
        "edit_id", (n * 1_200_000).alias("start_us"), (n * 1_200_000 + 400_000 + F.floor((F.col("end_us") - F.col("start_us")) / 2)).alias("end_us"), F.concat("beat", n.cast("string")).alias("text"),
        ((F.col("edit_id") % 4 == 1) & (n == 0)).alias("opening"),
    )
    opened = r.where("edit_id % 3 > 0").groupBy("edit_id").agg(F.concat(F.lit("opens "), F.max("beat")).alias("line"))
    return labels, opened.withColumn("end_us", 2_000_000 + F.col("edit_id") % 4 * 500_000)


@query(LABELLED + """ select edit_id, case when start_us < until then until else start_us end as start_us, end_us, text, opening from m where until is null or start_us >= until or end_us - until >= 500000
  union all select edit_id, 0, end_us, line, true from openings""")
def opening_label(spark, sf_dir):
    return D.opening_label(*_labels(spark, sf_dir))[0]


@query(LABELLED + " select edit_id, coalesce(before, '') as before from openings left join (select edit_id, max(text) as before from m where start_us = 0 and until > 0 group by edit_id) using (edit_id)")
def displaced_label(spark, sf_dir):
    return D.opening_label(*_labels(spark, sf_dir))[1]


@query("with recursive " + WR.removeprefix("with ") + """, g as (select source_id, duration_us, greatest(0, duration_us - 250000) as last from recordings where source_id % 4 > 0
  union all select source_id, 600000 + source_id * 1000, 350000 + source_id * 1000 from recordings where source_id % 4 = 0),
fx as (select source_id, unnest([0] || list_filter([500000, 1000000, 1500000, 2000000, 2500000, 3000000], lambda t: t <= last))::bigint as at_us, last from g),
fl as (select source_id, at_us, case at_us when 0 then 'first' else 'opening' end as reason from fx union all select source_id, last, 'last' from g where not exists (from fx where fx.source_id = g.source_id and g.last - fx.at_us < 150000)),
cu as (select w.source_id, start_us as c, duration_us, last from words w join g using (source_id) where (word like '%.' or idx % 3 = 0) and start_us > 0 and start_us < duration_us),
ed as (select source_id, c, duration_us from cu union all select source_id, 0, duration_us from g),
op as (
  select source_id, 'cut' as reason, least(c + 50000, last) as at_us from cu
  union all select source_id, 'middle', (c + coalesce(lead(c) over (partition by source_id order by c), duration_us)) // 2 from ed
), fr as (select * from op where not exists (from fl where fl.source_id = op.source_id and abs(fl.at_us - op.at_us) < 150000)),
ct as (
  select fr.*, greatest(0, 40 - k) as room, row_number() over (partition by fr.source_id order by reason, at_us) as nth, count(*) over (partition by fr.source_id) as n, count(*) filter (reason = 'cut') over (partition by fr.source_id) as nc
  from fr join (select source_id, count(*) as k from fl group by all) using (source_id)
), th as (
  select * from ct where n <= room or list_contains(list_transform(range(room), lambda i: round_even(i * (case when nc >= room then nc else n end - 1) / greatest(room - 1, 1)::double, 0)::bigint + 1), nth)
), c as (select source_id, reason, at_us, row_number() over (partition by source_id order by nth) as i from th), k as (
  select source_id, i, [at_us] as kept, true as stays from c where i = 1
  union all select source_id, i, case when ok then list_append(kept, a) else kept end, ok from (
    select c.source_id, c.i, c.at_us as a, kept, len(list_filter(kept, lambda x: abs(x - c.at_us) < 150000)) = 0 as ok from k join c on c.source_id = k.source_id and c.i = k.i + 1)
) select source_id, at_us, reason from fl union all select source_id, at_us, reason from c join k using (source_id, i) where stays""")
def editorial_stills(spark, sf_dir):
    """Sentence ends and every third word stand for cuts; every fourth recording is cut short."""
    w = written(words(spark, sf_dir).select("source_id", "idx", "word", "start_us", "end_us"), "words")
    r = recordings(w).withColumn("duration_us", F.when(F.col("source_id") % 4 == 0, 600_000 + F.col("source_id") * 1000).otherwise(F.col("duration_us")))
    return D.editorial_stills(w.where(F.col("word").endswith(".") | (F.col("idx") % 3 == 0)).select("source_id", F.col("start_us").alias("at_us")), r)
