"""Queries over sources, anchors, stories, briefs and the smaller rules, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import RANGES_CTE, TURNS_CTE, ranges, scaled, table, turns, words
from ..functions.scalars import leans_forward as leans
from ..operators import anchors as A
from ..operators import timeline as T
from ..registry import query
from ..sources import tables as S
from .audit_queries import COMMON, MOVES, _common, _moves
from .measure_queries import SAMPLES
from .speech_queries import BARE, KEY, W
from .timeline_queries import CUES, PLACED, R, RW, _cues, _line, _placed


@query("select item_id, text from benchmark")
def load_table(spark, sf_dir):
    return S.load_table(spark, f"{sf_dir}/benchmark.parquet", "item_id long, text string")


LOG = """lg as (select o_orderkey as k, o_orderpriority as renderer, o_orderstatus as quality, (640 + o_custkey % 4 * 320)::integer as width, 480 as height, (o_custkey % 90)::double as output_s, round(o_totalprice / 1000, 3) as elapsed_s from orders)"""


@query("with " + LOG + """ select renderer, quality, count(*) as n, sum(width)::bigint as widths from lg where output_s > 0 and k % 11 <> 0 group by all""")
def read_render_log(spark, sf_dir):
    """Orders written as JSON lines, one in eleven cut short."""
    o = table(spark, sf_dir, "orders")
    entry = F.to_json(F.struct(
        F.col("o_orderpriority").alias("renderer"), F.col("o_orderstatus").alias("quality"), (640 + F.col("o_custkey") % 4 * 320).alias("width"), F.lit(480).alias("height"),
        (F.col("o_custkey") % 90).cast("double").alias("output_seconds"), F.round(F.col("o_totalprice") / 1000, 3).alias("elapsed_seconds"),
    ))
    lines = o.select(F.when(F.col("o_orderkey") % 11 == 0, F.substring(entry, 1, 25)).otherwise(entry).alias("value"))
    return S.read_render_log(lines).groupBy("renderer", "quality").agg(F.count("*").alias("n"), F.sum("width").alias("widths"))


@query("""with d as (select item_id, regexp_split_to_array(text, '\\s+')[1] as w1, regexp_split_to_array(text, '\\s+')[2] as w2, regexp_split_to_array(text, '\\s+')[3] as w3 from benchmark)
  select item_id, 1 as line_no, 0::bigint as start_ms, (1500 + item_id % 4 * 500)::bigint as end_ms, w1 as shot, w2 as said, w3 || '|' || w1 as on_screen, false as off_screen from d
  union all select item_id, 2, 3000, 3100, w2, 'off: ' || w3, '', true from d union all select item_id, 4, 4000, 5250, w3, w1, '', false from d""")
def parse_brief_rows(spark, sf_dir):
    w = F.split("text", r"\s+")
    end = F.format_string("%.1f", 1.5 + (F.col("item_id") % 4) * 0.5)
    body = F.concat(
        F.lit("Scenario\n- 0-"), end, F.lit(" s | "), w[0], F.lit(" | "), w[1], F.lit(" | "), w[2], F.lit(" / "), w[0], F.lit("\n3,0 - 2.5 s | "), w[1], F.lit(" | off: "), w[2], F.lit("\nno row here\n4s—5,25 | "), w[2], F.lit(" | "), w[0], F.lit("\n1-2-3 | a | b | c"),
    )
    return S.parse_brief_rows(table(spark, sf_dir, "benchmark").select("item_id", body.alias("text")), "item_id")


@query("""with d as (select item_id, regexp_split_to_array(text, '\\s+')[1] as w1, regexp_split_to_array(text, '\\s+')[2] as w2 from benchmark)
  select item_id, 1 as line_no, 'recording' as section, w1 as line from d union all select item_id, 2, 'recording', w2 || ': x' from d union all select item_id, 4, 'scenario', '0-1 s | ' || w1 from d
  union all select item_id, 5, case when item_id % 2 = 0 then 'montage' else 'scenario' end, case when item_id % 2 = 0 then 'by ' || w1 else '# montażysta' end from d union all select item_id, 6, case when item_id % 2 = 0 then 'montage' else 'scenario' end, 'end' from d""")
def brief_sections(spark, sf_dir):
    w, even = F.split("text", r"\s+"), F.col("item_id") % 2 == 0
    body = F.concat(
        F.lit("a title\n## NAGRANIE (one): "), w[0], F.lit("\n"), w[1], F.lit(": x\nScenariusz:\n0-1 s | "), w[0], F.lit("\n"), F.when(even, F.concat(F.lit("Montaż by "), w[0])).otherwise("Montaż: "), F.lit("\nend"),
    )
    return S.brief_sections(table(spark, sf_dir, "benchmark").select("item_id", F.when(even, body).otherwise(F.replace(body, F.lit("\nMontaż: "), F.lit("\n# montażysta"))).alias("text")), "item_id")


@query("""with d as (select item_id, regexp_split_to_array(text, '\\s+')[1] as w1, regexp_split_to_array(text, '\\s+')[2] as w2 from benchmark)
  select item_id, 0 as line_no, w1 || ' ' || w2 as sentence, 'clip' || item_id || '.mp4' as clip, 2500::bigint as at_ms, 1400::bigint as hold_ms from d union all select item_id, 2, w2, 'b.mp4', 0, null from d""")
def parse_story_rows(spark, sf_dir):
    w = F.split("text", r"\s+")
    body = F.concat(F.lit('"'), w[0], F.lit("  "), w[1], F.lit('" -> clip'), F.col("item_id").cast("string"), F.lit(".mp4 @ 2.5 1,4 s\nnotes\n"), w[1], F.lit(" → b.mp4"))
    return S.parse_story_rows(table(spark, sf_dir, "benchmark").select("item_id", body.alias("text")), "item_id")


@query(W + "," + COMMON + rf""" select source_id, idx, not regexp_matches({BARE}, '[.!?…,;:\-–—]$') and {BARE} <> '' and {KEY} in (select key from lx where r <= 30) as leans from words""")
def leans_forward(spark, sf_dir):
    w = words(spark, sf_dir)
    return leans(w, _common(w, 30)).select("source_id", "idx", "leans")


MV = """m as (select l_orderkey as edit_id, l_partkey * 100 + l_suppkey as move_id, l_partkey % 300 as n, l_linenumber as occurrence from lineitem)"""


@query(RW + "," + PLACED + "," + MV + f""", a as (select edit_id, {KEY} as key, row_number() over (partition by edit_id, {KEY} order by out_start, idx) as occurrence, out_start from placed),
  lx as (select key, row_number() over (order by c desc, key) as r from (select {KEY} as key, count(*) as c from words group by 1) where length(key) >= 4), k as (select edit_id, move_id, key, occurrence from m join lx on r = n + 1)
  select k.edit_id, move_id, k.key, k.occurrence, out_start as at_us, case when out_start is null then 'not said' end as error from k left join a on a.edit_id = k.edit_id and a.key = k.key and a.occurrence = k.occurrence""")
def anchor_to_words(spark, sf_dir):
    from pyspark.sql import Window

    w = words(spark, sf_dir)
    from ..functions.scalars import word_key

    k = w.select(word_key(F.col("word")).alias("key")).where(F.length("key") >= 4).groupBy("key").count()
    k = k.withColumn("r", F.row_number().over(Window.orderBy(F.desc("count"), "key"))).where("r <= 300").select("key", F.col("r").alias("_r"))
    li = table(spark, sf_dir, "lineitem")
    m = li.select(F.col("l_orderkey").alias("edit_id"), (F.col("l_partkey") * 100 + F.col("l_suppkey")).alias("move_id"), (F.col("l_partkey") % 300 + 1).alias("_r"), F.col("l_linenumber").alias("occurrence"))
    return A.anchor_to_words(m.join(k, "_r").drop("_r"), T.word_anchor(_placed(spark, sf_dir)))


@query(R + """, m as (select l_orderkey as edit_id, l_partkey * 100 + l_suppkey as move_id, (l_orderkey % 50)::bigint as source_id, (l_suppkey * 90000)::bigint as at_us from lineitem),
  h as (select m.edit_id, move_id, arg_min((output_start + floor((at_us - start_us) * 100 / speed_pct))::bigint, range_idx) as o from m join line l on l.edit_id = m.edit_id and at_us between start_us and end_us group by all)
  select m.edit_id, m.move_id, source_id, at_us, case when o is null then 0 else greatest(0, o - 50000) end as out_us, case when o is null then 'removed' end as error from m left join h using (edit_id, move_id)""")
def anchor_to_sources(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    m = li.select(F.col("l_orderkey").alias("edit_id"), (F.col("l_partkey") * 100 + F.col("l_suppkey")).alias("move_id"), (F.col("l_orderkey") % 50).alias("source_id"), (F.col("l_suppkey") * 90_000).alias("at_us"))
    return A.anchor_to_sources(m, _line(spark, sf_dir), 50_000).withColumn("out_us", F.when(F.col("error").isNull(), F.col("out_us")).otherwise(0).cast("long"))


DUR = "du as (select edit_id, max(output_end) as content_end from line group by all)"


def _durations(spark, sf_dir):
    return _line(spark, sf_dir).groupBy("edit_id").agg(F.max("output_end").alias("content_end"))


@query(R + "," + DUR + """ select o_orderkey as edit_id, o_custkey as move_id, greatest(0, content_end - o_custkey * 3000) as start_us, content_end as end_us from orders join du on o_orderkey = edit_id""")
def place_end_teasers(spark, sf_dir):
    m = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("edit_id"), F.col("o_custkey").alias("move_id"), (F.col("o_custkey") * 3000).alias("seconds_us"))
    return A.place_end_teasers(m, _durations(spark, sf_dir))


@query(R + "," + DUR + """, c as (select edit_id, range_idx as card_no, (1000000 + zoom_pct * 20000)::bigint as s from ranges), u as (select *, sum(s) over (partition by edit_id order by card_no) as upto from c)
  select edit_id, card_no, (content_end + upto - s)::bigint as start_us, (content_end + upto)::bigint as end_us from u join du using (edit_id) where upto <= 10000000""")
def hold_end_cards(spark, sf_dir):
    c = ranges(spark, sf_dir).select("edit_id", F.col("range_idx").alias("card_no"), (1_000_000 + F.col("zoom_pct") * 20_000).cast("long").alias("seconds_us"))
    return A.hold_end_cards(c, _durations(spark, sf_dir))


@query("with " + MOVES + """, s as (select o_orderkey as edit_id, (o_custkey * 9000)::bigint as a, (o_custkey * 7000 + 900000)::bigint as b from orders),
  x as (select edit_id, move_id, case when start_us >= a then start_us + b - a else least(start_us, b) end as s2, case when start_us >= a or end_us > a then end_us + b - a else least(end_us, b) end as e2 from mv join s using (edit_id))
  select edit_id, move_id, s2 as start_us, e2 as end_us from x where e2 - s2 >= 100000""")
def shift_plan(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("edit_id"), (F.col("o_custkey") * 9000).alias("old_us"), (F.col("o_custkey") * 7000 + 900_000).alias("new_us"))
    return A.shift_plan(_moves(spark, sf_dir), s)


@query("""with l as (select o_custkey as edit_id, o_orderkey as line_no, o_orderpriority as sentence, case when o_orderkey % 2 = 0 then (o_orderkey % 400)::varchar else 'stem' || o_orderkey % 400 end as clip,
    (o_orderkey % 7 * 500000)::bigint as at_us, case when o_orderkey % 3 = 0 then 900000::bigint end as hold from orders),
  s as (select p_partkey::varchar as source_id, 'stem' || p_partkey as stem, (p_size * 90000)::bigint as duration_us from part where p_partkey < 350),
  j as (select l.*, coalesce(a.source_id, b.source_id) as source_id, coalesce(a.duration_us, b.duration_us) as d, at_us + coalesce(hold, 1250000) as e from l left join s a on a.source_id = clip left join s b on b.stem = clip)
  select edit_id, row_number() over (partition by edit_id order by line_no) - 1 as range_idx, source_id, at_us as start_us, e as end_us, sentence as beat, case when source_id is null then 'unknown clip' when e > d then 'past the end' end as problem from j""")
def story_plan(spark, sf_dir):
    k = F.col("o_orderkey")
    n = (k % 400).cast("string")
    l = table(spark, sf_dir, "orders").select(  # noqa: E741
        F.col("o_custkey").alias("edit_id"), k.alias("line_no"), F.col("o_orderpriority").alias("sentence"), F.when(k % 2 == 0, n).otherwise(F.concat(F.lit("stem"), n)).alias("clip"),
        (k % 7 * 500_000).alias("at_us"), F.when(k % 3 == 0, F.lit(900_000).cast("long")).alias("hold_us"),
    )
    p = F.col("p_partkey").cast("string")
    s = table(spark, sf_dir, "part").where("p_partkey < 350").select(p.alias("source_id"), F.concat(F.lit("stem"), p).alias("stem"), (F.col("p_size") * 90_000).cast("long").alias("duration_us"))
    return A.story_plan(l, s)


@query("""with r as (select item_id % 7 as brief_id, item_id as row_idx, (item_id * 100000)::bigint as s, string_split(text, '.') as on_screen from benchmark),
  e as (select brief_id, row_idx, s, unnest(on_screen) as label, generate_subscripts(on_screen, 1) - 1 as pos from r), n as (select *, row_number() over (partition by brief_id order by row_idx, pos) as nth from e)
  select brief_id, row_idx, pos::integer as pos, label, s as start_us, s + 3000000 as end_us from n where nth > 1 and length(label) <= 48""")
def brief_labels(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 7).alias("brief_id"), F.col("item_id").alias("row_idx"), (F.col("item_id") * 100_000).alias("start_us"), F.split("text", "[.]").alias("on_screen"))
    return A.brief_labels(b)


@query(W + rf""", l as (select source_id, string_agg(word, ' ' order by idx) as line from words where idx between 2 and 9 group by 1),
  n as (select source_id, line, list_filter(list_transform(regexp_split_to_array(line, '\s+'), lambda x: regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]', '', 'g')), lambda x: x <> '') as ws from l),
  h as (select n.source_id, list(distinct {KEY}) as heard from words w join n on n.source_id = w.source_id and w.idx < len(n.ws) + 4 group by 1)
  select source_id, line, len(list_filter(ws, lambda x: list_contains(heard, x))) * 10 < len(ws) * 6 as unspoken from n left join h using (source_id)""")
def unspoken_first_line(spark, sf_dir):
    w = words(spark, sf_dir)
    l = w.where("idx between 2 and 9").groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"]), " ").alias("line"))  # noqa: E741
    return A.unspoken_first_line(l, w)


@query(CUES + """, s as (select * from (values ('the', 1), ('de', 2), ('die', 3), ('en', 4)) t(phrase, number)),
  k as (select *, regexp_replace(lower(split_part(text, ' ', 1)), '[^\\p{L}\\p{N}]', '', 'g') as head from cues)
  select edit_id, cue_idx, number as step, case when number is not null and not starts_with(text, number || '.') then number || '. ' || text else text end as text from k left join s on head = phrase""")
def number_steps(spark, sf_dir):
    steps = spark.createDataFrame([("the", 1), ("de", 2), ("die", 3), ("en", 4)], "phrase string, number int")
    return A.number_steps(_cues(spark, sf_dir).select("edit_id", "cue_idx", "text"), steps).select("edit_id", "cue_idx", "step", "text")


@query("""with b as (select p_type as category, p_name as phrase from part where p_size <= 30), p as (select p_type as category, upper(p_name) || ' x' as phrase from part where p_size = 50 and p_type < 'M'),
  k as (select * from b where category not in (select category from p) union all select * from p), d as (select distinct category, regexp_replace(trim(lower(phrase)), '\\s+', ' ', 'g') as phrase from k)
  select category, phrase, len(string_split(phrase, ' '))::integer as n_words from d""")
def merge_lexicon(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    base = p.where("p_size <= 30").select(F.col("p_type").alias("category"), F.col("p_name").alias("phrase"))
    return A.merge_lexicon(base, p.where("p_size = 50 and p_type < 'M'").select(F.col("p_type").alias("category"), F.concat(F.upper("p_name"), F.lit(" x")).alias("phrase")))


@query(W + "," + RANGES_CTE + """, s as (select distinct source_id, start_us // 100000 * 100000 + end_us as span_id, start_us as s0, end_us as s1 from ranges)
  select s.source_id || '-' || s0 || '-' || s1 as span_id, string_agg(word, ' ' order by idx) as quote from s join words w on w.source_id = s.source_id and w.start_us >= s0 and w.end_us <= s1 group by all""")
def words_in(spark, sf_dir):
    r = ranges(spark, sf_dir).select("source_id", F.col("start_us").alias("s_start"), F.col("end_us").alias("s_end")).distinct()
    return A.words_in(r.withColumn("span_id", F.concat_ws("-", "source_id", "s_start", "s_end")), words(spark, sf_dir))


@query("""select l_orderkey as edit_id, bool_or(l_suppkey % 4 <> l_orderkey % 4) as multi from lineitem where l_returnflag <> 'R' group by all""")
def is_multi_source(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("edit_id"), (F.col("l_suppkey") % 4).alias("source_id"), (F.col("l_orderkey") % 4).alias("primary_id"), F.when(F.col("l_returnflag") == "R", "drop").otherwise("keep").alias("action")
    )
    return A.is_multi_source(i)


@query("with " + RANGES_CTE + """, f as (select edit_id, range_idx + 1 as range_idx, zoom_pct from ranges)
  select f.* from f left join ranges r using (edit_id, range_idx) where r.zoom_pct is null or r.zoom_pct <> f.zoom_pct""")
def lost_fixes(spark, sf_dir):
    r = ranges(spark, sf_dir)
    return A.lost_fixes(r, r.select("edit_id", (F.col("range_idx") + 1).alias("range_idx"), "zoom_pct"))


@query(CUES + """, n as (select edit_id, text, len(string_split(text, ' ')) as w, case when cue_idx % 2 = 0 then 'a' else 'b' end as speaker from cues),
  p as (select edit_id, count(distinct speaker) as s, max(w) as w, bool_or(regexp_matches(text, '[0-9]')) as d from n group by all)
  select edit_id, array_to_string(list_filter([case when s > 1 then 'speakers' end, case when w > 1 then 'karaoke' end, case when d then 'numbers' end], lambda x: x is not null), ',') as features from p""")
def caption_features(spark, sf_dir):
    c = _cues(spark, sf_dir)
    return A.caption_features(c.withColumns({"speaker": F.when(F.col("cue_idx") % 2 == 0, "a").otherwise("b"), "n_words": F.size(F.split("text", " "))}))


@query(CUES + """, t as (select edit_id, cue_idx + case when edit_id % 10 = 0 then 1 else 0 end as cue_idx, start_us + edit_id % 3 * 900 as s, end_us as e, case when cue_idx = 2 then ' ' else text end as t from cues),
  j as (select coalesce(c.edit_id, t.edit_id) as edit_id, coalesce(c.cue_idx, t.cue_idx) as cue_idx, start_us, end_us, s, e, t from cues c full join t on c.edit_id = t.edit_id and c.cue_idx = t.cue_idx)
  select edit_id, cue_idx, unnest(list_filter([case when s is null then 'missing' end, case when start_us is null then 'unknown' end, case when start_us is not null and s is not null and (abs(start_us - s) > 1000 or abs(end_us - e) > 1000) then 'moved' end,
    case when trim(t) = '' then 'empty' end, case when length(t) > 900 then 'too long' end], lambda x: x is not null)) as problem from j""")
def translation_problems(spark, sf_dir):
    c = _cues(spark, sf_dir)
    e = F.col("edit_id")
    t = c.select("edit_id", (F.col("cue_idx") + (e % 10 == 0).cast("long")).alias("cue_idx"), (F.col("start_us") + e % 3 * 900).alias("start_us"), "end_us", F.when(F.col("cue_idx") == 2, " ").otherwise(F.col("text")).alias("text"))
    return A.translation_problems(c, t, 900)


@query(CUES + """, t as (select edit_id, cue_idx + case when edit_id % 10 = 0 then 1 else 0 end as cue_idx, start_us + edit_id % 3 * 900 as s, end_us as e, case when cue_idx = 2 and edit_id % 4 = 1 then '' else 'x ' || trim(text) end as t from cues where edit_id % 7 > 0),
  j as (select coalesce(c.edit_id, t.edit_id) as edit_id, start_us is null or s is null or abs(start_us - s) > 1000 or t = '' or length(t) > 900 as bad from cues c full join t on c.edit_id = t.edit_id and c.cue_idx = t.cue_idx)
  select c.edit_id, c.cue_idx, c.start_us, c.end_us, t as text from cues c join t on c.edit_id = t.edit_id and c.cue_idx = t.cue_idx where c.edit_id not in (select edit_id from j where bad)""")
def apply_translation(spark, sf_dir):
    c, e = _cues(spark, sf_dir), F.col("edit_id")
    text = F.when((F.col("cue_idx") == 2) & (e % 4 == 1), " ").otherwise(F.concat(F.lit(" x  "), F.col("text")))
    t = c.where("edit_id % 7 > 0").select("edit_id", (F.col("cue_idx") + (e % 10 == 0).cast("long")).alias("cue_idx"), (F.col("start_us") + e % 3 * 900).alias("start_us"), "end_us", text.alias("text"))
    return A.apply_translation(c, t, 900)[0]


@query("""with s as (select p_partkey as source_id, 640 + p_partkey % 5 * 320 as w, 360 + p_partkey % 7 * 180 as h, (p_retailprice * 1000)::bigint as b from part),
  x as (select source_id, floor(greatest(108000 / w, 192000 / h))::bigint as cover_pct, floor(b * 1000 / (w * h * 30))::bigint as bpp_milli from s) select * from x where cover_pct >= 150 or bpp_milli < 50""")
def weak_sources(spark, sf_dir):
    k = F.col("p_partkey")
    s = table(spark, sf_dir, "part").select(
        k.alias("source_id"), (640 + k % 5 * 320).alias("width"), (360 + k % 7 * 180).alias("height"), F.lit(1080).alias("canvas_w"), F.lit(1920).alias("canvas_h"),
        F.round(F.col("p_retailprice") * 1000).cast("long").alias("bit_rate"), F.lit(30).alias("fps"),
    )
    return A.weak_sources(s)


@query("with " + RANGES_CTE + " select edit_id, source_id, floor(sum((end_us - start_us) * zoom_pct) / sum(end_us - start_us))::bigint as enlargement_pct from ranges group by all")
def weighted_enlargement(spark, sf_dir):
    return A.weighted_enlargement(ranges(spark, sf_dir))


@query("with " + MOVES + """, u as (select edit_id, start_us, end_us, move_id, sum(end_us - start_us) over (partition by edit_id order by start_us, end_us rows unbounded preceding) as upto from mv),
  t as (select *, upto - (end_us - start_us) as f, max(upto) over (partition by edit_id) as total from u), e as (select *, unnest(range(10)) as n from t)
  select edit_id, n::integer as n, (start_us + floor(total * (2 * n + 1) / 20) - f)::bigint as at_us from e where floor(total * (2 * n + 1) / 20) >= f and floor(total * (2 * n + 1) / 20) < upto""")
def sample_times(spark, sf_dir):
    return A.sample_times(_moves(spark, sf_dir))


@query("""with px as (select label as source_id, unnest(list_transform(embedding, lambda x: floor(abs(x) * 500)::bigint)) as r, unnest(list_transform(embedding, lambda x: floor(abs(x) * 450)::bigint)) as g, unnest(list_transform(embedding, lambda x: floor(abs(x) * 400)::bigint)) as b from embeddings)
  select source_id, quantile_cont(r * 299 + g * 587 + b * 114, 0.05)::double as p5, quantile_cont(r * 299 + g * 587 + b * 114, 0.5)::double as p50, quantile_cont(r * 299 + g * 587 + b * 114, 0.95)::double as p95,
  floor(sum(case when greatest(r, g, b) - least(r, g, b) <= 40 then r - b end) * 1000 / sum(case when greatest(r, g, b) - least(r, g, b) <= 40 then 255 end))::bigint as cast_milli from px group by all""")
def luma_stats(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("source_id"), F.explode("embedding").alias("x"))
    part = lambda k: scaled(F.abs("x"), k)
    return A.luma_stats(e.select("source_id", part(500).alias("r"), part(450).alias("g"), part(400).alias("b")))


@query("with " + SAMPLES + " select stream_id as source_id, quantile_cont(level_db10, 0.9)::double as speech10, quantile_cont(level_db10, 0.1)::double as floor10, quantile_cont(level_db10, 0.9)::double - quantile_cont(level_db10, 0.1)::double as snr10 from levels group by all")
def voice_measures(spark, sf_dir):
    from .measure_queries import _levels

    return A.voice_measures(_levels(spark, sf_dir).withColumnRenamed("stream_id", "source_id"))


@query("""with t as (select label as source_id, vec_id % 3 as track_id, vec_id as sample_idx, list_transform(embedding[1:16], lambda x: floor(x * 1000)::bigint) as p from embeddings),
  l as (select *, lag(p) over (partition by source_id, track_id order by sample_idx) as q from t)
  select source_id, track_id, sample_idx, floor(list_sum(list_transform(list_zip(p, q), lambda z: abs(z[1] - z[2]))) / 16)::bigint as motion from l where q is not null""")
def mouth_motion(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    patch = F.transform(F.slice("embedding", 1, 16), lambda x: scaled(x))
    return A.mouth_motion(e.select(F.col("label").alias("source_id"), (F.col("vec_id") % 3).alias("track_id"), F.col("vec_id").alias("sample_idx"), patch.alias("patch")))


@query(W + "," + TURNS_CTE + """, e as (select source_id, start_us as at_us, label as v, 0 as o from turns where end_us - start_us >= 1000000 union all select source_id, start_us, null, 1 from words),
  h as (select *, last_value(v ignore nulls) over (partition by source_id order by at_us, o, v nulls first rows unbounded preceding) as speaker from e) select source_id, at_us, speaker from h where o = 1""")
def speaker_at(spark, sf_dir):
    w = words(spark, sf_dir)
    return A.speaker_at(w.select("source_id", F.col("start_us").alias("at_us")), turns(w))


@query(R + "," + MOVES + """, b as (select edit_id, output_start as at_us from line union all select edit_id, start_us from mv), d as (select distinct edit_id, (at_us + 5000) // 10000 * 10000 as at_us from b)
  select edit_id, at_us from (select *, row_number() over (partition by edit_id order by at_us) as n from d) where n <= 40""")
def qa_moments(spark, sf_dir):
    m = _moves(spark, sf_dir).select("edit_id", F.col("start_us").alias("at_us"))
    return A.qa_moments(_line(spark, sf_dir).select("edit_id", F.col("output_start").alias("at_us")), m)


@query("with " + MOVES + """, c as (select edit_id, end_us as at_us, case kind when 'effect' then 2 when 'punch_in' then 1 else 0 end as r from mv where move_id % 3 <> 0),
  h as (select m.edit_id, m.move_id, m.start_us, max(r) as r from mv m join c on c.edit_id = m.edit_id and c.at_us between m.start_us - 750000 and m.start_us group by all)
  select mv.edit_id, mv.move_id as moment_id, case when r = 2 then 'error' when r = 1 then 'warning' else 'ok' end as verdict from mv left join h on h.edit_id = mv.edit_id and h.move_id = mv.move_id and h.start_us = mv.start_us""")
def moment_verdicts(spark, sf_dir):
    m = _moves(spark, sf_dir)
    k = F.col("kind")
    c = m.select("edit_id", F.col("end_us").alias("at_us"), F.when(k == "effect", "error").when(k == "punch_in", "warning").otherwise("info").alias("severity"), (F.col("move_id") % 3 == 0).alias("passed"))
    return A.moment_verdicts(m.select("edit_id", F.col("move_id").alias("moment_id"), F.col("start_us").alias("at_us")), c)


@query("""select o_orderkey as edit_id, concat_ws(chr(10), case when o_custkey % 2 = 0 then o_orderpriority else '[[title]]' end, case when o_orderstatus = 'F' then o_orderstatus else '[[hook]]' end, '[[ask]]') as body from orders""")
def description_slots(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("edit_id"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderpriority")).alias("title"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderstatus")).alias("hook"), F.lit(None).cast("string").alias("ask")
    )
    return A.description_slots(p)


@query("""with c as (select p_brand as key, p_type as value from part), a as (select distinct p_brand as key, lower(p_brand) as new_key from part where p_brand like '%1'), k as (select distinct p_brand as key, p_type as value from part where p_size > 25 and p_brand like '%2'),
  f as (select c.key, 'renamed' as finding, new_key as detail from c join a using (key) union all select key, 'unknown', '' from c where key not in (select key from a) and key not in (select key from k)
    union all select key, 'bad choice', value from c where key in (select key from k) and (key, value) not in (select key, value from k))
  select distinct * from f""")
def plan_migration(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    b = F.col("p_brand")
    choices = p.where((F.col("p_size") > 25) & b.endswith("2")).select(b.alias("key"), F.col("p_type").alias("value")).distinct()
    return A.plan_migration(p.select(b.alias("key"), F.col("p_type").alias("value")), p.where(b.endswith("1")).select(b.alias("key"), F.lower("p_brand").alias("new_key")).distinct(), choices)


@query("with " + MOVES + """, d as (select o_orderkey as edit_id, (o_custkey * 20000)::bigint as duration_us from orders)
  select edit_id, count(*) filter (kind = 'effect') as n_effects, bool_or(kind = 'title') as titled, bool_or(kind = 'title' and end_us > duration_us - 3000000) as late from mv join d using (edit_id) group by all""")
def render_evidence(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("edit_id"), (F.col("o_custkey") * 20_000).alias("duration_us"))
    return A.render_evidence(_moves(spark, sf_dir), d)


@query("""with c as (select o_orderkey as k, o_orderstatus as status, o_orderpriority as priority from orders), e as (select o_orderkey as k, lower(o_orderstatus) as status, case when o_custkey % 9 = 0 then 'none' else o_orderpriority end as priority from orders)
  select c.k as edit_id, 'priority' as field, lower(c.priority) as wanted, lower(e.priority) as found from c join e using (k) where lower(c.priority) <> lower(e.priority)""")
def contract_gaps(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    c = o.select(F.col("o_orderkey").alias("edit_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    e = o.select(F.col("o_orderkey").alias("edit_id"), F.lower("o_orderstatus").alias("status"), F.when(F.col("o_custkey") % 9 == 0, "none").otherwise(F.col("o_orderpriority")).alias("priority"))
    return A.contract_gaps(e, c, "edit_id", ["status", "priority"])


@query("""with i as (select l_orderkey as edit_id, case l_returnflag when 'A' then 'bed' when 'N' then 'no_music' else 'other' end as v from lineitem), p as (select edit_id, bool_or(v = 'bed') as b, bool_or(v = 'no_music') as d from i group by all)
  select edit_id, case when b and d then 'both: add platform music to the dry one' when b then 'post as it is' else 'add music on the platform' end as note from p""")
def posting_notes(spark, sf_dir):
    f = F.col("l_returnflag")
    return A.posting_notes(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("edit_id"), F.when(f == "A", "bed").when(f == "N", "no_music").otherwise("other").alias("variant")))


@query("""with s as (select l_suppkey as source_id, l_returnflag as step, l_linenumber % 2 = 0 as applied, l_quantity::bigint as amount from lineitem), m as (select * from (values ('A', 45), ('N', 50)) t(step, most))
  select source_id, bool_and(not applied or amount <= coalesce(most, 0)) as ok from s left join m using (step) group by all""")
def effects_within_limits(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_returnflag").alias("step"), (F.col("l_linenumber") % 2 == 0).alias("applied"), F.col("l_quantity").cast("long").alias("amount"))
    return A.effects_within_limits(s, spark.createDataFrame([("A", 45), ("N", 50)], "step string, most int"))


@query("""with p as (select user_id as stream_id, event_id as pos, epoch_us(ts) as at_us from events), s as (select *, at_us - lag(at_us) over (partition by stream_id order by pos) as step from p)
  select stream_id, coalesce(bool_and(step > 0), true) as monotonic, quantile_cont(step, 0.5)::double as median_us from s group by all""")
def cadence(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("pos"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))
    return A.cadence(e)


@query(W + r""", v as (select source_id, idx, case when length(word) = 3 then idx::varchar else word end as word from words),
  a as (select *, list(word) over f as ahead, list(regexp_matches(regexp_replace(word, '["'')\]}]*$', ''), '[.!?…]$')) over f as ends from v window f as (partition by source_id order by idx rows between 1 following and 5 following)),
  n as (select *, regexp_replace(word, '^\p{P}+|[.,;:!?]+$', '', 'g') as number from a)
  select source_id, idx, number, coalesce(array_to_string(ahead[1:coalesce(nullif(list_position(ends, true), 0), len(ahead))], ' '), '') as label from n
  where regexp_matches(number, '^\d+([.,]\d+)?%?$') and not regexp_matches(number, '^(19|20)\d\d$') and length(number) <= 12""")
def stats(spark, sf_dir):
    """Word numbers stand for spoken ones: every word of three letters becomes its index."""
    w = words(spark, sf_dir)
    return A.stats(w.withColumn("word", F.when(F.length("word") == 3, F.col("idx").cast("string")).otherwise(F.col("word"))))
