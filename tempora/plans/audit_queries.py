"""Queries over accents, libraries, audits, project and face tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import RANGES_CTE, ranges, recordings, table, words
from ..fixtures import SEGMENTS_CTE, scaled, segments
from ..functions.scalars import rounded, word_key
from ..operators import accents as A
from ..operators import audits as Q
from ..operators import project as J
from ..operators import speech as P
from ..registry import ORACLES, query
from .speech_queries import KEY, SENTENCES, W, WR
from .timeline_queries import _cues

WS = W + "," + SENTENCES


def _sentences(spark, sf_dir):
    return P.sentences(words(spark, sf_dir))


@query(WS + """ select source_id, start_us as at_us, case when length(text) > 90 then split_part(text, ',', 1) else text end as title,
  greatest(1200000, least(2200000, end_us - start_us)) as seconds_us from sentences where sentence_idx = 0""")
def hook(spark, sf_dir):
    return A.hook(_sentences(spark, sf_dir))


@query(WS + r""" select source_id, start_us, end_us, text from sentences where sentence_idx > 0 and length(text) <= 80 and regexp_matches(text, '\?["'')\]}]*$')""")
def questions(spark, sf_dir):
    return A.questions(_sentences(spark, sf_dir))


@query(WS + """ select source_id, start_us, end_us, gap_us, text from (select *, start_us - lag(end_us) over (partition by source_id order by sentence_idx) as gap_us from sentences)
  where gap_us >= 600000 and n_words <= 5 and text not like '%?'""")
def punchlines(spark, sf_dir):
    return A.punchlines(_sentences(spark, sf_dir))


COMMON = rf"""lx as (select key, row_number() over (order by c desc, key) as r from (select {KEY} as key, count(*) as c from words group by 1) where length(key) >= 4)"""


def _common(w, n):
    k = w.select(word_key(F.col("word")).alias("key")).where(F.length("key") >= 4)
    return k.groupBy("key").count().orderBy(F.desc("count"), "key").limit(n).select("key")


@query(W + "," + COMMON + f""" select source_id, idx, {KEY} as key, greatest(0, start_us - 50000) as start_us, greatest(0, start_us - 50000) + 900000 as end_us from words where {KEY} in (select key from lx where r <= 40)""")
def word_punches(spark, sf_dir):
    w = words(spark, sf_dir)
    return A.marked_words(w, _common(w, 40), 50_000, 900_000)


@query(W + f""" select source_id, min(idx) as idx, arg_min(word, idx) as word, arg_min(start_us, idx) as start_us from words where start_us between 1000000 and 1500000 and length({KEY}) >= 5 group by source_id""")
def hook_punch(spark, sf_dir):
    return A.hook_punch(words(spark, sf_dir))


@query(W + "," + COMMON + f""", t as (select key as tag from lx where r <= 60), k as (select source_id, idx, {KEY} as key from words)
  select source_id, idx, key, tag from k join t on (length(key) >= 5 and length(tag) >= 5 and left(key, 5) = left(tag, 5)) or (starts_with(key, tag) and length(key) - length(tag) <= 3)""")
def stem_match(spark, sf_dir):
    w = words(spark, sf_dir)
    return A.stem_match(w, _common(w, 60).select(F.col("key").alias("tag")))


@query(W + """, b as (select source_id, end_us + 60000 as beat_us from words), n as (
    select * from (select w.source_id, w.idx, b.beat_us, row_number() over (partition by w.source_id, w.idx order by abs(start_us - beat_us), beat_us) as nth
      from words w join b on w.source_id = b.source_id and abs(start_us - beat_us) <= 120000) where nth = 1)
  select w.source_id, w.idx, start_us as at_us, coalesce(beat_us, start_us) as snapped_us from words w left join n using (source_id, idx)""")
def snap_to_beat(spark, sf_dir):
    w = words(spark, sf_dir)
    p = w.select("source_id", "idx", F.col("start_us").alias("at_us"))
    return A.snap_to_beat(p, w.select("source_id", (F.col("end_us") + 60_000).alias("beat_us")), ["source_id", "idx"])


@query("with recursive sn as (" + ORACLES["sentences"] + "), rc as (" + WR + """ select * from recordings), every as (
  select source_id, (n_words % 5)::integer as rank, (n_words <= 6)::integer as unsure, start_us, start_us + 3500000 as end_us, duration_us from sn join rc using (source_id)
), c as (select *, row_number() over (partition by source_id order by rank, unsure, start_us) as i from every), k as (
  select source_id, i, [{'a': start_us, 'b': end_us}] as kept, true as stays from c where i = 1
  union all select source_id, i, case when ok then list_append(kept, {'a': a, 'b': b}) else kept end, ok from (
    select c.source_id, c.i, c.start_us as a, c.end_us as b, kept, len(list_filter(kept, lambda x: c.end_us > x.a and c.start_us < x.b)) = 0 as ok from k join c on c.source_id = k.source_id and c.i = k.i + 1)
) select source_id, rank, start_us as at_us from (select *, row_number() over (partition by source_id order by rank, unsure, start_us) as nth from c join (select source_id, i, stays from k) using (source_id, i) where stays)
  where nth <= greatest(1, round_even(10 * greatest(1000000, duration_us) / 60000000.0::double, 0))""")
def space_accents(spark, sf_dir):
    s = _sentences(spark, sf_dir)
    d = recordings(words(spark, sf_dir)).select("source_id", "duration_us")
    c = s.join(d, "source_id").select("source_id", (F.col("n_words") % 5).cast("int").alias("rank"), (F.col("n_words") > 6).alias("sure"), F.col("start_us").alias("at_us"), "duration_us")
    return A.space_accents(c, 10, 3_500_000)


@query(W + "," + COMMON + f""" select source_id, 'e' || (r % 25)::varchar as entry, min(idx) as idx from (select source_id, idx, {KEY} as key from words) w join lx using (key) where r <= 100 group by 1, 2""")
def icons(spark, sf_dir):
    from pyspark.sql import Window

    w = words(spark, sf_dir)
    k = w.select(word_key(F.col("word")).alias("form")).where(F.length("form") >= 4).groupBy("form").count().orderBy(F.desc("count"), "form").limit(100)
    r = F.row_number().over(Window.orderBy(F.desc("count"), "form"))
    return A.icons(w, k.withColumn("r", r).select("form", F.concat(F.lit("e"), (F.col("r") % 25).cast("string")).alias("entry")))


@query("with " + RANGES_CTE + """, l as (select *, lag(source_id) over o as ps, lag(end_us) over o as pe from ranges window o as (partition by edit_id order by range_idx))
  select edit_id, range_idx, case when ps <> source_id then 'source' else 'jump' end as kind from l where ps <> source_id or abs(start_us - pe) >= 1000000""")
def transitions(spark, sf_dir):
    return A.transitions(ranges(spark, sf_dir))


SFX = """mo as (select distinct l_orderkey as edit_id, l_returnflag as role, (l_partkey * 1000)::bigint as at_us from lineitem),
fl as (select case p_partkey % 3 when 0 then 'A' when 1 then 'N' else 'R' end as role, p_partkey as file_no, -(p_size * 5) as peak from part where p_size > 40),
fs as (select *, row_number() over (partition by role order by file_no) - 1 as slot, count(*) over (partition by role) as size from fl)"""


@query("with " + SFX + """, t as (select m.*, (row_number() over (partition by edit_id, m.role order by at_us) - 1) % s.size as slot from mo m join (select distinct role, size from fs) s using (role))
  select edit_id, t.role, at_us, file_no, greatest(0, least(60, -140 - peak))::bigint as gain_db10 from t join fs using (role, slot)""")
def sync_sfx(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("edit_id"), F.col("l_returnflag").alias("role"), (F.col("l_partkey") * 1000).alias("at_us"))
    k = F.col("p_partkey") % 3
    f = table(spark, sf_dir, "part").where("p_size > 40").select(
        F.when(k == 0, "A").when(k == 1, "N").otherwise("R").alias("role"), F.col("p_partkey").alias("file_no"), (-F.col("p_size") * 5).alias("peak_db10")
    )
    return A.sync_sfx(m, f, "edit_id")


PLATFORMS = [("reel", 3, 90, 60, 9, 16), ("square", 1, 600, 140, 1, 1), ("wide", 10, 3600, 900, 16, 9)]


@query("""with d as (select o_orderkey as id, o_custkey % 200 as seconds, 360 + o_custkey % 5 * 180 as w, 640 as h from orders),
  p as (select * from (values ('reel', 3, 90, 60, 9, 16), ('square', 1, 600, 140, 1, 1), ('wide', 10, 3600, 900, 16, 9)) t(platform, a, b, c, rw, rh)), x as (select * from d, p)
  select id as delivery_id, platform, 'duration limit' as "check", 'error' as severity, seconds between a and b as passed, seconds::bigint as measured from x
  union all select id, platform, 'advised length', 'warning', seconds <= c, seconds from x
  union all select id, platform, 'aspect ratio', 'warning', abs(w * rh - h * rw) * 100 < h * rh, (w * 1000 // h)::bigint from x""")
def platform_checks(spark, sf_dir):
    c = F.col("o_custkey")
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("delivery_id"), (c % 200).alias("seconds"), (360 + c % 5 * 180).alias("width"), F.lit(640).alias("height"))
    return Q.platform_checks(d, spark.createDataFrame(PLATFORMS, "platform string, min_s int, max_s int, advised_s int, ratio_w int, ratio_h int"))


REEL = """, cues as (
  select source_id as edit_id, row_number() over (partition by source_id order by turn) - 1 as cue_idx, min(start_us) as start_us, max(end_us) + source_id % 4 * 150000 as end_us from words group by source_id, turn
), sp as (select source_id, min(start_us) as first, max(end_us) as last, max(gap) as dead from (select *, start_us - lag(end_us) over (partition by source_id order by idx) as gap from words) group by all),
sh as (select edit_id as source_id, max(end_us - start_us) as longest, sum(end_us - start_us) as covered from cues group by all),
x as (select * from recordings left join sp using (source_id) left join sh using (source_id)),
reel as (
  select source_id, 'first word' as "check", 'warning' as severity, coalesce(first <= 1000000, false) as passed, first::bigint as measured from x
  union all select source_id, 'dead air', 'warning', coalesce(dead <= 700000, true), dead from x
  union all select source_id, 'tail', 'warning', coalesce(duration_us - last <= 600000, true), duration_us - last from x
  union all select source_id, 'longest cue', 'warning', coalesce(longest <= 2500000, true), longest from x
  union all select source_id, 'caption coverage', 'warning', coalesce(covered * 20 >= duration_us * 19, true), floor(covered * 1000 / duration_us)::bigint from x
)"""


def _reel(spark, sf_dir):
    w = words(spark, sf_dir)
    return Q.reel_check(w, recordings(w), _cues(spark, sf_dir))


@query(WR + REEL + " select * from reel")
def reel_check(spark, sf_dir):
    return _reel(spark, sf_dir)


@query(WR + REEL + """, q as (select r.*, (r."check" = 'tail' and source_id < 50) as ok from reel r)
  select source_id as edit_id, count(*) filter (not passed and severity = 'error') as errors, count(*) filter (not passed and severity = 'warning' and not ok) as warnings,
  case when count(*) filter (not passed and severity = 'error') > 0 then 'failed' when count(*) filter (not passed and severity = 'warning' and not ok) > 0 then 'passed_with_warnings' else 'passed' end as status
  from q group by source_id""")
def qa_rollup(spark, sf_dir):
    q = _reel(spark, sf_dir).withColumnRenamed("source_id", "edit_id")
    return Q.qa_rollup(q, q.where("check = 'tail' and edit_id < 50").select("edit_id", "check"))


@query(WR + REEL + """ select "check", severity, count(*) as n, count(*) filter (not passed) as failed from reel group by rollup ("check", severity)""")
def qa_dashboard(spark, sf_dir):
    return Q.qa_dashboard(_reel(spark, sf_dir))


LEXICON = W + "," + COMMON + """, lex as (
  select case r % 4 when 0 then 'address' when 1 then 'greeting' when 2 then 'promo' else 'tension' end as category, key as phrase from lx where r between 5 and 60)"""


def _lexicon(w):
    from pyspark.sql import Window

    k = _common(w, 60)
    n = w.select(word_key(F.col("word")).alias("key")).groupBy("key").count().join(k, "key", "left_semi")
    r = n.withColumn("r", F.row_number().over(Window.orderBy(F.desc("count"), "key"))).where("r >= 5")
    c = F.col("r") % 4
    return r.select(F.when(c == 0, "address").when(c == 1, "greeting").when(c == 2, "promo").otherwise("tension").alias("category"), F.col("key").alias("phrase"))


@query(LEXICON + r""", t as (select source_id as edit_id, min(idx) as idx, list_filter(regexp_split_to_array(lower(string_agg(word, ' ' order by idx)), '[^\p{L}\p{N}_]+'), lambda x: x <> '') as ts from words where turn = 0 group by 1),
  tk as (select distinct edit_id, unnest(ts) as tok from t)
  select edit_id, category, count(distinct phrase) as hits from tk join lex on starts_with(tok, phrase) group by all""")
def lexicon_hits(spark, sf_dir):
    """Lexicon words in the first turn of each conversation."""
    w = words(spark, sf_dir)
    t = w.where("turn = 0").groupBy(F.col("source_id").alias("edit_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"]), " ").alias("text"))
    return Q.lexicon_hits(t, "edit_id", _lexicon(w))


@query(LEXICON + "," + SENTENCES + r""", s as (select source_id as edit_id, text, start_us as first_word_us from sentences where sentence_idx = 0),
  tk as (select edit_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '')) as tok from s),
  h as (select edit_id, count(distinct phrase) filter (category = 'address') as ad, count(distinct phrase) filter (category = 'greeting') as gr, count(distinct phrase) filter (category = 'promo') as pr, count(distinct phrase) filter (category = 'tension') as te
    from tk join lex on starts_with(tok, phrase) group by 1),
  x as (select s.*, coalesce(ad, 0) as ad, coalesce(gr, 0) as gr, coalesce(pr, 0) as pr, coalesce(te, 0) as te, len(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}_]+'), lambda x: x <> '')) as n, contains(text, '?')::integer as ask from s left join h using (edit_id))
  select edit_id, unnest(['words', 'first word', 'promotion', 'address or tension', 'greeting']) as "check", 'warning' as severity,
    unnest([n <= 8, first_word_us <= 300000, pr = 0, ad + te + ask > 0, gr = 0]) as passed, unnest([n, first_word_us, pr, ad + te + ask, gr])::bigint as measured from x""")
def hook_check(spark, sf_dir):
    w = words(spark, sf_dir)
    s = P.sentences(w).where("sentence_idx = 0").select(F.col("source_id").alias("edit_id"), "text", F.col("start_us").alias("first_word_us"))
    return Q.hook_check(s, _lexicon(w))


MOVES = """mv as (
  select l_orderkey as edit_id, case l_returnflag when 'A' then 'effect' when 'N' then 'punch_in' else 'title' end as kind, (l_partkey * 10000)::bigint as start_us,
         (l_partkey * 10000 + l_quantity::bigint * 40000)::bigint as end_us, l_partkey * 100 + l_suppkey as move_id from lineitem
)"""


def _moves(spark, sf_dir):
    k = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("edit_id"), F.when(k == "A", "effect").when(k == "N", "punch_in").otherwise("title").alias("kind"), (F.col("l_partkey") * 10_000).alias("start_us"),
        (F.col("l_partkey") * 10_000 + F.col("l_quantity").cast("long") * 40_000).alias("end_us"), (F.col("l_partkey") * 100 + F.col("l_suppkey")).alias("move_id"),
    )


@query("with " + MOVES + """, d as (select o_orderkey as edit_id, case o_orderstatus when 'F' then 'calm' when 'O' then 'lively' else 'bold' end as energy, (o_custkey * 40000)::bigint as duration_us from orders),
  l as (select * from (values ('calm', 0), ('lively', 2), ('bold', 4)) t(energy, per)), n as (select edit_id, count(*) as n_effects from mv where kind = 'effect' group by all)
  select edit_id, n_effects, floor(per * greatest(duration_us, 1000000) / 30000000)::bigint as allowed from n join d using (edit_id) join l using (energy) where n_effects > floor(per * greatest(duration_us, 1000000) / 30000000)""")
def effect_budget(spark, sf_dir):
    s = F.col("o_orderstatus")
    d = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("edit_id"), F.when(s == "F", "calm").when(s == "O", "lively").otherwise("bold").alias("energy"), (F.col("o_custkey") * 40_000).alias("duration_us")
    )
    return Q.effect_budget(_moves(spark, sf_dir), d, spark.createDataFrame([("calm", 0), ("lively", 2), ("bold", 4)], "energy string, per_30s int"))


@query("with " + MOVES + """, b as (select *, max(end_us) over (partition by edit_id, kind order by start_us, move_id rows between unbounded preceding and 1 preceding) as pe from mv where kind <> 'title')
  select edit_id, 'overlap ' || kind as conflict, count(*) as n from b where start_us < pe group by all
  union all select edit_id, 'titles', count(*) from mv where kind = 'title' group by edit_id having count(*) > 1""")
def plan_conflicts(spark, sf_dir):
    return Q.plan_conflicts(_moves(spark, sf_dir))


@query("with " + RANGES_CTE + """, f as (select edit_id, range_idx, 100 + zoom_pct + end_us // 100000 % 120 as h, 300 + start_us // 250000 % 160 as e from ranges),
  l as (select *, lag(h) over o as ph, lag(e) over o as pe from f window o as (partition by edit_id order by range_idx)), r as (select *, floor(greatest(h, ph) * 1000 / least(h, ph))::bigint as s, abs(e - pe) as g from l where ph is not null)
  select edit_id, range_idx, s as size_permille, g as eye_gap from r where s > 1350 or g > 80""")
def framing_between_ranges(spark, sf_dir):
    f = ranges(spark, sf_dir).select(
        "edit_id", "range_idx", (100 + F.col("zoom_pct") + F.floor(F.col("end_us") / 100_000) % 120).alias("face_h"), (300 + F.floor(F.col("start_us") / 250_000) % 160).alias("eye_permille")
    )
    return Q.framing_between_ranges(f)


@query(r"""with p as (select doc_id as item_id, split_part(text, '.', 1) as title, text as description, n_chars % 40 as tags from documents),
  pl as (select * from (values ('short', 40, 2200, 5), ('long', 100, 5000, 30)) t(platform, a, b, c)), x as (select * from p, pl)
  select item_id, platform, unnest(list_filter([case when regexp_matches(concat_ws(' ', title, description), '\[\[[^\]]+\]\]') then 'placeholders' end, case when length(title) > a then 'title' end,
    case when length(description) > b then 'description' end, case when tags > c then 'hashtags' end], lambda v: v is not null)) as problem from x""")
def publish_limits(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.split("text", "[.]")[0].alias("title"), F.col("text").alias("description"), (F.col("n_chars") % 40).alias("n_hashtags"))
    return Q.publish_limits(d, spark.createDataFrame([("short", 40, 2200, 5), ("long", 100, 5000, 30)], "platform string, title_max int, description_max int, hashtag_max int"))


FILES = "f as (select url as path, sha256(html) as h, page_id from pages)"


@query("with " + FILES + """, n as (select path, case when length(path) % 7 = 0 then sha256(path) else h end as h from f where length(path) % 5 <> 0)
  select path, case when n.h is null then 'missing' else 'changed' end as problem from f left join n using (path) where n.h is null or n.h <> f.h""")
def verify_delivery(spark, sf_dir):
    f = table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.sha2("html", 256).alias("sha256"))
    n = F.length("path")
    return Q.verify_delivery(f, f.where(n % 5 != 0).withColumn("sha256", F.when(n % 7 == 0, F.sha2("path", 256)).otherwise(F.col("sha256"))))


@query("""with o as (select event_type || '-' || floor(value * 10)::bigint as id from events), h as (select distinct event_type || '-' || (user_id * 3) as ref from events)
  select 'repeated id' as kind, id as ref from o group by id having count(*) > 1 union all select 'unknown observation', ref from h where ref not in (select id from o)""")
def check_analysis(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    o = e.select(F.concat_ws("-", "event_type", F.floor(F.col("value") * 10).cast("string")).alias("obs_id"))
    h = e.select(F.col("event_id").alias("hyp_id"), F.array(F.concat_ws("-", "event_type", (F.col("user_id") * 3).cast("string"))).alias("based_on"))
    return Q.check_analysis(o, h)


@query(r"""with s as (select url as path, regexp_replace(split_part(url, '/', -1), '\.[^.]*$', '') as stem, split_part(url, '/', -2) as parent from pages)
  select path, case when count(*) over (partition by stem) > 1 then concat_ws('_', parent, stem) else stem end as source_id from s""")
def build_manifest(spark, sf_dir):
    return J.build_manifest(table(spark, sf_dir, "pages").select(F.col("url").alias("path")))


@query("""with s as (select p_name || ' ' || p_partkey as name, regexp_replace(regexp_replace(lower(p_name || ' ' || p_partkey % 7), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as base from part),
  n as (select name, base, row_number() over (partition by base order by name) as n from s)
  select name, case when n > 1 then base || '-' || n else base end as slug from n""")
def unique_names(spark, sf_dir):
    k = F.col("p_partkey")
    s = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", k.cast("string")).alias("name"), F.concat_ws(" ", "p_name", (k % 7).cast("string")).alias("title"))
    return J.unique_names(s, "title")


SRC = """o as (select p_partkey as source_id, p_name || '/' || p_partkey as path, p_brand as fingerprint from part where p_size <= 35),
n as (select p_partkey as source_id, p_name || '/' || p_partkey as path, case when p_size % 2 = 0 then p_brand else p_type end as fingerprint from part where p_size >= 20)"""


def _manifests(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    path = F.concat_ws("/", "p_name", F.col("p_partkey").cast("string")).alias("path")
    new = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_type")).alias("fingerprint")
    return (
        p.where("p_size <= 35").select(F.col("p_partkey").alias("source_id"), path, F.col("p_brand").alias("fingerprint")),
        p.where("p_size >= 20").select(F.col("p_partkey").alias("source_id"), path, new),
    )


@query("with " + SRC + " select * from n union all select * from o where source_id not in (select source_id from n) and path not in (select path from n)")
def merge_manifest(spark, sf_dir):
    return J.merge_manifest(*_manifests(spark, sf_dir))


@query("with " + SRC + """ select coalesce(o.source_id, n.source_id) as source_id, case when o.source_id is null then 'added' when n.source_id is null then 'kept' when o.fingerprint = n.fingerprint then 'unchanged' else 'updated' end as status
  from o full join n on o.source_id = n.source_id""")
def upsert_source(spark, sf_dir):
    return J.upsert_source(*_manifests(spark, sf_dir))


@query("""select page_id, sha256(length(html)::varchar || ':' || sha256(left(html, 1000)) || ':' || sha256(right(html, 1000))) as fingerprint,
  sha256(sha256(html) || '|' || 'lang=' || length(url) || case when page_id % 2 = 0 then ';model=m' || page_id else '' end) as cache_key from pages""")
def fingerprints(spark, sf_dir):
    """Keys of files (from the hashes of their ends) and of cached results (from content and options)."""
    p = table(spark, sf_dir, "pages")
    fp = J.fingerprint(F.length("html"), F.sha2(F.expr("left(html, 1000)"), 256), F.sha2(F.expr("right(html, 1000)"), 256))
    options = F.create_map(F.lit("lang"), F.length("url").cast("string"), F.lit("model"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("m"), F.col("page_id").cast("string"))))
    return p.select("page_id", fp.alias("fingerprint"), J.cache_key(F.sha2("html", 256), options).alias("cache_key"))


@query("select doc_id, source from documents where source not in (select distinct source from documents where lang = 'es' and n_chars > 20000)")
def work_left(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return J.work_left(d.select("doc_id", "source"), d.where("lang = 'es' and n_chars > 20000"), "source")


@query("""with s as (select page_id as asset_id, least(60, 20 * ((instr(lower(url), 'en') > 0)::int + (instr(lower(url), 'page') > 0)::int + (instr(lower(url), 'example') > 0)::int))
    + least(40, 8 * ((instr(lower(html), 'the') > 0)::int + (instr(lower(html), 'track') > 0)::int + (instr(lower(html), 'der') > 0)::int + (instr(lower(html), 'que') > 0)::int))
    + case when regexp_matches(lower(url), '/(docs|brand|assets|media|content)/') then 15 else 0 end as score from pages)
  select asset_id, score::bigint as score, row_number() over (order by score desc, asset_id) as rank from s where score >= 25 order by score desc, asset_id limit 80""")
def score_assets(spark, sf_dir):
    f = table(spark, sf_dir, "pages").select(F.col("page_id").alias("asset_id"), F.col("url").alias("path"), F.col("html").alias("text"))
    return J.score_assets(f, ["en", "page", "example"], ["the", "track", "der", "que"])


@query("""with c as (select p_name as key, p_partkey as n, p_type as value from part), f as (select key, arg_min(value, n) as first_value from c group by key)
  select distinct key, first_value, value as other_value from c join f using (key) where value <> first_value""")
def config_conflicts(spark, sf_dir):
    return J.config_conflicts(table(spark, sf_dir, "part").select(F.col("p_name").alias("key"), F.col("p_partkey").alias("file_no"), F.col("p_type").alias("value")))


STATES = "st as (select o_custkey as batch, o_orderkey as workspace, case o_orderstatus when 'F' then 'complete' when 'O' then 'plan' else 'render' end as stage, o_orderpriority as contract, o_orderdate as changed from orders)"


def _states(spark, sf_dir):
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("batch"), F.col("o_orderkey").alias("workspace"), F.when(s == "F", "complete").when(s == "O", "plan").otherwise("render").alias("stage"),
        F.col("o_orderpriority").alias("contract"), F.col("o_orderdate").alias("changed"),
    )


@query("with " + STATES + """, rq as (select * from (values ('plan', 'A'), ('render', 'A'), ('render', 'N'), ('complete', 'A'), ('complete', 'N'), ('complete', 'R')) t(stage, path)),
  m as (select workspace, count(*) as n from (select s.workspace, r.path from st s join rq r using (stage) where not exists (from lineitem l where l.l_orderkey = s.workspace and l.l_returnflag = r.path)) group by all)
  select workspace, stage, coalesce(n, 0) as n_missing, coalesce(n, 0) = 0 as ready from st left join m using (workspace)""")
def stage_status(spark, sf_dir):
    rq = spark.createDataFrame([("plan", "A"), ("render", "A"), ("render", "N"), ("complete", "A"), ("complete", "N"), ("complete", "R")], "stage string, path string")
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("workspace"), F.col("l_returnflag").alias("path"))
    return J.stage_status(_states(spark, sf_dir), rq, a)


@query("with " + STATES + """ select batch, count(*) as recordings, count(*) filter (stage = 'complete') as complete, count(distinct contract) <= 1 as shared_contract,
  min(case when stage <> 'complete' then workspace end) as next_workspace from st group by batch""")
def batch_status(spark, sf_dir):
    return J.batch_status(_states(spark, sf_dir))


@query("with " + STATES + """ select batch, workspace, epoch_us(changed) as changed_us, rank from (select *, row_number() over (partition by batch order by changed desc, workspace) as rank from st where stage <> 'complete') where rank <= 5""")
def edits_in_progress(spark, sf_dir):
    got = J.edits_in_progress(_states(spark, sf_dir))
    return got.select("batch", "workspace", F.unix_micros(F.col("changed").cast("timestamp")).alias("changed_us"), "rank")


FACES = "fc as (select l_suppkey as source_id, l_orderkey as sample_idx, l_partkey as face_idx, 20 + l_linenumber * 9 as w, 20 + l_quantity::bigint as h, l_partkey % 10 as confidence from lineitem)"


@query("with " + FACES + """ select source_id, sample_idx, face_idx from (select *, row_number() over (partition by source_id, sample_idx order by w * h desc, confidence desc, face_idx) as nth from fc) where nth = 1""")
def primary_face(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("source_id"), F.col("l_orderkey").alias("sample_idx"), F.col("l_partkey").alias("face_idx"), (20 + F.col("l_linenumber") * 9).alias("w"),
        (20 + F.col("l_quantity").cast("long")).alias("h"), (F.col("l_partkey") % 10).alias("confidence"),
    )
    return J.primary_face(f)


@query("with " + SEGMENTS_CTE + """, x as (select source_id, vec_id as sample_idx, list_transform(embedding, lambda v: floor(v * 1000)::bigint) as v from segments),
  t as (select source_id, sample_idx, k as track_id, list_sum(v[9 * k + 1 : 9 * k + 9]) as motion, v[64] as level from x, unnest(range(7)) as g(k)),
  r as (select source_id, track_id, round(case when count(*) >= 4 and not isnan(corr(motion, level)) then corr(motion, level) else 0 end, 9) as r from t group by all),
  b as (select *, row_number() over o as nth, lead(r) over o as nxt from r window o as (partition by source_id order by r desc, track_id))
  select source_id, case when r >= 0.15 and r - nxt >= 0.08 then track_id end::integer as track_id, r, round(r - nxt, 9) as margin from b where nth = 1""")
def choose_speaker(spark, sf_dir):
    """Stretches of the embeddings as recordings: seven mouths that move by nine components each, the last component as sound."""
    e = segments(spark, sf_dir).select("source_id", F.col("vec_id").alias("sample_idx"), F.transform("embedding", lambda x: scaled(x)).alias("v"))
    moves = F.array(*[F.aggregate(F.slice("v", 9 * k + 1, 9), F.lit(0).cast("long"), lambda a, x: a + x) for k in range(7)])
    t = e.select("source_id", "sample_idx", F.posexplode(moves).alias("track_id", "motion"))
    return J.choose_speaker(t, e.select("source_id", "sample_idx", F.col("v")[63].alias("level")))


@query("""select p_partkey as source_id, (case when w * 16 > h * 9 then floor(h * 9 / 16) else w end)::bigint // 2 * 2 as crop_w, (case when w * 16 > h * 9 then h else floor(w * 16 / 9) end)::bigint // 2 * 2 as crop_h
  from (select p_partkey, 320 + p_partkey % 1700 as w, 240 + p_size * 20 as h from part)""")
def crop_size(spark, sf_dir):
    return J.crop_size(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_id"), (320 + F.col("p_partkey") % 1700).alias("width"), (240 + F.col("p_size") * 20).alias("height")))


@query("with recursive " + SEGMENTS_CTE + """, v as (
    select source_id as series, vec_id as step, list_transform(embedding, lambda x: abs(floor(x * 1000)::bigint)) as v, row_number() over (partition by source_id order by vec_id) as n from segments
  ), b as (select *, list_position(v, list_max(v)) as best from v), r as (
    select series, step, n, best as held from b where n = 1
    union all select b.series, b.step, b.n, case when b.v[b.best] * 100 > b.v[r.held] * 125 then b.best else r.held end from r join b on b.series = r.series and b.n = r.n + 1
  ) select series, step, (held - 1)::integer as chosen from r""")
def choose_with_hysteresis(spark, sf_dir):
    v = F.transform("embedding", lambda x: F.abs(scaled(x)))
    return J.hysteresis(segments(spark, sf_dir).select(F.col("source_id").alias("series"), F.col("vec_id").alias("step"), v.alias("values")))


@query("with recursive " + SEGMENTS_CTE + """, p as (
    select source_id as series, vec_id as step, list_sum(list_transform(embedding, lambda x: floor(x * 100)::bigint))::double as x, row_number() over (partition by source_id order by vec_id) as n, count(*) over (partition by source_id) as k from segments
  ), f as (select series, n, k, x from p where n = 1 union all select p.series, p.n, p.k, 0.3::double * p.x + (1 - 0.3::double) * f.x from f join p on p.series = f.series and p.n = f.n + 1),
  g as (select series, n, x from f where n = k union all select f.series, f.n, 0.3::double * f.x + (1 - 0.3::double) * g.x from g join f on f.series = g.series and f.n = g.n - 1),
  h as (select series, n, x from g where n = 1 union all select g.series, g.n, case when abs(g.x - h.x) >= 20 then g.x else h.x end from h join g on g.series = h.series and g.n = h.n + 1)
  select series, step, round(h.x, 3) as x from h join p using (series, n)""")
def crop_path(spark, sf_dir):
    """Positions are the sums of the components. They are rounded once, half away from zero, in doubles: a second rounding, or one by decimal digits, moves those next to a half."""
    x = F.aggregate(F.transform("embedding", lambda v: scaled(v, 100)), F.lit(0).cast("long"), lambda a, v: a + v)
    return J.crop_path(segments(spark, sf_dir).select(F.col("source_id").alias("series"), F.col("vec_id").alias("step"), x.alias("x"))).withColumn("x", rounded(F.col("x"), 3))
