"""Queries over refined passages, fixes and caption boxes, with their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import RANGES_CTE, WORDS_CTE, ranges, table, words
from ..operators import amends as M
from ..registry import query
from ..sources.shared import written
from .speech_queries import W

KEYED = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]', '', 'g')"


@query(W + ", " + RANGES_CTE + """, e as (select source_id, edge, min(rank) as rank from (select source_id, start_us as edge, 0 as rank from words union all select source_id, end_us, 1 from words) group by 1, 2),
  p as (select distinct source_id, end_us as at_us from ranges)
  select p.source_id, at_us, coalesce(arg_min(edge, (abs(edge - at_us), rank, edge)), at_us) as to_us from p left join e on e.source_id = p.source_id group by 1, 2""")
def snap_to_word(spark, sf_dir):
    return M.snap_to_word(ranges(spark, sf_dir).select("source_id", F.col("end_us").alias("at_us")), words(spark, sf_dir))


@query(W + ", " + RANGES_CTE + """, p as (select distinct source_id, start_us as at_us from ranges)
  select p.source_id, at_us, coalesce(arg_min(w.start_us, (abs(w.start_us - at_us), w.start_us)), at_us) as to_us from p left join words w on w.source_id = p.source_id group by 1, 2""")
def snap_to_start(spark, sf_dir):
    return M.snap_to_word(ranges(spark, sf_dir).select("source_id", F.col("start_us").alias("at_us")), words(spark, sf_dir), "start")


FAR = KEYED.format("p.word")


@query(W + rf""", spans as (select source_id, min(case when idx = 10 then start_us end) + 40000 as lo_us, min(case when idx = 20 then start_us end) + 40000 as hi_us from words group by 1 having max(idx) >= 20),
  ps as (select w.source_id, w.idx as pos, case when w.idx = 19 then w.word || '.' else w.word end as word, w.start_us - lo_us + w.source_id % 4 * 90000 as s, w.end_us - lo_us + w.source_id % 4 * 90000 as e
    from words w join spans using (source_id) where w.idx between 10 and 20),
  o as (select w.*, lo_us, hi_us, lo_us is not null and w.start_us >= lo_us and w.end_us <= hi_us as inside from words w left join spans using (source_id)),
  k as (select * from o where not inside),
  h as (select source_id, pos, word, least(s + lo_us, hi_us) as a, least(e + lo_us, hi_us) as b, lo_us, hi_us from ps join spans using (source_id) where s >= 0),
  n as (select p.*, {FAR} as key from h p where not exists (from k where k.source_id = p.source_id and k.start_us < p.hi_us and k.end_us > p.lo_us
    and (least(p.b, k.end_us) - greatest(p.a, k.start_us)) * 2 > greatest(p.b - p.a, 1000))),
  r as (select p.*, {FAR} as key from k p where lo_us is not null),
  m as (select n.*, pos = min(pos) over (partition by source_id) as first, pos = max(pos) over (partition by source_id) as last from n),
  c as (select *, coalesce(first and exists (from (select arg_max(key, (start_us, idx)) as x, arg_max(end_us, (start_us, idx)) as y from r where r.source_id = m.source_id and start_us < m.lo_us and m.lo_us < end_us) where x = m.key and m.a - y < 300000), false)
    or coalesce(last and exists (from (select arg_min(key, (start_us, idx)) as x, arg_min(start_us, (start_us, idx)) as y from r where r.source_id = m.source_id and start_us < m.hi_us and m.hi_us < end_us) where x = m.key and y - m.b < 300000), false) as again from m),
  l as (select *, pos = max(pos) over (partition by source_id) as final, regexp_replace(word, '[.!?…]+$', '') as bare,
    (select arg_min(word, (start_us, idx)) from r where r.source_id = c.source_id and start_us >= c.hi_us) as nxt from c where not again),
  a as (select source_id, idx, word, start_us, end_us, false as refined from k union all
    select source_id, pos, case when final and coalesce(regexp_matches(nxt, '^\p{{Ll}}'), false) and bare <> '' then bare else word end, a, b, true from l)
  select source_id, row_number() over (partition by source_id order by start_us, end_us, refined, idx) - 1 as idx, word, start_us, end_us, refined from a""")
def splice_refined(spark, sf_dir):
    """Words 10 to 20 of a recording as heard again, between the middles of both, a quarter of the recordings later by 90 ms each."""
    w = words(spark, sf_dir)
    at = lambda n: F.min(F.when(F.col("idx") == n, F.col("start_us"))) + 40_000
    spans = w.groupBy("source_id").agg(at(10).alias("lo_us"), at(20).alias("hi_us")).where("hi_us is not null")
    shift = F.col("source_id") % 4 * 90_000 - F.col("lo_us")
    ps = w.where("idx between 10 and 20").join(spans, "source_id").select(
        "source_id", F.col("idx").alias("pos"), F.when(F.col("idx") == 19, F.concat("word", F.lit("."))).otherwise(F.col("word")).alias("word"),
        (F.col("start_us") + shift).alias("start_us"), (F.col("end_us") + shift).alias("end_us"),
    )
    return M.splice_refined(w.select("source_id", "idx", "word", "start_us", "end_us"), ps, spans)


FIXES = """f as (select edit_id, range_idx as fix_idx, 'ranges[' || range_idx * 5 % 7 || '].' || case when edit_id % 11 = 0 then 'colour' else ['start_us', 'end_us', 'zoom_pct', 'speed_pct'][(start_us // 250000) % 4 + 1] end as path,
  case (start_us // 250000) % 4 when 0 then start_us // 2 when 1 then end_us + 4000000 when 2 then 105 else 110 end as value, edit_id % 5 = 0 as approved from ranges where edit_id % 3 = 0 and range_idx < 3)"""


@query("with " + RANGES_CTE + ", " + FIXES + r""", q as (select *, regexp_extract(path, '\[(\d+)\]', 1)::bigint as place, split_part(path, '.', 2) as field from f where not approved),
  x as (select *, row_number() over (partition by edit_id order by range_idx) - 1 as place from ranges),
  w as (select edit_id, place, arg_max(value, fix_idx) filter (field = 'start_us') as a, arg_max(value, fix_idx) filter (field = 'end_us') as b,
    arg_max(value, fix_idx) filter (field = 'zoom_pct') as z, arg_max(value, fix_idx) filter (field = 'speed_pct') as s from q group by 1, 2),
  n as (select x.*, coalesce(a, start_us) as a, coalesce(b, end_us) as b, coalesce(z, zoom_pct)::integer as z, coalesce(s, speed_pct)::integer as s from x left join w using (edit_id, place)),
  bad as (select edit_id from q where field = 'colour' union select edit_id from q where not exists (from x where x.edit_id = q.edit_id and x.place = q.place) union select edit_id from n where a < 0 or b <= a or s <= 0),
  t as (select n.*, case when edit_id not in (select edit_id from q) then 'unchanged' when edit_id in (select edit_id from bad) then 'refused' else 'applied' end as status from n)
  select edit_id, range_idx, source_id, case when status = 'applied' then a else start_us end as start_us, case when status = 'applied' then b else end_us end as end_us,
    case when status = 'applied' then z else zoom_pct end as zoom_pct, case when status = 'applied' then s else speed_pct end as speed_pct, beat, status from t""")
def apply_fixes(spark, sf_dir):
    """Up to three fixes in every third edit; some of them name no range or no field."""
    r = ranges(spark, sf_dir)
    k = (F.floor(F.col("start_us") / 250_000) % 4).cast("int")
    field = F.when(F.col("edit_id") % 11 == 0, "colour").otherwise(F.element_at(F.array(*map(F.lit, M.FIELDS)), k + 1))
    f = r.where("edit_id % 3 = 0 and range_idx < 3").select(
        "edit_id", F.col("range_idx").alias("fix_idx"), F.concat(F.lit("ranges["), (F.col("range_idx") * 5 % 7).cast("string"), F.lit("]."), field).alias("path"),
        F.when(k == 0, F.floor(F.col("start_us") / 2)).when(k == 1, F.col("end_us") + 4_000_000).when(k == 2, 105).otherwise(110).alias("value"), (F.col("edit_id") % 5 == 0).alias("approved"),
    )
    return M.apply_fixes(r, f)


TRACK = W + r""", c as (select source_id as edit_id, idx // 6 as cue_idx, min(start_us) as start_us, max(end_us) as end_us, list({'text': word, 'start_us': start_us, 'end_us': end_us} order by idx) as words from words group by 1, 2),
  fx as (select edit_id, cue_idx as fix_id, start_us + 200000 + case when fix_at = 2 then 25000000 else 0 end as at_us,
    case fix_at when 1 then lower(words[2].text) || ' ' || words[3].text || '!!' when 3 then 'nothing like it' else words[2].text || ' ' || words[3].text end as old,
    case (edit_id + cue_idx) % 3 when 0 then 'a' when 1 then 'of it all' else 'twice so' end as new from (select *, (edit_id + cue_idx // 3) % 4 as fix_at from c where FIXED and len(words) = 6)),
  near as (select f.*, (select arg_min(cue_idx, (greatest(c.start_us - at_us, at_us - c.end_us, 0), cue_idx)) from c where c.edit_id = f.edit_id and greatest(c.start_us - at_us, at_us - c.end_us, 0) <= 1000000) as cue_idx from fx f),
  n2 as (select n.*, words, string_split(old, ' ') as was, string_split(new, ' ') as becomes, list_transform(words, lambda x: x.text) as said from near n left join c using (edit_id, cue_idx)),
  n3 as (select *, list_transform(said, lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}]', '', 'g')) as bsaid, list_transform(was, lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}]', '', 'g')) as bwas from n2),
  n4 as (select *, coalesce(list_filter(range(1, len(said) - len(was) + 2), lambda i: said[i : i + len(was) - 1] = was)[1], list_filter(range(1, len(said) - len(was) + 2), lambda i: bsaid[i : i + len(was) - 1] = bwas)[1]) as hit from n3)"""


def _track(spark, sf_dir, fixed):
    w = words(spark, sf_dir)
    word = F.struct("idx", F.struct(F.col("word").alias("text"), "start_us", "end_us").alias("w"))
    c = w.groupBy(F.col("source_id").alias("edit_id"), F.floor(F.col("idx") / 6).alias("cue_idx")).agg(
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.transform(F.array_sort(F.collect_list(word)), lambda x: x["w"]).alias("words")
    )
    c = written(c, "track")  # read as cues and for the fixes
    case = (F.col("edit_id") + F.floor(F.col("cue_idx") / 3)) % 4
    a, b, new = F.get("words", F.lit(1))["text"], F.get("words", F.lit(2))["text"], (F.col("edit_id") + F.col("cue_idx")) % 3
    f = c.where(fixed).where(F.size("words") == 6).select(
        "edit_id", F.col("cue_idx").alias("fix_id"), (F.col("start_us") + 200_000 + F.when(case == 2, 25_000_000).otherwise(0)).alias("at_us"),
        F.when(case == 1, F.concat(F.lower(a), F.lit(" "), b, F.lit("!!"))).when(case == 3, "nothing like it").otherwise(F.concat(a, F.lit(" "), b)).alias("old"),
        F.when(new == 0, "a").when(new == 1, "of it all").otherwise("twice so").alias("new"),
    )
    return c, f


@query(TRACK.replace("FIXED", "cue_idx % 3 = 1") + """, n5 as (select *, case when cue_idx is null then 'no cue' when hit is null then 'not said' end as problem, words[hit].start_us as a, words[hit + len(was) - 1].end_us as b, len(becomes) as k from n4),
  n6 as (select *, list_concat(words[1 : hit - 1], list_transform(becomes, lambda t, i: {'text': t, 'start_us': a + (b - a) * (i - 1) // k, 'end_us': a + (b - a) * i // k}), words[hit + len(was) :]) as fixed from n5)
  select edit_id, fix_id, cue_idx, problem, case when problem is null then array_to_string(list_transform(fixed, lambda x: x.text || '@' || x.start_us || '-' || x.end_us), ' ') end as fixed from n6""")
def fix_words(spark, sf_dir):
    """A fix in every third cue of six words: as said, in small letters, at a wrong time, or of words that nobody said."""
    told = F.transform("words", lambda x: F.concat(x["text"], F.lit("@"), x["start_us"].cast("string"), F.lit("-"), x["end_us"].cast("string")))
    return M.fix_words(*_track(spark, sf_dir, "cue_idx % 3 = 1")).select("edit_id", "fix_id", "cue_idx", "problem", F.array_join(told, " ").alias("fixed"))


@query(TRACK.replace("FIXED", "cue_idx = 4") + r""", b as (select edit_id, cue_idx, list_transform(words, lambda x: regexp_replace(lower(x.text), '[^\p{L}\p{N}]', '', 'g')) as bs from c),
  s as (select n4.edit_id, n4.fix_id, count(*) filter (len(list_filter(range(1, len(bs) - len(bwas) + 2), lambda i: bs[i : i + len(bwas) - 1] = bwas)) > 0) as holders,
    count(*) filter (len(list_filter(range(1, len(bs) - len(becomes) + 2), lambda i: bs[i : i + len(becomes) - 1] = becomes)) > 0) as news from n4 join b on b.edit_id = n4.edit_id group by 1, 2)
  select edit_id, fix_id, at_us, case when hit is not null then 'applied' when holders = 1 then 'moved' when news > 0 then 'done' else 'lost' end as state from n4 join s using (edit_id, fix_id)""")
def carry_fixes(spark, sf_dir):
    """One fix an edit, so that its state has a set form; several in a row are tested against a plain loop."""
    out = M.carry_fixes(*_track(spark, sf_dir, "cue_idx = 4")).where("kind = 'fix'")
    return out.select("edit_id", F.col("n").alias("fix_id"), F.col("start_us").alias("at_us"), F.col("text").alias("state"))


@query(W + """, c as (select source_id as edit_id, idx // 7 as cue_idx, list(length(word) order by idx) as ls from words group by 1, 2),
  z as (select size, floor(900 * 0.97 / (size * 0.58) + 1e-9)::bigint as lim from (select unnest(range(46, 65)) as size)),
  t as (select edit_id, cue_idx, size, list_reduce(list_prepend(0::bigint, list_transform(ls, lambda l: l::bigint)), lambda s, x: case when x > lim then s + 1000000000000 when s % 1000000 = 0 then s + x
    when s % 1000000 + 1 + x <= lim then s + 1 + x else s - s % 1000000 + 1000000 + x end) // 1000000 + 1 as n from c, z),
  f as (select edit_id, cue_idx, max(size) as size, arg_max(n, size) as n from t where n <= 2 group by 1, 2)
  select c.edit_id, c.cue_idx, size::integer as size_px, n as n_lines from c left join f using (edit_id, cue_idx)""")
def fit_check(spark, sf_dir):
    """Cues of seven words in a box of 900 px, two lines of 64 px."""
    w = words(spark, sf_dir)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"]), " ")
    return M.fit_check(w.groupBy(F.col("source_id").alias("edit_id"), F.floor(F.col("idx") / 7).alias("cue_idx")).agg(text.alias("text")), 64, 900, 2)


@query("""with s as (select p_partkey, 20 + p_partkey % 60 as font_pct10, 100 + p_size % 9 * 10 as margin_pct10, 10 + p_size as max_chars, 1 + p_partkey % 3 as max_lines, p_partkey % 2 = 0 as boxed, 720 + p_partkey % 4 * 120 as width, 1280 + p_partkey % 2 * 640 as height from part),
  n as (select *, ceil(max_chars / max_lines)::bigint * greatest(8000, height * font_pct10) * 58 as needed, width * (1000 - margin_pct10) - case when boxed then 50000 else 0 end as room from s)
  select p_partkey, (needed // 100000)::bigint as needed_px, (room // 1000)::bigint as available_px, needed <= room * 97 as fits from n""")
def style_fits(spark, sf_dir):
    k = F.col("p_partkey")
    s = table(spark, sf_dir, "part").select(
        "p_partkey", (20 + k % 60).alias("font_pct10"), (100 + F.col("p_size") % 9 * 10).alias("margin_pct10"), (10 + F.col("p_size")).alias("max_chars"), (1 + k % 3).alias("max_lines"),
        (k % 2 == 0).alias("boxed"), (720 + k % 4 * 120).alias("width"), (1280 + k % 2 * 640).alias("height"),
    )
    return M.style_fits(s).select("p_partkey", "needed_px", "available_px", "fits")
