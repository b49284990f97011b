"""Audits of openings and whole reels, with their oracles. An edit is a conversation; captions, cards, overlays and pictures are derived from its words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import recordings, words
from ..operators import openings as O
from ..registry import query
from ..sources.shared import written
from .speech_queries import BARE, KEY, WR

KINDS = ["end_card", "hook", "cta", "hook_title", "end_teaser", "quote", "end_card", "chapter"]
FILES = ["a.mp4", "b.PNG", "c.mov", "d.jpeg"]
LEANING = ["the", "of", "and", "a", "to", "der", "die", "und", "de", "la", "el", "w", "i", "na"]

FILM = WR + rf""", w as (select source_id as edit_id, idx, turn, word, idx // 5 as cue_idx, start_us as w_start, end_us as w_end, source_id * 31 + idx * 17 as k from words),
  edits as (select source_id as edit_id, duration_us, case when source_id % 4 = 3 then 'open' else 'content_first' end as policy, 450000 as silence_limit_us,
      case source_id % 3 when 0 then (select string_agg(word, ' ' order by idx) from w where w.edit_id = r.source_id and idx < 3 + source_id % 5) when 1 then 'words of its own' end as brief,
      case when source_id % 2 = 0 then 'phrase' else 'block' end as mode, case when source_id % 5 < 2 then 'story' else 'speech' end as origin from recordings r),
  cues as (select edit_id, cue_idx, case when cue_idx = 0 and edit_id % 3 <> 2 then 0 else min(w_start) end as c_start, max(w_end) as c_end, string_agg(word, ' ' order by idx) as text from w group by edit_id, cue_idx),
  el as (select edit_id, 'e' || idx as element_id, {KINDS}[k % 8 + 1] as kind, w_start, k, idx // 7 % 4 as j, duration_us from w join edits using (edit_id) where idx % 7 = 3),
  elements as (select edit_id, element_id, kind, case when kind = 'end_card' and k % 11 > 1 then duration_us - (j + 1) * 700000 when k % 3 = 0 then k % 9 * 150000 else w_start end as start_us,
      case when kind = 'end_card' and k % 11 > 1 then duration_us - j * 700000 - k % 5 // 4 * 300000 when k % 3 = 0 then k % 9 * 150000 + 900000 else w_start + 500000 + k % 6 * 400000 end as end_us from el),
  overlays as (select edit_id, 'o' || idx as overlay_id, ['motion_film', 'picture', 'clip'][k % 3 + 1] as kind, case when k % 2 = 0 then 'end_card' else 'quote' end as card, {FILES}[k % 4 + 1] as file,
      case when k % 5 = 0 then 'PNG' else 'h264' end as codec, case when k % 7 < 3 then k % 7 * 240000 else w_start end as start_us, w_start + 700000 as end_us from w where idx % 8 = 5),
  ranges as (select edit_id, turn as range_idx, {FILES}[(edit_id + turn) % 4 + 1] as file, 'h264' as codec, case when (edit_id + turn) % 5 = 0 then 'end_card' end as fill, min(w_start) as at_us from w group by edit_id, turn),
  pictures as (select edit_id, case when edit_id % 10 <> 9 then edit_id * 97 % 2600 end as mean, edit_id * 53 % 400 as detail, edit_id * 29 % 40 as change from edits where edit_id % 9 <> 8),
  silences as (select edit_id, b as s_start, w_start as s_end from (select *, lag(w_end) over (partition by edit_id order by idx) as b from w) where w_start - b >= 350000
    union all select edit_id, 0, min(w_start) + edit_id % 3 * 50000 from w where edit_id % 2 = 0 group by edit_id),
  changes as (select edit_id, at_us from ranges where (edit_id + range_idx) % 2 = 0 union all select edit_id, start_us from overlays union all select edit_id, end_us from overlays),
  publish as (select edit_id, case when edit_id % 4 = 0 then 'Save this' end as cta, text as description from cues where cue_idx = 1 and edit_id % 6 <> 0),
  platforms as (select * from (values ('short', 15000000, 60000000), ('long', 60000000, 180000000)) t(platform, best_min_us, best_max_us)),
  cue as (select edit_id, arg_min(c_start, (c_start, cue_idx)) as c_start, arg_min(text, (c_start, cue_idx)) as text from cues group by edit_id)"""


def film(spark, sf_dir):
    """The tables by name."""
    base = written(words(spark, sf_dir), "openings-words")  # each table below is derived from it
    e, k, idx, s = F.col("edit_id"), F.col("k"), F.col("idx"), F.col("w_start")
    w = base.select(F.col("source_id").alias("edit_id"), "idx", "turn", "word", F.floor(F.col("idx") / 5).alias("cue_idx"), F.col("start_us").alias("w_start"), F.col("end_us").alias("w_end"), (F.col("source_id") * 31 + F.col("idx") * 17).alias("k"))
    text = lambda df, *key: df.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"]), " ").alias("text"), F.min("w_start").alias("a"), F.max("w_end").alias("b"))
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    opening = text(w.where(idx < 3 + e % 5), "edit_id").select("edit_id", F.col("text").alias("_t"))
    edits = recordings(base).select(F.col("source_id").alias("edit_id"), "duration_us").join(opening, "edit_id", "left").select(
        "edit_id", "duration_us", F.when(e % 4 == 3, "open").otherwise("content_first").alias("policy"), F.lit(450_000).alias("silence_limit_us"), F.when(e % 3 == 0, F.col("_t")).when(e % 3 == 1, "words of its own").alias("brief"),
        F.when(e % 2 == 0, "phrase").otherwise("block").alias("mode"), F.when(e % 5 < 2, "story").otherwise("speech").alias("origin"),
    )
    cues = text(w, "edit_id", "cue_idx").select("edit_id", "cue_idx", F.when((F.col("cue_idx") == 0) & (e % 3 != 2), 0).otherwise(F.col("a")).cast("long").alias("c_start"), F.col("b").alias("c_end"), "text")
    kind, j, d = pick(KINDS, k % 8), F.floor(idx / 7) % 4, F.col("duration_us")
    ending = (F.col("kind") == "end_card") & (k % 11 > 1)
    elements = w.where("idx % 7 = 3").join(edits.select("edit_id", "duration_us"), "edit_id").withColumn("kind", kind).select(
        "edit_id", F.concat(F.lit("e"), idx.cast("string")).alias("element_id"), "kind", F.when(ending, d - (j + 1) * 700_000).when(k % 3 == 0, k % 9 * 150_000).otherwise(s).alias("start_us"),
        F.when(ending, d - j * 700_000 - F.floor(k % 5 / 4) * 300_000).when(k % 3 == 0, k % 9 * 150_000 + 900_000).otherwise(s + 500_000 + k % 6 * 400_000).alias("end_us"),
    )
    overlays = w.where("idx % 8 = 5").select(
        "edit_id", F.concat(F.lit("o"), idx.cast("string")).alias("overlay_id"), pick(["motion_film", "picture", "clip"], k % 3).alias("kind"), F.when(k % 2 == 0, "end_card").otherwise("quote").alias("card"),
        pick(FILES, k % 4).alias("file"), F.when(k % 5 == 0, "PNG").otherwise("h264").alias("codec"), F.when(k % 7 < 3, k % 7 * 240_000).otherwise(s).alias("start_us"), (s + 700_000).alias("end_us"),
    )
    n = e + F.col("turn")
    ranges = w.groupBy("edit_id", "turn").agg(F.min("w_start").alias("at_us")).select("edit_id", F.col("turn").alias("range_idx"), pick(FILES, n % 4).alias("file"), F.lit("h264").alias("codec"), F.when(n % 5 == 0, "end_card").alias("fill"), "at_us")
    pictures = edits.where("edit_id % 9 <> 8").select("edit_id", F.when(e % 10 != 9, e * 97 % 2600).alias("mean"), (e * 53 % 400).alias("detail"), (e * 29 % 40).alias("change"))
    from pyspark.sql import Window

    b = F.lag("w_end").over(Window.partitionBy("edit_id").orderBy("idx"))
    lead = w.where("edit_id % 2 = 0").groupBy("edit_id").agg(F.min("w_start").alias("_s")).select("edit_id", F.lit(0).cast("long").alias("s_start"), (F.col("_s") + e % 3 * 50_000).alias("s_end"))
    silences = w.withColumn("s_start", b).where("w_start - s_start >= 350000").select("edit_id", "s_start", s.alias("s_end")).unionByName(lead)
    over = overlays.select("edit_id", F.explode(F.array("start_us", "end_us")).alias("at_us"))
    changes = ranges.where("(edit_id + range_idx) % 2 = 0").select("edit_id", "at_us").unionByName(over)
    publish = cues.where("cue_idx = 1 and edit_id % 6 <> 0").select("edit_id", F.when(e % 4 == 0, "Save this").alias("cta"), F.col("text").alias("description"))
    platforms = spark.createDataFrame([("short", 15_000_000, 60_000_000), ("long", 60_000_000, 180_000_000)], "platform string, best_min_us long, best_max_us long")
    leaning = spark.createDataFrame([(x,) for x in LEANING], "key string")
    return {
        "edits": edits, "elements": elements, "overlays": overlays, "ranges": ranges, "cues": cues, "words": w.select("edit_id", "cue_idx", "w_start", "w_end"), "pictures": pictures,
        "silences": silences, "changes": changes, "publish": publish, "platforms": platforms, "leaning": leaning,
    }


OPENING = FILM + r""", still as (select *, kind <> 'motion_film' and (regexp_matches(lower(file), '\.(png|jpg|jpeg|webp|gif|bmp|tif|tiff)$') or lower(codec) = 'png') as is_still from overlays),
  card as (select el.*, duration_us from elements el join edits using (edit_id) where kind = 'end_card'),
  ends as (select *, not exists (select 1 from card b where b.edit_id = c.edit_id and (b.end_us > c.end_us or b.end_us = c.end_us and b.element_id <= c.element_id)
      and b.end_us < least(b.duration_us, coalesce((select min(x.start_us) from card x where x.edit_id = b.edit_id and (x.end_us > b.end_us or x.end_us = b.end_us and x.element_id < b.element_id)), b.duration_us)) - 100000) as at_end from card c),
  bag as (select edit_id, c_start, text, brief, list_distinct(regexp_extract_all(lower(brief), '[\p{L}\p{N}_]+')) as bs, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as ts from edits join cue using (edit_id) where brief <> ''),
  v as (select edit_id, 'issue' as severity, 'film at the start' as rule, overlay_id as ref, false as passed, start_us as measured, 500000 as expected from still where kind = 'motion_film' and start_us < 500000
    union all select edit_id, 'issue', 'still at the start', overlay_id, false, start_us, 500000 from still where is_still and start_us < 500000
    union all select edit_id, 'issue', 'card at the start', element_id, false, start_us, 500000 from elements where kind in ('hook', 'chapter', 'end_card') and start_us < 500000
    union all select edit_id, 'issue', 'opens on a still', range_idx::varchar, false, 0, 0 from ranges r where range_idx = (select min(range_idx) from ranges x where x.edit_id = r.edit_id) and file in ('b.PNG', 'd.jpeg')
    union all select edit_id, 'issue', 'end card before the end', element_id, false, end_us, duration_us from ends where not at_end
    union all select edit_id, 'issue', 'end film before the end', overlay_id, false, end_us, duration_us from overlays join edits using (edit_id) where kind = 'motion_film' and card = 'end_card' and end_us < duration_us - 100000
    union all select edit_id, 'issue', 'end card fill before the end', range_idx::varchar, false, range_idx, m from (select *, max(range_idx) over (partition by edit_id) as m from ranges) where fill = 'end_card' and range_idx < m
    union all select edit_id, 'warning', 'late title', element_id, false, start_us, 1000000 from elements where kind = 'hook_title' and start_us > 1000000
    union all select edit_id, 'issue', 'first frame', note, note = 'moving', mean, 200 from (select edit_id, mean, case when p.edit_id is null then 'no picture' when mean is null then 'undecoded' when mean < 200 then 'black'
        when mean > 2350 and detail < 100 then 'white' when detail < 40 then 'flat' when change < 5 then 'still' else 'moving' end as note from edits e left join pictures p using (edit_id))
    union all select edit_id, 'issue', 'first cue', null, coalesce(c_start <= 40000, false), c_start, 40000 from edits left join cue using (edit_id)
    union all select edit_id, 'issue', 'leading silence', null, coalesce(q, 0) <= 450000, coalesce(q, 0), 450000 from edits left join (select edit_id, min(s_end) as q from silences where s_start <= 20000 group by edit_id) using (edit_id)
    union all select edit_id, 'issue', 'brief''s first line', null, len(list_filter(bs, lambda x: not list_contains(ts, x))) = 0 or len(list_filter(ts, lambda x: not list_contains(bs, x))) = 0, len(list_intersect(bs, ts)), len(bs) from bag
    union all select edit_id, 'warning', 'first word', null, coalesce(f <= 500000, false), f, 500000 from edits left join (select edit_id, min(w_start) as f from w group by edit_id) using (edit_id)),
  o as (select edit_id, count(*) filter (severity = 'issue' and not passed) as n from v group by edit_id)
  select edit_id, severity, rule, ref, passed, measured::bigint as measured, expected::bigint as expected from v
  union all select edit_id, 'verdict', 'ready', policy, policy <> 'content_first' or n = 0, n, 0 from edits join o using (edit_id)"""


@query(OPENING)
def opening_audit(spark, sf_dir):
    t = film(spark, sf_dir)
    return O.opening_audit(*[t[n] for n in ("edits", "elements", "overlays", "ranges", "cues", "words", "pictures", "silences")])


ASK = r"(^|[^\p{L}\p{N}_])(" + O.SHARE
REEL = FILM + rf""", ordered as (select c.*, row_number() over o as nth, lead(c_start) over o is not null as more, coalesce((select max(w_end) - min(w_start) from w where w.edit_id = c.edit_id and w.cue_idx = c.cue_idx), c_end - c_start) as span,
      regexp_extract(text, '(\S+)\s*$', 1) as word, duration_us from cues c join edits using (edit_id) window o as (partition by edit_id order by c_start, cue_idx)),
  hanging as (select *, more and not regexp_matches({BARE}, '[.!?…,;:\-–—]$') and {BARE} <> '' and {KEY} in {tuple(LEANING)} as hangs from ordered),
  shown as (select edit_id, sum(c_end - c_start) as shown, count(*) filter (nth > 1 and span > 2500000) as n_long, max(span) filter (nth > 1 and span > 2500000) as longest, count(*) filter (hangs) as n_hanging,
      arg_max(text, cue_idx) as closing, bool_or(c_end > greatest(0, duration_us - 4000000) and regexp_matches(lower(text), '{ASK}|{O.FOLLOW})')) as spoken from hanging group by edit_id),
  said as (select edit_id, min(w_start) as f, max(w_end) as l from w group by edit_id),
  dead as (select edit_id, max(s_end - s_start) as dead from silences join said using (edit_id) where s_start > f + 50000 and s_end < l - 50000 group by edit_id),
  drawn as (select edit_id, max(end_us - start_us) filter (kind = 'end_card') as card, bool_or(kind in ('cta', 'end_teaser', 'end_card') and end_us > greatest(0, duration_us - 4000000)) as drawn from elements join edits using (edit_id) group by edit_id),
  hold as (select edit_id, max(gap) as hold from (select edit_id, lead(at_us) over (partition by edit_id order by at_us) - at_us as gap from (select edit_id, at_us from
      (select * from changes union select edit_id, start_us from elements union select edit_id, end_us from elements union select edit_id, 0 from edits union select edit_id, duration_us from edits) join edits using (edit_id) where at_us between 0 and duration_us)) group by edit_id),
  t as (select e.*, shown, n_long, longest, n_hanging, closing, f, l, coalesce(dead, 0) as dead, coalesce(card, 0) as card, coalesce(drawn, false) or coalesce(spoken, false) as nxt, hold, regexp_matches(lower(concat_ws(' ', cta, description)), '{ASK})') as copy, p.edit_id is not null as published,
      case when shown is null then 0 when l > f then least(1000, shown * 1000 // (l - f)) else 1000 end as share
    from edits e left join shown using (edit_id) left join said using (edit_id) left join dead using (edit_id) left join drawn using (edit_id) left join hold using (edit_id) left join publish p on p.edit_id = e.edit_id),
  v as (select edit_id, 'situation heard at once' as rule, null as ref, coalesce(f <= 1000000, false) as passed, f as measured, 1000000 as expected from t
    union all select edit_id, 'no dead air inside the speech', null, dead <= 700000, dead, 700000 from t where f is not null
    union all select edit_id, 'ends on the payoff', null, greatest(0, duration_us - l) <= 600000, greatest(0, duration_us - l), 600000 from t where f is not null
    union all select edit_id, 'the picture changes every few seconds', null, hold <= 5000000, hold, 5000000 from t
    union all select edit_id, 'no lingering end card', null, card <= 2000000, card, 2000000 from t
    union all select edit_id, 'the end says what next', null, nxt, nxt::int, 1 from t
    union all select edit_id, 'captioned for sound off', null, share >= 950, share, 950 from t
    union all select edit_id, 'phrase captions change often', null, n_long = 0, longest, 2500000 from t where mode = 'phrase' and shown is not null
    union all select edit_id, 'captions end on whole phrases', null, n_hanging = 0, n_hanging, 0 from t where mode = 'phrase' and shown is not null
    union all select edit_id, 'the story ends on a question', null, coalesce(closing like '%?', false), coalesce(closing like '%?', false)::int, 1 from t where origin = 'story'
    union all select edit_id, 'asks for a save or a send', null, copy, copy::int, 1 from t where published
    union all select edit_id, 'length suits', platform, duration_us between best_min_us and best_max_us, duration_us, best_max_us from edits, platforms)
  select edit_id, 'warning' as severity, rule, ref, passed, measured::bigint as measured, expected::bigint as expected from v"""


@query(REEL)
def reel_audit(spark, sf_dir):
    t = film(spark, sf_dir)
    return O.reel_audit(*[t[n] for n in ("edits", "cues", "words", "silences", "changes", "elements", "publish", "platforms", "leaning")])
