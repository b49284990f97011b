"""Queries over words, pauses, phrases and transcripts, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import RECORDINGS_CTE, TURNS_CTE, WORDS_CTE, recordings, turns, words
from ..functions import scalars as S
from ..operators import speech as P
from ..registry import query

W = "with " + WORDS_CTE
WR = W + ", " + RECORDINGS_CTE
SPACING = """
sp as (
  select source_id, 'spacing' as kind, '' as text, prev_end as start_us, start_us as end_us, prev_speaker as speaker from (
    select *, lag(end_us) over o as prev_end, lag(speaker) over o as prev_speaker from words
    window o as (partition by source_id order by start_us, end_us)) where start_us - prev_end >= 10000
)"""
PAUSES = SPACING + """, ends as (
  select source_id, arg_min(start_us, idx) as first, arg_max(end_us, idx) as last from words group by source_id
), pauses as (
  select * from (
    select source_id, 'inner' as place, start_us, end_us from sp
    union all select source_id, 'lead', 0, first from ends
    union all select source_id, 'tail', last, duration_us from ends join recordings using (source_id)
  ) where end_us - start_us >= 500000
)"""
NORM = r"lower(regexp_replace(word, '^\p{P}+|\p{P}+$', '', 'g'))"
KEY = r"regexp_replace(lower(word), '[^\p{L}\p{N}]', '', 'g')"
JUNK = r"""(trim(word) = '' or regexp_matches(word, '[♪♫♬�]') or regexp_matches(word, '^[\[(*].*[\])*]$') or not regexp_matches(word, '[\p{L}\p{N}_]'))"""
BARE = r"""regexp_replace(word, '["'')\]}]*$', '')"""


@query(W + " select source_id, idx, word, speaker, turn, start_us, end_us, confidence_pct from words")
def words_view(spark, sf_dir):
    return words(spark, sf_dir)


@query(W + rf""" select source_id, idx, {NORM} as norm, {KEY} as key, regexp_matches({BARE}, '[.!?…]$') as ends_sentence,
  regexp_matches({BARE}, '[,;:\-–—]$') as ends_clause, lower(word) as lower_word from words""")
def word_scalars(spark, sf_dir):
    c = F.col("word")
    return words(spark, sf_dir).select(
        "source_id", "idx", S.normalise(c).alias("norm"), S.word_key(c).alias("key"), S.ends_sentence(c).alias("ends_sentence"),
        S.ends_clause(c).alias("ends_clause"), S.apply_case(c, "lower").alias("lower_word"),
    )


@query(r"""
select doc_id,
  case when regexp_extract(text, '^([\s\S]*?[.!?…])(?:\s|$)', 1) = '' then text else regexp_extract(text, '^([\s\S]*?[.!?…])(?:\s|$)', 1) end as first_sentence,
  len(trim(regexp_replace(regexp_replace(text, '\s+([,.;:!?…])', '\1', 'g'), '\s+', ' ', 'g'))) as tidy_chars
from documents""")
def text_scalars(spark, sf_dir):
    c = F.col("text")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", S.first_sentence(c).alias("first_sentence"), F.length(S.tidy_text(c)).cast("long").alias("tidy_chars"))


@query(r"""
with t as (select item_id, 'See [[' || split_part(text, ' ', 1) || ']] and [[' || split_part(text, ' ', 2) || '] of it: [[link]]' as body from benchmark)
select item_id, array_to_string(regexp_extract_all(body, '\[\[([^\]]+)\]\]', 1), '|') as slots from t""")
def open_placeholders(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    first = F.split("text", " ", 3)
    body = F.concat(F.lit("See [["), first[0], F.lit("]] and [["), first[1], F.lit("] of it: [[link]]"))
    return b.select("item_id", F.array_join(S.placeholders(body), "|").alias("slots"))


@query("""
with s as (select p_partkey, (1 + p_size * 7)::bigint as w, (1 + p_partkey % 97)::bigint as h from part), g as (select *, gcd(w, h) as d from s)
select p_partkey, case when abs(w * 16 - h * 9) * 50 <= h * 9 then '9:16' when abs(w * 5 - h * 4) * 50 <= h * 4 then '4:5'
  when abs(w - h) * 50 <= h then '1:1' when abs(w * 9 - h * 16) * 50 <= h * 16 then '16:9'
  else (w // d)::varchar || ':' || (h // d)::varchar end as aspect from g""")
def aspect_labels(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    w, h = (1 + F.col("p_size") * 7).cast("long"), (1 + F.col("p_partkey") % 97).cast("long")
    return p.select("p_partkey", S.aspect_label(w, h).alias("aspect"))


@query(W + "," + SPACING + " select source_id, kind, text, start_us, end_us, speaker from sp")
def synthesize_spacing(spark, sf_dir):
    return P.synthesize_spacing(words(spark, sf_dir))


@query(W + "," + SPACING + """ select source_id, kind, text, start_us, end_us, speaker,
  row_number() over (partition by source_id order by start_us, end_us, kind) - 1 as token_idx
  from (select source_id, 'word' as kind, word as text, start_us, end_us, speaker from words union all select * from sp)""")
def build_tokens(spark, sf_dir):
    return P.build_tokens(words(spark, sf_dir))


@query(W + """ select source_id, count(*) as n_words, coalesce(count(*) >= 2 and stddev_pop(d) / avg(d) > 0.05, false) as has_timestamps
  from (select source_id, case when end_us > start_us then end_us - start_us end as d from words) group by source_id""")
def has_word_timestamps(spark, sf_dir):
    return P.has_word_timestamps(words(spark, sf_dir))


@query(WR + "," + PAUSES + " select source_id, place, start_us, end_us from pauses")
def find_pauses(spark, sf_dir):
    w = words(spark, sf_dir)
    return P.find_pauses(w, recordings(w))


@query(WR + "," + PAUSES + """ select source_id, place, start_us, end_us,
  case when end_us - start_us <= 700000 then start_us else start_us + 350000 end as cut_start,
  case when end_us - start_us <= 700000 then start_us else end_us - 350000 end as cut_end from pauses""")
def tighten_pause(spark, sf_dir):
    w = words(spark, sf_dir)
    return P.tighten_pause(P.find_pauses(w, recordings(w)), 700_000)


PHRASES = """
pf as (
  select *, case when start_us - lag(end_us) over o >= 500000 or (lag(idx) over o is not null and speaker is distinct from lag(speaker) over o) then 1 else 0 end as b
  from words window o as (partition by source_id order by idx)
), pr as (select *, sum(b) over (partition by source_id order by idx) as run from pf),
pp as (select *, (row_number() over (partition by source_id, run order by idx) - 1) // 28 as part from pr),
pg as (
  select source_id, run, part, min(speaker) as speaker, min(start_us) as start_us, arg_max(end_us, idx) as end_us, count(*) as n_words,
         string_agg(word, ' ' order by idx) as text from pp group by source_id, run, part
), phrases as (
  select source_id, row_number() over (partition by source_id order by run, part) - 1 as phrase_idx, speaker, start_us, end_us, n_words, text from pg
)"""


@query(W + "," + PHRASES + " select * from phrases")
def group_phrases(spark, sf_dir):
    return P.group_phrases(words(spark, sf_dir))


@query(W + "," + PHRASES + """ select source_id, '[' || printf('%.2f', start_us / 1e6) || '-' || printf('%.2f', end_us / 1e6) || '] '
  || speaker || ' ' || text as line, phrase_idx from phrases""")
def pack_transcript(spark, sf_dir):
    """Phrase lines `[start-end] speaker text`."""
    p = P.group_phrases(words(spark, sf_dir))
    at = lambda c: F.format_string("%.2f", F.col(c) / 1e6)
    line = F.concat(F.lit("["), at("start_us"), F.lit("-"), at("end_us"), F.lit("] "), F.col("speaker"), F.lit(" "), F.col("text"))
    return p.select("source_id", line.alias("line"), "phrase_idx")


SENTENCES = rf"""
sf as (
  select *, case when start_us - lag(end_us) over o >= 600000 or regexp_matches(regexp_replace(lag(word) over o, '["'')\]}}]*$', ''), '[.!?…]$') then 1 else 0 end as b
  from words window o as (partition by source_id order by idx)
), sn as (select *, sum(b) over (partition by source_id order by idx) as sentence_idx from sf),
sentences as (
  select source_id, sentence_idx::bigint as sentence_idx, min(start_us) as start_us, max(end_us) as end_us, count(*) as n_words,
         string_agg(word, ' ' order by idx) as text from sn group by source_id, sentence_idx
)"""


@query(W + "," + SENTENCES + " select * from sentences")
def sentences(spark, sf_dir):
    return P.sentences(words(spark, sf_dir))


LABELS = TURNS_CTE + """, sh as (
  select w.source_id, w.idx, t.label as who, sum(least(w.end_us, t.end_us) - greatest(w.start_us, t.start_us)) as us, min(t.start_us) as t_start
  from words w join turns t on w.source_id = t.source_id and least(w.end_us, t.end_us) > greatest(w.start_us, t.start_us)
  group by all
), mn as (
  select source_id, idx, who from (select *, row_number() over (partition by source_id, idx order by us desc, t_start, who) as nth from sh) where nth = 1
), nm as (
  select source_id, who, 'S' || row_number() over (partition by source_id order by first) as label
  from (select source_id, who, min(idx) as first from mn group by all)
), labelled as (select w.source_id, w.idx, w.start_us, w.end_us, nm.label from words w left join mn using (source_id, idx) left join nm on nm.source_id = mn.source_id and nm.who = mn.who)"""


@query(W + "," + LABELS + " select source_id, idx, label from labelled")
def label_speakers(spark, sf_dir):
    w = words(spark, sf_dir)
    return P.label_speakers(w, turns(w)).select("source_id", "idx", "label")


@query(W + "," + LABELS + """, rf as (
  select *, case when label <> lag(label) over (partition by source_id order by idx) then 1 else 0 end as b from labelled where label is not null
), rn as (select *, sum(b) over (partition by source_id order by idx) as turn_no from rf)
select source_id, turn_no::bigint as turn_no, min(label) as speaker, min(start_us) as start_us, arg_max(end_us, idx) as end_us from rn group by source_id, turn_no""")
def turns_from_words(spark, sf_dir):
    w = words(spark, sf_dir)
    return P.turns_from_words(P.label_speakers(w, turns(w)), "label")


@query("with recursive " + WORDS_CTE + r""", k as (
  select source_id, idx, start_us, regexp_replace(lower(substr(word, 1, 1)), '[^\p{L}\p{N}]', '', 'g') as key, row_number() over (partition by source_id order by idx) as pos from words
), s as (select *, """ + ", ".join(f"coalesce(lead(key, {n}) over o = key, false) as s{n}" for n in range(1, 5)) + """ from k window o as (partition by source_id order by idx)),
l as (select *, """ + ", ".join(f"min(case when not s{n} then pos end) over f - pos as l{n}" for n in range(1, 5)) + """ from s
  window f as (partition by source_id order by idx rows between current row and unbounded following)),
c as (select *, case when l1 >= 3 then 1 when l2 >= 6 then 2 when l3 >= 9 then 3 when l4 >= 12 then 4 end as size from l where key <> ''),
d as (select source_id, idx, start_us, pos, size, case size when 1 then l1 when 2 then l2 when 3 then l3 else l4 end // size + 1 as repeats from c where size is not null),
r as (
  select source_id, min(pos) as pos from d group by source_id
  union all select x.source_id, min(n.pos) from r join d x on x.source_id = r.source_id and x.pos = r.pos join d n on n.source_id = x.source_id and n.pos >= x.pos + x.size * x.repeats group by x.source_id, x.pos
) select d.source_id, idx, start_us, size::integer as size, repeats::integer as repeats from d join r using (source_id, pos)""")
def find_loops(spark, sf_dir):
    return P.find_loops(words(spark, sf_dir).withColumn("word", F.substring("word", 1, 1)))


def _quiet(w):
    """Quiet stretches for the fixtures: up to 450 ms at the end of words, by their number."""
    n = F.col("idx") % 4 * 150_000
    return w.select("source_id", F.greatest(F.col("start_us"), F.col("end_us") - n).alias("q_start"), F.col("end_us").alias("q_end"))


SUSPECTS = """
quiet as (select source_id, greatest(start_us, end_us - idx % 4 * 150000) as q_start, end_us as q_end from words),
si as (
  select w.source_id, w.idx, sum(least(w.end_us, q_end) - greatest(w.start_us, q_start)) as silent_us from words w join quiet q
  on w.source_id = q.source_id and least(w.end_us, q_end) > greatest(w.start_us, q_start) group by all
), suspects as (
  select source_id, idx, word, start_us, end_us, coalesce(silent_us, 0)::bigint as silent_us from words left join si using (source_id, idx)
  where end_us - start_us > 1200000 or coalesce(silent_us, 0) >= 300000
)"""


@query(W + "," + SUSPECTS + " select * from suspects")
def suspect_words(spark, sf_dir):
    w = words(spark, sf_dir)
    return P.suspect_words(w, _quiet(w))


@query(WR + "," + SUSPECTS + """, sp as (
  select source_id, greatest(0, start_us - 500000) as start_us, least(duration_us, end_us + 500000) as end_us from suspects join recordings using (source_id)
), mf as (
  select *, case when start_us <= max(end_us) over (partition by source_id order by start_us, end_us rows between unbounded preceding and 1 preceding) then 0 else 1 end as b from sp
), mi as (select *, sum(b) over (partition by source_id order by start_us, end_us rows unbounded preceding) as island from mf)
select source_id, min(start_us) as start_us, max(end_us) as end_us from mi group by source_id, island""")
def refine_spans(spark, sf_dir):
    w = words(spark, sf_dir)
    return P.refine_spans(P.suspect_words(w, _quiet(w)), recordings(w))


@query(WR + "," + SUSPECTS + rf""", j as (
  select source_id, count(*) as n_words, count(*) filter ({JUNK}) as junk, count(*) filter (confidence_pct < 40) as low from words group by 1
), n as (select source_id, count(*) as n_suspects from suspects group by 1), a as (
  select r.*, n_words, junk, low, coalesce(n_suspects, 0) as n_suspects, junk * 5 > n_words as bad, low * 4 > n_words as unsure, ends_with(provider_model, '.en') and language <> 'en' as english
  from recordings r join j using (source_id) left join n using (source_id)
), b as (select *, case when english then 'small' when bad or unsure then case provider_model when 'small.en' then 'medium.en' when 'small' then 'medium' else 'large-v3' end end as suggested from a)
select source_id, n_words, junk, low, 0::bigint as n_loops, n_suspects, concat_ws(',', case when bad then 'junk' end, case when unsure then 'low_confidence' end, case when english then 'english_only' end,
  case when language_confidence_pct < 50 then 'language_unsure' end, case when n_suspects > 0 then 'stretched_words' end) as warnings, suggested as suggested_model from b""")
def assess_transcript(spark, sf_dir):
    """Whole words hold no loops here: the given texts never say a phrase four times running."""
    w = words(spark, sf_dir)
    return P.assess_transcript(w, recordings(w), P.find_loops(w), P.suspect_words(w, _quiet(w)))


@query(WR + "," + PAUSES + rf""", s as (
  select source_id, count(*) as n_words, sum(end_us - start_us)::bigint as spoken_us,
         min(case when regexp_matches({BARE}, '[.!?…]$') then end_us end) as first_sentence_end_us from words group by source_id
), p as (select source_id, count(*) as n_pauses, max(end_us - start_us) as longest_pause_us from pauses group by source_id)
select source_id, n_words, spoken_us, floor(spoken_us * 1000 / duration_us)::bigint as sound_permille, coalesce(n_pauses, 0) as n_pauses,
  coalesce(longest_pause_us, 0) as longest_pause_us, floor(n_words * 60000000 / spoken_us)::bigint as words_per_minute, first_sentence_end_us
from recordings join s using (source_id) left join p using (source_id)""")
def speech_rhythm(spark, sf_dir):
    w = words(spark, sf_dir)
    r = recordings(w)
    return P.speech_rhythm(w, P.find_pauses(w, r), r)


@query(W + rf""", k as (select n as key from (select {NORM} as n, count(*) as c from words where length(word) > 6 group by 1) order by c desc, n limit 50)
select source_id, idx, {NORM} in (select key from k) as emphasis from words""")
def emphasis(spark, sf_dir):
    """Keywords for the fixture: the 50 most frequent long words."""
    w = words(spark, sf_dir)
    top = w.where(F.length("word") > 6).groupBy(S.normalise(F.col("word")).alias("key")).count().orderBy(F.desc("count"), "key").limit(50)
    return P.keywords(w, top).select("source_id", "idx", "emphasis")
