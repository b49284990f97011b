"""Audits of graphics over time and screen, with their oracles. An edit is a conversation; graphics, moves and faces are derived from its words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import recordings, words
from ..functions.scalars import ends_sentence, word_key
from ..operators import graphics as G
from ..registry import query
from ..sources.shared import written
from .speech_queries import BARE, KEY, WR

KINDS = ("sticker", "icon", "inset", "insert", "label", "end_card", "quote", "cta", "stat")
ENERGIES = [("calm", 40, 20, 1, 0, 0), ("lively", 120, 80, 4, 1, 2), ("bold", 240, 200, 7, 2, 4)]

SCREEN = WR + rf""", w as (select source_id as edit_id, idx, turn, length(word) as n, start_us as w_start, end_us as w_end, {KEY} as key, regexp_matches({BARE}, '[.!?…]$') as stop,
    source_id * 31 + idx * 17 as k from words),
  edits as (select source_id as edit_id, duration_us, case source_id % 3 when 0 then 'calm' when 1 then 'lively' else 'bold' end as energy, case when source_id % 3 = 2 then 17 else 15 end as cps,
    700 as cap_y0, 790 as cap_y1, source_id % 4 = 1 as framed, source_id % 5 = 0 as sensitive from recordings),
  energies as (select * from (values ('calm', 40, 20, 1, 0, 0), ('lively', 120, 80, 4, 1, 2), ('bold', 240, 200, 7, 2, 4)) t(energy, accents, transitions, changes, stickers, icons)),
  cues as (select edit_id, min(w_start) as c_start, max(w_end) as c_end from w group by edit_id, idx // 5),
  graphics as (select edit_id, 'g' || idx as graphic_id, {list(KINDS)}[k % 9 + 1] as kind, k % 9 >= 6 and k % 4 = 0 as film, w_start as start_us, w_start + 300000 + k % 23 * 100000 + case when k % 9 = 2 then 2000000 else 0 end as end_us,
    case when k % 9 < 4 then 0 else n * (1 + k % 5) end as chars, case when k % 9 = 2 then 250 else k * 7 % 700 end as x0, case when k % 9 = 2 then 850 else k * 7 % 700 + 80 + k % 5 * 60 end as x1,
    case when k % 9 = 2 then 300 else k * 13 % 800 end as y0, case when k % 9 = 2 then 850 else k * 13 % 800 + 40 + k % 7 * 40 end as y1 from w where idx % 7 = 3),
  ticks as (select distinct edit_id, w_start // 500000 * 500000 as face_at, w_start // 500000 + edit_id as c from w where idx % 3 = 0 and edit_id % 6 <> 5),
  faces as (select edit_id, face_at, case when c % 5 <> 4 then 300 + c * 37 % 200 end as fx0, 200 + c * 53 % 250 as fy0, 500 + c * 37 % 200 + c % 3 * 50 as fx1, 450 + c * 53 % 250 as fy1 from ticks
    union all select edit_id, face_at, 700, 100 + c % 90, 880, 300 + c % 90 from ticks where c % 4 = 0 and c % 5 <> 4),
  moves as (select edit_id, 'm' || idx as move_id, ['punch_in', 'shake', 'effect', 'transition'][k % 4 + 1] as kind, w_start as start_us, w_start + 200000 + k % 11 * 100000 as end_us, k % 3 = 0 as loud from w where idx % 9 = 4),
  turns as (select edit_id, min(w_start) as at_us from w group by edit_id, turn),
  listed as (select distinct edit_id, key from w where n = 7 and edit_id % 2 = 0)"""


def screen(spark, sf_dir):
    """graphics, cues, words, faces, moves, changes, listed, edits, energies."""
    base = written(words(spark, sf_dir), "graphics-words")  # each table below is derived from it
    w = base.select(
        F.col("source_id").alias("edit_id"), "idx", "turn", F.length("word").alias("n"), F.col("start_us").alias("w_start"), F.col("end_us").alias("w_end"),
        word_key(F.col("word")).alias("key"), ends_sentence(F.col("word")).alias("stop"), (F.col("source_id") * 31 + F.col("idx") * 17).alias("k"),
    )
    e, k, c, s = F.col("edit_id"), F.col("k"), F.col("c"), F.col("w_start")
    edits = recordings(base).select(
        F.col("source_id").alias("edit_id"), "duration_us", F.when(F.col("source_id") % 3 == 0, "calm").when(F.col("source_id") % 3 == 1, "lively").otherwise("bold").alias("energy"),
        F.when(F.col("source_id") % 3 == 2, 17).otherwise(15).alias("cps"), F.lit(700).alias("cap_y0"), F.lit(790).alias("cap_y1"),
        *[F.when(F.col("source_id") % 4 == 1, v).alias(f"frame_{n}") for n, v in (("x0", 40), ("y0", 120), ("x1", 960), ("y1", 640))], (F.col("source_id") % 5 == 0).alias("sensitive"),
    )
    energies = spark.createDataFrame(ENERGIES, "energy string, accents int, transitions int, changes int, stickers int, icons int")
    cues = w.groupBy("edit_id", F.floor(F.col("idx") / 5)).agg(F.min("w_start").alias("c_start"), F.max("w_end").alias("c_end")).select("edit_id", "c_start", "c_end")
    x0, y0 = k * 7 % 700, k * 13 % 800
    graphics = w.where("idx % 7 = 3").select(
        "edit_id", F.concat(F.lit("g"), F.col("idx").cast("string")).alias("graphic_id"), F.element_at(F.array(*map(F.lit, KINDS)), (k % 9 + 1).cast("int")).alias("kind"), ((k % 9 >= 6) & (k % 4 == 0)).alias("film"),
        s.alias("start_us"), (s + 300_000 + k % 23 * 100_000 + F.when(k % 9 == 2, 2_000_000).otherwise(0)).alias("end_us"), F.when(k % 9 < 4, 0).otherwise(F.col("n") * (1 + k % 5)).alias("chars"),
        *[F.when(k % 9 == 2, inset).otherwise(at).alias(n) for n, inset, at in (("x0", 250, x0), ("y0", 300, y0), ("x1", 850, x0 + 80 + k % 5 * 60), ("y1", 850, y0 + 40 + k % 7 * 40))],
    )
    ticks = w.where("idx % 3 = 0 and edit_id % 6 <> 5").select("edit_id", (F.floor(s / 500_000) * 500_000).alias("face_at"), (F.floor(s / 500_000) + e).alias("c")).distinct()
    x, y = c * 37 % 200, c * 53 % 250
    one = ticks.select("edit_id", "face_at", F.when(c % 5 != 4, 300 + x).alias("fx0"), (200 + y).alias("fy0"), (500 + x + c % 3 * 50).alias("fx1"), (450 + y).alias("fy1"))
    two = ticks.where("c % 4 = 0 and c % 5 <> 4").select("edit_id", "face_at", F.lit(700).alias("fx0"), (100 + c % 90).alias("fy0"), F.lit(880).alias("fx1"), (300 + c % 90).alias("fy1"))
    moves = w.where("idx % 9 = 4").select(
        "edit_id", F.concat(F.lit("m"), F.col("idx").cast("string")).alias("move_id"), F.element_at(F.array(*map(F.lit, ("punch_in", "shake", "effect", "transition"))), (k % 4 + 1).cast("int")).alias("kind"),
        s.alias("start_us"), (s + 200_000 + k % 11 * 100_000).alias("end_us"), (k % 3 == 0).alias("loud"),
    )
    changes = w.groupBy("edit_id", "turn").agg(F.min("w_start").alias("at_us")).select("edit_id", "at_us")
    listed = w.where("n = 7 and edit_id % 2 = 0").select("edit_id", "key").distinct()
    spoken = w.select("edit_id", "idx", "w_start", "w_end", "key", "stop")
    graphics, cues, spoken, faces, moves = (written(t, n) for t, n in ((graphics, "graphics"), (cues, "cues"), (spoken, "spoken"), (one.unionByName(two), "faces"), (moves, "moves")))
    return graphics, cues, spoken, faces, moves, changes, listed, edits, energies


MOTION = SCREEN + """, share as (select *, greatest(0, least(fx1, x1) - greatest(fx0, x0)) * greatest(0, least(fy1, y1) - greatest(fy0, y0)) as both_,
      greatest(0, least(fx1 - 0.25 * (fx1 - fx0), x1) - greatest(fx0 + 0.25 * (fx1 - fx0), x0)) * greatest(0, least(fy1, y1) - greatest(fy0 + 0.6 * (fy1 - fy0), y0)) as on_mouth, 0.5 * (fx1 - fx0) * 0.4 * (fy1 - fy0) as mouth_area
    from (select l.*, f.*exclude (edit_id) from (
        select edit_id, graphic_id as ref, case when film then end_us + 100000 else (start_us + end_us) // 2 end as at_us, x0, y0, x1, y1 from graphics where kind not in ('inset', 'insert')
        union all select edit_id, graphic_id, t, x0, y0, x1, y1 from (select *, unnest(range(start_us, end_us, 250000)) as t from graphics where kind = 'inset') g
          where exists (from w where w.edit_id = g.edit_id and w_start <= t and t < w_end)
        union all select edit_id, move_id, (start_us + end_us) // 2, 0, 0, 0, 0 from moves where kind = 'transition') l
      join faces f on f.edit_id = l.edit_id and abs(f.face_at - l.at_us) <= 260000)
    qualify face_at = first_value(face_at) over (partition by edit_id, ref, at_us order by abs(face_at - at_us), face_at)),
  per as (select edit_id, ref, at_us, count(fx0) as n_faces, max(greatest(both_ * 1000000 // greatest(1, (fx1 - fx0) * (fy1 - fy0)), both_ * 1000000 // greatest(1, (x1 - x0) * (y1 - y0)))) filter (fx0 is not null) as either_,
    max(greatest(0, least(fy1, y1) - greatest(fy0, y0)) * 1000000 // greatest(1, fy1 - fy0)) filter (fx0 is not null) as tall, bool_or(on_mouth > 0.3 * mouth_area) filter (fx0 is not null) as mouth from share group by all),
  seen as (select edit_id, ref, max(n_faces) as n_faces, max(either_) as either_, max(tall) as tall, 250000 * count(*) filter (mouth) as hidden from per group by all),
  g as (select g.*, e.* exclude (edit_id), n.* exclude (energy), s.n_faces, either_, tall, hidden, g.edit_id % 6 <> 5 and exists (from faces f where f.edit_id = g.edit_id) as looked,
      exists (from cues c where c.edit_id = g.edit_id and c_start < end_us and start_us < c_end) as talking, end_us - start_us as shown, greatest(0, least(y1, cap_y1) - greatest(y0, cap_y0)) as in_band,
      exists (from graphics l where l.edit_id = g.edit_id and l.kind = 'label' and l.start_us < g.end_us and g.start_us < l.end_us) as with_label, kind in ('sticker', 'icon') as boxed,
      kind in ('sticker', 'icon', 'inset', 'insert') as bare from graphics g join edits e using (edit_id) join energies n using (energy) left join seen s on s.edit_id = g.edit_id and s.ref = g.graphic_id),
  v as (select edit_id, 'readable' as rule, graphic_id as ref, start_us as at_us, shown >= 600000 + chars * 1000000 // cps as passed, shown as measured, 600000 + chars * 1000000 // cps as expected from g where not bare and chars > 0
    union all select edit_id, 'clear of captions', graphic_id, start_us, in_band = 0, in_band, 0 from g where not bare and not film and kind <> 'end_card' and not (kind = 'label' and framed) and talking
    union all select edit_id, 'clear of captions', graphic_id, start_us, not (talking and in_band > 0), in_band, 0 from g where boxed or kind = 'inset'
    union all select edit_id, 'clear of the scene frame', graphic_id, start_us, least(y1, 652) <= greatest(y0, 108), greatest(0, least(y1, 652) - greatest(y0, 108)), 0 from g where not bare and not film and kind not in ('label', 'end_card') and framed and with_label
    union all select edit_id, 'clear of the scene frame', graphic_id, start_us, p = 0, p, 0 from (select *, greatest(0, least(x1, 960) - greatest(x0, 40)) * greatest(0, least(y1, 640) - greatest(y0, 120)) * 1000000 // ((x1 - x0) * (y1 - y0)) as p from g) where boxed and framed
    union all select edit_id, 'hides the speaker', graphic_id, start_us, false, shown, 0 from g where not bare and film and n_faces > 0
    union all select edit_id, 'clear of faces', graphic_id, start_us, tall <= 300000, tall, 300000 from g where not bare and not film and kind <> 'end_card' and n_faces > 0
    union all select edit_id, 'clear of faces', graphic_id, start_us, coalesce(either_, 0) <= 50000, coalesce(either_, 0), 50000 from g where boxed and looked
    union all select edit_id, 'on screen', graphic_id, start_us, shown between 600000 and case kind when 'icon' then 1200000 else 1500000 end, shown, case kind when 'icon' then 1200000 else 1500000 end from g where boxed
    union all select edit_id, 'within the energy''s limit', graphic_id, start_us, case kind when 'icon' then icons else stickers end > 0, case kind when 'icon' then icons else stickers end, 1 from g where boxed
    union all select edit_id, 'off a talking mouth', graphic_id, start_us, coalesce(hidden, 0) <= 2000000, coalesce(hidden, 0), 2000000 from g where kind = 'inset' and looked
    union all select distinct edit_id, 'faces measured', null, null::bigint, false, 0, 1 from graphics where edit_id not in (select edit_id from faces)
    union all select m.edit_id, 'transition clear of speech', move_id, (start_us + end_us) // 2, false, t, 0 from (select m.edit_id, move_id, start_us, end_us, sum(least(end_us, w_end) - greatest(start_us, w_start)) as t
        from moves m join w on w.edit_id = m.edit_id and w_start < end_us and start_us < w_end where kind = 'transition' group by all) m left join seen s on s.edit_id = m.edit_id and s.ref = move_id
      where t > 50000 and (s.n_faces > 0 or m.edit_id not in (select edit_id from faces))
    union all select edit_id, rule, null, null, measured <= expected, measured, expected from (
      select edit_id, unnest([{'rule': 'accents per minute', 'measured': ((ng + np) * 1200000000 + d) // (2 * d), 'expected': (accents * 125 + 50) // 100},
        {'rule': 'transitions per minute', 'measured': (nt * 1200000000 + d) // (2 * d), 'expected': transitions}, {'rule': 'picture changes per 30 s', 'measured': ((nc + nt) * 600000000 + d) // (2 * d), 'expected': changes * 10}], recursive := true), nc
      from (select e.*, n.* exclude (energy), greatest(duration_us, 1000000) as d, (select count(*) from graphics g where g.edit_id = e.edit_id) as ng, (select count(*) from moves m where m.edit_id = e.edit_id and kind = 'punch_in') as np,
        (select count(*) from moves m where m.edit_id = e.edit_id and kind = 'transition') as nt, (select count(*) from moves m where m.edit_id = e.edit_id and kind in ('effect', 'shake')) as nc from edits e join energies n using (energy)))
      where rule <> 'picture changes per 30 s' or nc > 0
    union all select edit_id, 'something changes', null, arg_max(at_us, gap::hugeint * 100000000000000 - at_us), max(gap) <= 6000000, max(gap), 6000000 from (select edit_id, at_us, coalesce(lead(at_us) over (partition by edit_id order by at_us) - at_us, 0) as gap from (
      select edit_id, at_us from (select edit_id, 0 as at_us from edits union select edit_id, duration_us from edits union select * from turns union select edit_id, start_us from graphics union select edit_id, end_us from graphics
        union select edit_id, start_us from moves where kind in ('punch_in', 'effect') union select edit_id, end_us from moves where kind in ('punch_in', 'effect') union select edit_id, (start_us + end_us) // 2 from moves where kind = 'transition')
      join edits using (edit_id) where at_us between 0 and duration_us)) group by edit_id
    union all select edit_id, 'spaced from the last effect', move_id, start_us, gap >= 4000000, gap, 4000000 from (select *, start_us - lag(end_us) over (partition by edit_id order by start_us, move_id) as gap from moves where kind = 'effect') where gap is not null
    union all select edit_id, 'on a sentence boundary', move_id, start_us, near <= 400000, near, 400000 from (select m.edit_id, move_id, start_us, min(abs(start_us - t)) as near from moves m
      join (select edit_id, w_end as t from w where stop union select edit_id, c_start from cues) b on b.edit_id = m.edit_id where kind = 'effect' group by all)
    union all select edit_id, 'loud on a sensitive topic', move_id, start_us, false, 1, 0 from moves where kind = 'effect' and loud and edit_id % 5 = 0
    union all select edit_id, 'word marked', idx::varchar, w_start, hit, hit::int, 1 from (select w.edit_id, idx, w_start, exists (from moves m where m.edit_id = w.edit_id and kind in ('punch_in', 'shake') and w_start between start_us - 300000 and end_us) as hit from w join listed using (edit_id, key)))
  select edit_id, rule, ref, at_us::bigint as at_us, passed, measured::bigint as measured, expected::bigint as expected from v"""


@query(MOTION)
def motion_audit(spark, sf_dir):
    return G.motion_audit(*screen(spark, sf_dir))
