"""The graphics of an edit against what is on screen and heard with them: a row per rule and thing it is about.

Boxes are per mille of the frame, (x0, y0) top left. Shares are parts per million, rounded down. Faces are samples of the picture: they meet the moments at which a rule
looks in half-second ticks, so a long edit is spread over (edit, tick); a tick holds the faces of one or two pictures, which needs no cells of the screen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .intervals import overlap_join, range_join

TICK_US, REACH_US = 500_000, 260_000

# How long graphics and pictures may last, how near they may come, in microseconds, per mille or parts per million.
BOXED = ("sticker", "icon")
SHORTEST, LONGEST_STICKER, LONGEST_ICON = 600_000, 1_500_000, 1_200_000
NOTICE = 600_000
CLEARANCE = 12
FACE_BOXED, FACE_BAND = 50_000, 300_000
MOUTH_STEP, MOUTH_LIMIT = 250_000, 2_000_000
SPEECH_UNDER = 50_000
STILL_LIMIT = 6_000_000
EFFECT_GAP, BOUNDARY = 4_000_000, 400_000
WORD_SLACK = 300_000

OUT = ["edit_id", "rule", "ref", "at_us", "passed", "measured", "expected"]


def share(a: str, b: str) -> Column:
    """What part of box a box b covers; names are prefixes of x0, y0, x1, y1."""
    wide = f"greatest(0, least({a}x1, {b}x1) - greatest({a}x0, {b}x0))"
    high = f"greatest(0, least({a}y1, {b}y1) - greatest({a}y0, {b}y0))"
    return F.expr(f"cast({wide} as long) * {high} * 1000000 div greatest(1, ({a}x1 - {a}x0) * ({a}y1 - {a}y0))")


def told(when: Column, name: str, ok: Column, measured: Column, expected: Column) -> Column:
    """A rule's verdict where it applies, else null."""
    return F.when(when, F.struct(F.lit(name).alias("rule"), ok.alias("passed"), measured.cast("long").alias("measured"), expected.cast("long").alias("expected")))


def faces_at(looks: DataFrame, faces: DataFrame) -> DataFrame:
    """(edit_id, look, ref, at_us, n_faces, either, tall, mouth): what the nearest sample within 0.26 s of each look (edit_id, look, ref, at_us, x0, y0, x1, y1) shows.

    faces: (edit_id, face_at, fx0, fy0, fx1, fy1), with a null box for a picture without faces. either: the larger share of face or box that the other covers; tall: the share of
    a face's height in the box's rows; mouth: whether the box covers over 0.3 of a mouth. The largest of all faces of the picture. Of two samples as near the earlier one counts.
    """
    bins = F.explode(F.sequence(F.floor((F.col("at_us") - REACH_US) / TICK_US), F.floor((F.col("at_us") + REACH_US) / TICK_US)))
    met = looks.withColumn("_tick", bins).join(faces.withColumn("_tick", F.floor(F.col("face_at") / TICK_US)), ["edit_id", "_tick"]).where(F.abs(F.col("at_us") - F.col("face_at")) <= REACH_US)
    # a mouth is the middle half of the lower two fifths of a face; in twentieths of a per mille all its edges are whole numbers
    mx0, mx1, my0, my1 = "(20 * fx0 + 5 * (fx1 - fx0))", "(20 * fx1 - 5 * (fx1 - fx0))", "(20 * fy0 + 12 * (fy1 - fy0))", "(20 * fy1)"
    inside = f"greatest(0, least({mx1}, 20 * x1) - greatest({mx0}, 20 * x0)) * cast(greatest(0, least({my1}, 20 * y1) - greatest({my0}, 20 * y0)) as long)"
    tall = "greatest(0, least(fy1, y1) - greatest(fy0, y0)) * cast(1000000 as long) div greatest(1, fy1 - fy0)"
    key = ["edit_id", "look", "ref", "at_us"]
    shown = F.col("fx0").isNotNull()  # least and greatest pass over nulls, so pictures without faces are told apart
    per = met.groupBy(*key, "face_at").agg(
        F.count("fx0").alias("n_faces"),
        F.max(F.when(shown, F.greatest(share("f", ""), share("", "f")))).alias("either"),
        F.max(F.when(shown, F.expr(tall))).alias("tall"),
        F.max(F.when(shown, F.expr(f"{inside} * 10 > 3 * cast({mx1} - {mx0} as long) * ({my1} - {my0})"))).alias("mouth"),
    )
    nearest = F.min_by(F.struct("n_faces", "either", "tall", "mouth"), F.struct(F.abs(F.col("at_us") - F.col("face_at")), "face_at"))
    return per.groupBy(*key).agg(nearest.alias("_s")).select(*key, "_s.*")


def graphic_rules(graphics: DataFrame, cues: DataFrame, words: DataFrame, faces: DataFrame, edits: DataFrame, energies: DataFrame) -> DataFrame:
    """Verdicts about single graphics (edit_id, graphic_id, kind, film, start_us, end_us, chars, x0, y0, x1, y1).

    Time to read, time on screen, the energy's allowance, clear of captions, of the scene frame and of faces, and insets off a talking mouth. cues: (edit_id, c_start, c_end); words:
    (edit_id, w_start, w_end); edits: (edit_id, energy, cps, cap_y0, cap_y1, frame_x0, frame_y0, frame_x1, frame_y1), no frame where those are null; energies as in `motion_audit`.
    """
    span = graphics.select("edit_id", "graphic_id", "kind", "start_us", "end_us")
    talk = overlap_join(span, cues, ["edit_id"], ("start_us", "end_us"), ("c_start", "c_end")).groupBy("edit_id", "graphic_id").agg(F.count("*").alias("n_cues"))
    labels = span.where("kind = 'label'").select("edit_id", F.col("start_us").alias("l_start"), F.col("end_us").alias("l_end"))
    framed = overlap_join(span.where("kind <> 'label'"), labels, ["edit_id"], ("start_us", "end_us"), ("l_start", "l_end")).select("edit_id", "graphic_id").distinct().withColumn("with_label", F.lit(True))

    kind = F.col("kind")
    boxed, bare = kind.isin(*BOXED), kind.isin(*BOXED, "inset", "insert")
    middle = F.floor((F.col("start_us") + F.col("end_us")) / 2)
    look = F.when(boxed, "box").when(~bare & F.col("film"), "film").when(~bare, "band")
    box = ["x0", "y0", "x1", "y1"]
    once = graphics.withColumn("look", look).where("look is not null").select("edit_id", "look", F.col("graphic_id").alias("ref"), F.when(F.col("look") == "film", F.col("end_us") + 100_000).otherwise(middle).alias("at_us"), *box)
    moments = graphics.where("kind = 'inset' and end_us > start_us").select("edit_id", F.lit("mouth").alias("look"), F.col("graphic_id").alias("ref"), F.explode(F.sequence("start_us", F.col("end_us") - 1, F.lit(MOUTH_STEP).cast("long"))).alias("at_us"), *box)
    heard = range_join(moments, words, ["edit_id"], ("at_us", "at_us"), ("w_start", "w_end"), (F.col("w_start") <= F.col("at_us")) & (F.col("at_us") < F.col("w_end"))).drop("w_start", "w_end").distinct()
    seen = faces_at(once.unionByName(heard), faces).groupBy("edit_id", F.col("ref").alias("graphic_id")).agg(
        F.max("n_faces").alias("n_faces"), F.max("either").alias("either"), F.max("tall").alias("tall"), (F.count_if("mouth") * MOUTH_STEP).alias("hidden")
    )
    measured = faces.select("edit_id").distinct().withColumn("looked", F.lit(True))
    df = graphics.join(edits, "edit_id").join(F.broadcast(energies), "energy", "left").join(measured, "edit_id", "left")  # a row an energy
    df = df.join(talk, ["edit_id", "graphic_id"], "left").join(framed, ["edit_id", "graphic_id"], "left").join(seen, ["edit_id", "graphic_id"], "left")

    zero, on, frame = F.lit(0), F.col("end_us") - F.col("start_us"), F.col("frame_x0").isNotNull()
    talking = F.coalesce("n_cues", zero) > 0
    longest = F.when(kind == "icon", LONGEST_ICON).otherwise(LONGEST_STICKER)
    allowed = F.when(kind == "icon", F.col("icons")).otherwise(F.col("stickers"))
    in_band = F.greatest(zero, F.least("y1", "cap_y1") - F.greatest("y0", "cap_y0"))
    in_frame = F.greatest(zero, F.least(F.col("y1"), F.col("frame_y1") + CLEARANCE) - F.greatest(F.col("y0"), F.col("frame_y0") - CLEARANCE))
    on_frame, faced = share("", "frame_"), F.coalesce("n_faces", zero) > 0
    need = NOTICE + F.expr("chars * cast(1000000 as long) div cps")
    drawn = F.col("y0").isNotNull() & (kind != "end_card") & ~F.col("film")
    verdicts = F.array(
        told(~bare & (F.col("chars") > 0), "readable", on >= need, on, need),
        told(~bare & drawn & ~((kind == "label") & frame) & talking, "clear of captions", in_band == 0, in_band, zero),
        told(~bare & drawn & (kind != "label") & frame & F.col("with_label"), "clear of the scene frame", in_frame == 0, in_frame, zero),
        told(~bare & F.col("film") & faced, "hides the speaker", F.lit(False), on, zero),
        told(~bare & drawn & faced, "clear of faces", F.col("tall") <= FACE_BAND, F.col("tall"), F.lit(FACE_BAND)),
        told(boxed, "on screen", on.between(SHORTEST, longest), on, longest),
        told(boxed, "within the energy's limit", F.coalesce(allowed, zero) > 0, F.coalesce(allowed, zero), F.lit(1)),
        told(boxed & F.col("looked"), "clear of faces", F.coalesce("either", zero) <= FACE_BOXED, F.coalesce("either", zero), F.lit(FACE_BOXED)),
        told(boxed | (kind == "inset"), "clear of captions", ~(talking & (in_band > 0)), in_band, zero),
        told(boxed & frame, "clear of the scene frame", on_frame == 0, on_frame, zero),
        told((kind == "inset") & F.col("looked"), "off a talking mouth", F.coalesce("hidden", zero) <= MOUTH_LIMIT, F.coalesce("hidden", zero), F.lit(MOUTH_LIMIT)),
    )
    return df.select("edit_id", F.col("graphic_id").alias("ref"), F.col("start_us").alias("at_us"), F.explode(F.array_compact(verdicts)).alias("_v")).select("edit_id", "ref", "at_us", "_v.*").select(*OUT)


def transition_rules(moves: DataFrame, words: DataFrame, faces: DataFrame) -> DataFrame:
    """Transitions (kind, of moves) that run over 0.05 s of speech or more while a face is on screen, or where no face was ever looked for in the edit; one row each, not passed."""
    t = moves.where("kind = 'transition'").select("edit_id", F.col("move_id").alias("ref"), F.floor((F.col("start_us") + F.col("end_us")) / 2).alias("at_us"), "start_us", "end_us")
    talk = overlap_join(t, words, ["edit_id"], ("start_us", "end_us"), ("w_start", "w_end")).groupBy("edit_id", "ref", "at_us").agg(F.sum(F.col("hi_us") - F.col("lo_us")).alias("measured")).where(F.col("measured") > SPEECH_UNDER)
    none = F.lit(0)
    seen = faces_at(talk.select("edit_id", F.lit("transition").alias("look"), "ref", "at_us", *[none.alias(c) for c in ("x0", "y0", "x1", "y1")]), faces).select("edit_id", "ref", "n_faces")
    looked = faces.select("edit_id").distinct().withColumn("_looked", F.lit(True))
    hit = talk.join(seen, ["edit_id", "ref"], "left").join(looked, "edit_id", "left").where("_looked is null or n_faces > 0")
    return hit.withColumns({"rule": F.lit("transition clear of speech"), "passed": F.lit(False), "expected": F.lit(0).cast("long")}).select(*OUT)


def longest_still(changes: DataFrame, edits: DataFrame, limit_us: int) -> DataFrame:
    """(edit_id, measured, at_us, passed): the longest stretch of an edit (edit_id, duration_us) in which nothing changes, the first of equals. changes: (edit_id, at_us)."""
    ends = edits.select("edit_id", F.explode(F.array(F.lit(0).cast("long"), F.col("duration_us"))).alias("at_us"))
    inside = changes.join(edits.select("edit_id", "duration_us"), "edit_id").where("at_us between 0 and duration_us").select("edit_id", "at_us")
    gap = F.lead("at_us").over(Window.partitionBy("edit_id").orderBy("at_us")) - F.col("at_us")
    per = inside.unionByName(ends).distinct().withColumn("gap", F.coalesce(gap, F.lit(0))).groupBy("edit_id").agg(F.max("gap").alias("measured"), F.max_by("at_us", F.struct("gap", -F.col("at_us"))).alias("at_us"))
    return per.withColumn("passed", F.col("measured") <= limit_us)


def rates(graphics: DataFrame, moves: DataFrame, edits: DataFrame, energies: DataFrame) -> DataFrame:
    """Accents and transitions a minute, and picture changes per 30 s, in tenths, against an edit's energy."""
    shown = graphics.groupBy("edit_id").agg(F.count("*").alias("n_graphics"))
    per = moves.groupBy("edit_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("punch_in", "shake", "effect", "transition")])
    df = edits.select("edit_id", "duration_us", "energy").join(F.broadcast(energies), "energy", "left").join(shown, "edit_id", "left").join(per, "edit_id", "left")
    df = df.fillna(0, ["n_graphics", "punch_in", "shake", "effect", "transition", "accents", "transitions", "changes"]).withColumn("d", F.greatest("duration_us", F.lit(1_000_000)))
    tenths = lambda n, us: F.expr(f"(({n}) * cast({us} as long) * 20 + d) div (2 * d)")
    accents, cuts, pictures = tenths("n_graphics + punch_in", 60_000_000), tenths("transition", 60_000_000), tenths("effect + shake + transition", 30_000_000)
    most = F.expr("(accents * 125 + 50) div 100")
    verdicts = F.array(
        told(F.lit(True), "accents per minute", accents <= most, accents, most), told(F.lit(True), "transitions per minute", cuts <= F.col("transitions"), cuts, F.col("transitions")),
        told(F.expr("effect + shake > 0"), "picture changes per 30 s", pictures <= F.col("changes") * 10, pictures, F.col("changes") * 10),
    )
    return df.select("edit_id", F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("at_us"), F.explode(F.array_compact(verdicts)).alias("_v")).select("edit_id", "ref", "at_us", "_v.*").select(*OUT)


def effect_rules(moves: DataFrame, cues: DataFrame, words: DataFrame, edits: DataFrame) -> DataFrame:
    """Effects at least 4 s after the one before, within 0.4 s of a sentence's end or a caption's start (words: w_end, stop), and no loud ones on a sensitive topic."""
    e = moves.where("kind = 'effect'").select("edit_id", "move_id", "start_us", "end_us", "loud")
    gap = F.col("start_us") - F.lag("end_us").over(Window.partitionBy("edit_id").orderBy("start_us", "move_id"))
    spaced = e.withColumn("measured", gap).where("measured is not null").select("edit_id", F.lit("spaced from the last effect").alias("rule"), F.col("move_id").alias("ref"), F.col("start_us").alias("at_us"), (F.col("measured") >= EFFECT_GAP).alias("passed"), "measured", F.lit(EFFECT_GAP).cast("long").alias("expected"))

    marks = words.where("stop").select("edit_id", F.col("w_end").alias("at_us")).unionByName(cues.select("edit_id", F.col("c_start").alias("at_us"))).distinct()
    marks = marks.join(e.select("edit_id").distinct(), "edit_id", "left_semi").select("edit_id", "at_us", F.lit(None).cast("string").alias("ref"))
    line = marks.unionByName(e.join(cues.select("edit_id").distinct(), "edit_id", "left_semi").select("edit_id", F.col("start_us").alias("at_us"), F.col("move_id").alias("ref")))
    mark = F.when(F.col("ref").isNull(), F.col("at_us"))
    order = Window.partitionBy("edit_id")
    before, after = F.max(mark).over(order.orderBy("at_us")), F.min(mark).over(order.orderBy(F.desc("at_us")))
    near = F.least(F.col("at_us") - F.col("_b"), F.col("_a") - F.col("at_us"))
    placed = line.withColumn("_b", before).withColumn("_a", after).where("ref is not null").withColumn("measured", near)
    bound = placed.select("edit_id", F.lit("on a sentence boundary").alias("rule"), "ref", "at_us", F.coalesce(F.col("measured") <= BOUNDARY, F.lit(False)).alias("passed"), "measured", F.lit(BOUNDARY).cast("long").alias("expected"))

    loud = e.where("loud").join(edits.where("sensitive").select("edit_id"), "edit_id", "left_semi")
    quiet = loud.select("edit_id", F.lit("loud on a sensitive topic").alias("rule"), F.col("move_id").alias("ref"), F.col("start_us").alias("at_us"), F.lit(False).alias("passed"), F.lit(1).cast("long").alias("measured"), F.lit(0).cast("long").alias("expected"))
    return spaced.unionByName(bound).unionByName(quiet)


def marked_words(words: DataFrame, listed: DataFrame, moves: DataFrame) -> DataFrame:
    """Each word whose key an edit lists (listed: edit_id, key), and whether a punch-in or shake starts at most 0.3 s after it begins, or still runs. words: (edit_id, idx, w_start, key)."""
    said = words.join(listed.select("edit_id", "key").distinct(), ["edit_id", "key"], "left_semi").select("edit_id", "idx", "w_start")
    m = moves.where("kind in ('punch_in', 'shake')").select("edit_id", (F.col("start_us") - WORD_SLACK).alias("m_start"), F.col("end_us").alias("m_end"))
    hit = range_join(said, m, ["edit_id"], ("w_start", "w_start"), ("m_start", "m_end"), F.col("w_start").between(F.col("m_start"), F.col("m_end"))).select("edit_id", "idx").distinct().withColumn("_hit", F.lit(True))
    one = F.lit(1).cast("long")
    passed = F.coalesce("_hit", F.lit(False))
    return said.join(hit, ["edit_id", "idx"], "left").select("edit_id", F.lit("word marked").alias("rule"), F.col("idx").cast("string").alias("ref"), F.col("w_start").alias("at_us"), passed.alias("passed"), passed.cast("long").alias("measured"), one.alias("expected"))


def motion_audit(graphics: DataFrame, cues: DataFrame, words: DataFrame, faces: DataFrame, moves: DataFrame, changes: DataFrame, listed: DataFrame, edits: DataFrame, energies: DataFrame) -> DataFrame:
    """(edit_id, rule, ref, at_us, passed, measured, expected): all rules about what moves on screen. ref is a graphic, a move or a word's index, null for rules about the edit.

    graphics, cues, words (also idx, key, stop), faces, edits (also duration_us, sensitive): see the functions above. moves: (edit_id, move_id, kind, start_us, end_us, loud) of the
    kinds punch_in, shake, effect and transition. changes: (edit_id, at_us) of cuts and of points that enter. energies: a row an energy (energy, accents and transitions in tenths a
    minute, changes per 30 s, stickers, icons), a fixed table of a few rows. Edits that aren't in edits have no verdicts about graphics and rates; an energy that isn't listed allows
    nothing. The verdicts about single graphics are written to the shared folder first. Rows without times are no graphics or moves. Empty tables give what the others allow.
    """
    timed = "start_us is not null and end_us is not null"
    g, m = graphics.where(timed), moves.where(timed)
    unseen = g.select("edit_id").distinct().join(faces.select("edit_id").distinct(), "edit_id", "left_anti")
    no_faces = unseen.select("edit_id", F.lit("faces measured").alias("rule"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("at_us"), F.lit(False).alias("passed"), F.lit(0).cast("long").alias("measured"), F.lit(1).cast("long").alias("expected"))
    both = F.explode(F.array("start_us", "end_us")).alias("at_us")
    cut = m.where("kind = 'transition'").select("edit_id", F.floor((F.col("start_us") + F.col("end_us")) / 2).alias("at_us"))
    points = [changes.select("edit_id", "at_us"), g.select("edit_id", both), m.where("kind in ('punch_in', 'effect')").select("edit_id", both), cut]
    still = longest_still(reduce(DataFrame.unionByName, points), edits, STILL_LIMIT).select("edit_id", F.lit("something changes").alias("rule"), F.lit(None).cast("string").alias("ref"), "at_us", "passed", "measured", F.lit(STILL_LIMIT).cast("long").alias("expected"))
    spans = words.select("edit_id", "w_start", "w_end")
    single = written(graphic_rules(g, cues, spans, faces, edits, energies), "graphic-rules")  # its plan is as large as that of all other rules
    parts = [
        single, no_faces, transition_rules(m, spans, faces), rates(g, m, edits, energies), still,
        effect_rules(m, cues, words, edits), marked_words(words, listed, m),
    ]
    return reduce(DataFrame.unionByName, [p.select(*OUT) for p in parts])
