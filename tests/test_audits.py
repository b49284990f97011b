"""Audits of graphics, openings and reels in small cases, and on empty tables."""

import random

import pytest

from tempora.operators import graphics as G
from tempora.operators import openings as O

GRAPHICS = "edit_id long, graphic_id string, kind string, film boolean, start_us long, end_us long, chars int, x0 long, y0 long, x1 long, y1 long"
CUES = "edit_id long, c_start long, c_end long"
WORDS = "edit_id long, idx long, w_start long, w_end long, key string, stop boolean"
FACES = "edit_id long, face_at long, fx0 long, fy0 long, fx1 long, fy1 long"
MOVES = "edit_id long, move_id string, kind string, start_us long, end_us long, loud boolean"
EDITS = "edit_id long, duration_us long, energy string, cps int, cap_y0 int, cap_y1 int, frame_x0 int, frame_y0 int, frame_x1 int, frame_y1 int, sensitive boolean"
ENERGIES = "energy string, accents int, transitions int, changes int, stickers int, icons int"


def audit(spark, graphics=(), cues=(), words=(), faces=(), moves=(), changes=(), listed=(), edits=((1, 60_000_000, "lively", 15, 700, 790, None, None, None, None, False),)):
    made = [spark.createDataFrame(list(rows), schema) for rows, schema in ((graphics, GRAPHICS), (cues, CUES), (words, WORDS), (faces, FACES), (moves, MOVES), (changes, "edit_id long, at_us long"), (listed, "edit_id long, key string"), (edits, EDITS))]
    energies = spark.createDataFrame([("lively", 120, 80, 4, 1, 2)], ENERGIES)
    return {(r.rule, r.ref): (r.passed, r.measured) for r in G.motion_audit(*made, energies).collect()}


def test_motion_of_empty_tables(spark):
    assert audit(spark, edits=()) == {}
    assert audit(spark) == {("accents per minute", None): (True, 0), ("transitions per minute", None): (True, 0), ("something changes", None): (False, 60_000_000)}


def test_nearest_picture_of_faces(spark):
    box = (100, 100, 300, 300)
    g = [(1, "a", "sticker", False, 0, 1_000_000, 0, *box), (1, "b", "sticker", False, 2_000_000, 3_000_000, 0, *box), (1, "none", "icon", False, None, 5, 0, *box)]
    # 0.3 s is nearer to the middle of a than 0.74 s; the picture nearest to the middle of b has no face
    faces = [(1, 300_000, 100, 100, 200, 300), (1, 740_000, 900, 900, 950, 950), (1, 2_480_000, None, None, None, None), (1, 2_700_000, *box)]
    got = audit(spark, g, faces=faces)
    assert got["clear of faces", "a"] == (False, 1_000_000) and got["clear of faces", "b"] == (True, 0)
    assert got["within the energy's limit", "a"] == (True, 1) and not any(ref == "none" for _, ref in got)


def test_insets_over_a_talking_mouth(spark):
    g = [(1, "i", "inset", False, 0, 4_000_000, 0, 0, 0, 1000, 1000)]
    faces = [(1, t, 400, 200, 600, 600) for t in range(0, 4_000_001, 500_000)]
    words = [(1, 0, 0, 2_000_001, "w", False)]
    assert audit(spark, g, words=words, faces=faces)["off a talking mouth", "i"] == (False, 2_250_000)  # 0, 0.25 ... 2.0 s
    assert audit(spark, g, words=[(1, 0, 0, 2_000_000, "w", False)], faces=faces)["off a talking mouth", "i"] == (True, 2_000_000)
    aside = [(1, "i", "inset", False, 0, 4_000_000, 0, 0, 0, 1000, 440)]  # the mouth begins at 440
    assert audit(spark, aside, words=words, faces=faces)["off a talking mouth", "i"] == (True, 0)


def test_effects_transitions_and_words(spark):
    moves = [(1, "e1", "effect", 1_000_000, 2_000_000, True), (1, "e2", "effect", 5_999_999, 6_500_000, False), (1, "t", "transition", 3_000_000, 3_400_000, False), (1, "p", "punch_in", 8_300_000, 8_400_000, False)]
    words = [(1, 0, 600_000, 1_300_000, "go", True), (1, 1, 3_100_000, 3_200_000, "x", False), (1, 2, 8_000_000, 8_100_000, "go", False)]
    edit = [(1, 60_000_000, "lively", 15, 700, 790, None, None, None, None, True)]
    got = audit(spark, moves=moves, words=words, cues=[(1, 5_500_000, 5_800_000)], listed=[(1, "go")], edits=edit)
    assert got["spaced from the last effect", "e2"] == (False, 3_999_999)
    assert got["on a sentence boundary", "e1"] == (True, 300_000) and got["on a sentence boundary", "e2"] == (False, 499_999)
    assert got["transition clear of speech", "t"] == (False, 100_000)  # nobody looked for faces
    assert got["loud on a sensitive topic", "e1"] == (False, 1) and ("loud on a sensitive topic", "e2") not in got
    assert got["word marked", "0"] == (False, 0) and got["word marked", "2"] == (True, 1)
    assert got["picture changes per 30 s", None] == (True, 15)
    none = [(1, 3_200_000, None, None, None, None)]
    assert ("transition clear of speech", "t") not in audit(spark, moves=moves, words=words, faces=none)


def chain(cards, total):
    ending, kept = total, set()
    for key, start, end in sorted(cards, key=lambda c: (-c[2], c[0])):
        if end >= ending - 100_000:
            kept.add(key)
            ending = min(ending, start)
    return kept


@pytest.mark.parametrize("seed", range(2))
def test_end_cards_from_the_end_backwards(spark, seed):
    dice, rows, edits = random.Random(seed), [], []
    for edit in range(60):
        total = 10_000_000
        edits.append((edit, total))
        for n in range(dice.randint(0, 6)):
            end = total - dice.choice([0, 0, 99_999, 100_000, 100_001, 1_000_000, 2_000_000, 2_100_000])
            rows.append((edit, f"c{n}", "end_card", end - dice.choice([900_000, 1_000_000, 2_000_000]), end))
    got = O.end_card_chain(spark.createDataFrame(rows, "edit_id long, element_id string, kind string, start_us long, end_us long"), spark.createDataFrame(edits, "edit_id long, duration_us long"))
    kept = {(r.edit_id, r.element_id) for r in got.where("at_end").collect()}
    assert kept == {(e, k) for e, total in edits for k in chain([(r[1], r[3], r[4]) for r in rows if r[0] == e], total)} and got.count() == len(rows)


def opening(spark, edits, elements=(), overlays=(), ranges=(), cues=(), words=(), pictures=(), silences=()):
    schemas = (
        "edit_id long, duration_us long, policy string, silence_limit_us long, brief string", "edit_id long, element_id string, kind string, start_us long, end_us long",
        "edit_id long, overlay_id string, kind string, card string, file string, codec string, start_us long, end_us long", "edit_id long, range_idx long, file string, codec string, fill string",
        "edit_id long, cue_idx long, c_start long, text string", "edit_id long, w_start long", "edit_id long, mean int, detail int, change int", "edit_id long, s_start long, s_end long",
    )
    made = [spark.createDataFrame(list(rows), s) for rows, s in zip((edits, elements, overlays, ranges, cues, words, pictures, silences), schemas, strict=True)]
    return {(r.rule, r.edit_id): (r.passed, r.measured, r.ref) for r in O.opening_audit(*made).collect()}


def test_openings(spark):
    assert opening(spark, []) == {}
    edits = [(1, 9_000_000, "content_first", 300_000, "Come in, come"), (2, 9_000_000, "content_first", 300_000, None), (3, 9_000_000, None, 300_000, "other")]
    got = opening(spark, edits, cues=[(1, 0, 0, "come IN now"), (3, 0, 40_001, "come in")], words=[(1, 500_000)], pictures=[(1, 1000, 200, 5), (3, 199, 200, 5)], silences=[(1, 20_001, 900_000), (3, 0, 300_001)])
    assert got["ready", 1][:2] == (True, 0) and got["brief's first line", 1] == (True, 2, None)
    assert got["first frame", 2] == (False, None, "no picture") and not got["first cue", 2][0] and ("brief's first line", 2) not in got and got["ready", 2][:2] == (False, 2)
    assert got["first frame", 3] == (False, 199, "black") and not got["first cue", 3][0] and not got["leading silence", 3][0] and not got["brief's first line", 3][0] and got["ready", 3][:2] == (True, 4)


def test_reels(spark):
    schemas = {
        "edits": "edit_id long, duration_us long, mode string, origin string", "cues": "edit_id long, cue_idx long, c_start long, c_end long, text string", "words": "edit_id long, cue_idx long, w_start long, w_end long",
        "silences": "edit_id long, s_start long, s_end long", "changes": "edit_id long, at_us long", "elements": "edit_id long, element_id string, kind string, start_us long, end_us long",
        "publish": "edit_id long, cta string, description string", "platforms": "platform string, best_min_us long, best_max_us long", "leaning": "key string",
    }

    def run(**rows):
        return {(r.rule, r.edit_id): (r.passed, r.measured) for r in O.reel_audit(*[spark.createDataFrame(rows.get(n, []), s) for n, s in schemas.items()]).collect()}

    assert run() == {}
    bare = run(edits=[(1, 5_000_000, None, None)])
    assert bare["situation heard at once", 1] == (False, None) and bare["captioned for sound off", 1] == (False, 0) and ("ends on the payoff", 1) not in bare and bare["the picture changes every few seconds", 1] == (True, 5_000_000)
    got = run(
        edits=[(1, 12_000_000, "phrase", "story")], cues=[(1, 0, 0, 5_000_000, "the whole first of"), (1, 1, 5_000_000, 9_000_000, "then the"), (1, 2, 9_000_000, 11_500_000, "Follow us?")],
        words=[(1, 0, 0, 4_000_000), (1, 1, 5_000_000, 7_500_001), (1, 2, 9_000_000, 11_500_000)], silences=[(1, 7_500_001, 8_300_000), (1, 0, 3_000_000)], changes=[(1, 4_000_000), (1, 8_999_999), (1, 20_000_000)],
        elements=[(1, "e", "end_card", 11_000_000, 12_000_000)], publish=[(1, None, "resend"), (1, "Zapisz to", None)], platforms=[("p", 1, 12_000_000)], leaning=[("of",), ("the",)],
    )
    assert got["phrase captions change often", 1] == (False, 2_500_001) and got["captions end on whole phrases", 1] == (False, 2)
    assert got["no dead air inside the speech", 1] == (False, 799_999) and got["ends on the payoff", 1] == (True, 500_000) and got["the picture changes every few seconds", 1] == (True, 4_999_999)
    assert got["the end says what next", 1][0] and got["the story ends on a question", 1][0] and got["asks for a save or a send", 1][0] and got["length suits", 1][0] and got["captioned for sound off", 1] == (True, 1000)
