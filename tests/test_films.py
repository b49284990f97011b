"""Audit of films in small cases, with nulls, repeated rows and empty tables."""

from tempora.operators import films as M

TABLES = {
    "films": "edit_id long, codec string, pixels string, rate int, nominal int, sound string, sample_rate int, channels int, video_us long, container_us long", "packets": "edit_id long, pos long, pts_us long, dur_us long",
    "samples": "edit_id long, at_us long, change int", "approved": "edit_id long, a_start long, a_end long", "black": "edit_id long, b_start long, b_end long", "cuts": "edit_id long, at_us long",
    "quiet": "edit_id long, q_start long, q_end long", "cues": "edit_id long, c_start long, c_end long",
}
FILM = ("h264", "yuv420p", 30000, 30000, "aac", 48000, 2, 20_000_000, 20_000_000)


def audit(spark, films=((1, *FILM),), **rows):
    made = [spark.createDataFrame(list(films) if n == "films" else rows.get(n, []), schema) for n, schema in TABLES.items()]
    return {(r.edit_id, r.check): (r.passed, r.measured) for r in M.film_audit(*made).collect()}


def sound(edit, n=939):
    return [(edit, i, i * 21_333, 21_333) for i in range(n)]


def test_empty_tables_and_null_facts(spark):
    assert audit(spark, films=()) == {}
    got = audit(spark, films=[(1, *[None] * 9), (1, *[None] * 9)])
    assert len(got) == 13 and {c for (_, c), (ok, _) in got.items() if not ok} == {"constant rate", "picture codec", "sound format", "packets rise", "packet step", "sound length", "captions present"}


def test_packets_spans_and_cues(spark):
    films = [(i, *FILM) for i in (1, 2)]
    got = audit(
        spark, films, packets=sound(1)[:-1] + [(1, 938, 938 * 21_333, None), (1, 940, None, 5)] + [(2, 0, 0, 5), (2, 1, 0, 5), (3, 0, 0, 5)],
        black=[(1, 0, 249_999), (1, 19_000_000, 19_900_000), (2, 50_000, 250_000), (2, 260_000, 270_000)] * 2, cuts=[(1, 1_000_000), (2, 1_000_000), (2, 1_000_000)], quiet=[(1, 1_150_001, 1_300_000), (2, 1_150_000, 1_300_000)],
        cues=[(1, 0, 500), (1, 500, 20_000_000), (1, 20_050_000, 20_060_000), (2, 0, 500), (2, 0, 500), (2, 20_050_001, 20_060_000)],
    )
    assert all(ok for (e, _), (ok, _) in got.items() if e == 1) and got[1, "packet step"] == (True, 21_333)
    bad = {c: m for (e, c), (ok, m) in got.items() if e == 2 and not ok}
    assert bad == {"packets rise": 2, "packet step": 0, "sound length": 5, "no black inside": 2, "opens on an image": 250_000, "cuts carry sound": 1, "captions apart": 1, "captions inside": 1}


def test_still_endings(spark):
    step = 250_000
    at = lambda edit, first, still: [(edit, first + i * step, 0 if i in still else 51) for i in range((20_000_000 - first) // step)]
    samples = at(1, 0, range(8, 41)) + at(2, 10_000_000, {*range(4, 9), *range(20, 25)}) + at(3, 10_000_000, range(35, 40)) + at(4, 10_000_000, range(35, 40)) + at(5, 10_000_000, range(3, 7))
    got = audit(spark, [(i, *FILM) for i in range(1, 6)], samples=samples, approved=[(4, 18_800_000, 19_700_000), (3, 19_200_000, 20_000_000), (2, 11_000_000, 12_000_000)])
    hold = {e: m for (e, c), m in got.items() if c == "ending moves"}
    # 1: the run began before the last ten seconds, of which it has one sample; 2: the first of two equal runs is approved; 3: from 18.5 s to the film's end, approved from 19.2 s only; 4: the same, approved within 0.3 s on both sides
    assert hold == {1: (True, 0), 2: (True, 0), 3: (False, 1_500_000), 4: (True, 0), 5: (True, 1_000_000)}


def test_holds_and_approval(spark):
    film = spark.createDataFrame([(1, 20_000_000)], "edit_id long, container_us long")
    rows = [(1, 10_000_000 + i * 250_000, 50 if 4 <= i <= 8 or 35 <= i else 51) for i in range(40)] + [(1, 9_000_000, 0), (1, None, 0)]
    found = M.longest_hold(spark.createDataFrame(rows, "edit_id long, at_us long, change int"), film)
    # runs of five steps each: the first one holds, though the second reaches the end of the film and lasts longer
    assert [tuple(r) for r in found.collect()] == [(1, 10_750_000, 12_000_000)]
    spans = lambda *s: spark.createDataFrame([(1, *x) for x in s], "edit_id long, a_start long, a_end long")
    assert M.unapproved(found, spans((11_050_001, 12_000_000), (10_000_000, 11_699_999))).count() == 1
    assert M.unapproved(found, spans((11_050_000, 11_700_000))).count() == 0
