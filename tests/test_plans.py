"""Choices by islands, long recordings, the shared folder, moves and plans in small cases."""

import random
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from tempora.operators import compiling, folds, moves, speech, staging


def greedy(rows):
    kept = []
    for r in sorted(rows, key=lambda r: r[1]):
        if all(r[3] <= k[2] or r[2] >= k[3] for k in kept):
            kept.append(r)
    return kept


@pytest.mark.parametrize("seed", range(3))
def test_choices_by_islands(spark, seed, monkeypatch):
    dice = random.Random(seed)
    rows = []
    for key in range(12):
        for n, nth in enumerate(dice.sample(range(40), 40)):
            a = dice.randrange(0, 4000 if key % 2 else 400)
            rows.append((key, nth, a, a + dice.choice([0, 1, 5, 30])))
    seen = []
    real = folds.fold
    monkeypatch.setattr(folds, "fold", lambda df, *a, **k: seen.append(df) or real(df, *a, **k))
    got = folds.choose_apart(spark.createDataFrame(rows, "k long, nth long, start_us long, end_us long"), ["k"], ["nth"])
    want = {r for key in range(12) for r in greedy([r for r in rows if r[0] == key])}
    assert {tuple(r) for r in got.collect()} == want
    assert seen[0].groupBy("fold_k0", "fold_island").count().where("count < 2").count() == 0 and seen[0].count() < len(rows)


def test_choices_of_an_empty_table(spark):
    none = spark.createDataFrame([], "k string, nth long, start_us long, end_us long")
    assert folds.choose_apart(none, ["k"], ["nth"]).count() == 0


def test_long_recordings_take_linear_time(spark):
    n = 32_000
    words = spark.range(n).select(
        F.lit(1).cast("long").alias("source_id"), F.col("id").alias("idx"), F.concat(F.lit("w"), (F.col("id") * 7919 % 1009).cast("string")).alias("word"), (F.col("id") * 300_000).alias("start_us"), (F.col("id") * 300_000 + 200_000).alias("end_us")
    )
    markers = spark.createDataFrame([("w1", "first"), ("w2", "then")], "key string, kind string")
    began = time.time()
    speech.find_loops(words).count()
    staging.sequences(words, spark.createDataFrame([(1, n * 300_000)], "source_id long, duration_us long"), markers, spark.createDataFrame([], "key string")).count()
    assert time.time() - began < 30  # frames to the end of a recording took over 100 s


def test_shared_folder_of_a_session_without_one(tmp_path):
    code = """
import os, sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from tempora.sources.shared import shared_dir, written
assert shared_dir(spark) == shared_dir(spark)
assert written(spark.range(3), "t").count() == 3
print("fine")
"""
    import os

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=repo, capture_output=True, text=True, timeout=120)
    assert "fine" in done.stdout, done.stderr[-1500:]


ITEM = "edit_id long, item_idx long, order_no long, action string, source_id long, start_us long, end_us long, audio_source long, audio_start long, audio_end long, speed_pct int, zoom_pct int, beat string"


@pytest.fixture
def spoken(spark):
    """Two recordings of ten words, a second each, 0.8 s long."""
    w = [(s, i, f"{'ab'[s]}{i}", i * 1_000_000 + 100_000, i * 1_000_000 + 900_000) for s in (0, 1) for i in range(10)]
    return spark.createDataFrame(w, "source_id long, idx long, word string, start_us long, end_us long"), spark.createDataFrame([(0, 10_000_000), (1, 10_000_000)], "source_id long, duration_us long")


def compiled(spark, spoken, items, cuts=()):
    c = spark.createDataFrame(list(cuts), "source_id long, cut_id string, cut_start long, cut_end long")
    ranges, refusals = compiling.compile_items(spark.createDataFrame(items, ITEM), c, *spoken)
    return sorted(map(tuple, ranges.collect())), sorted(map(tuple, refusals.collect()), key=repr)


def test_items_in_their_order_with_cuts_and_seams(spark, spoken):
    items = [
        (1, 0, 2, "keep", 0, 100_000, 1_900_000, None, None, None, 100, 100, "late"),
        (1, 1, 1, "tighten", 1, 4_100_000, 7_900_000, None, None, None, 100, 100, "early"),
        (1, 2, 3, "keep", 0, 2_100_000, 2_900_000, None, None, None, 100, 120, "next"),
        (1, 3, 0, "drop", 1, 0, 900_000, None, None, None, 100, 100, ""),
    ]
    cuts = [(1, "c1", 4_950_000, 5_950_000), (1, "c2", 5_900_000, 6_050_000), (0, "c3", 8_000_000, 9_000_000)]
    ranges, refusals = compiled(spark, spoken, items, cuts)
    assert refusals == []
    assert [(r[2], r[3], r[4], r[5], r[12], r[13], r[14]) for r in ranges] == [
        (1, 1, 4_020_000, 4_950_000, "b4", "", None),
        (1, 1, 6_050_000, 7_980_000, "b6 b7", "c1,c2", None),
        (0, 0, 20_000, 2_000_000, "a0 a1", "", None),
        (2, 0, 2_000_000, 2_980_000, "a2", "", "punch"),
    ]


def test_voices_under_other_pictures_and_refusals(spark, spoken):
    voice = (1, 4_100_000, 5_900_000)
    items = [
        (1, 0, None, "keep", 0, 0, 4_000_000, *voice, 100, 100, "ok"),
        (2, 0, None, "keep", 0, 0, 1_000_000, *voice, 100, 100, "short"),
        (3, 0, None, "keep", 7, 0, 1_000_000, None, None, None, 100, 100, "unknown"),
        (3, 1, None, "keep", 0, 100_000, 900_000, None, None, None, 100, 100, "fine, but the edit isn't"),
        (4, 0, None, "drop", 0, 0, 1_000_000, None, None, None, 100, 100, ""),
    ]
    ranges, refusals = compiled(spark, spoken, items)
    assert [r[:10] for r in ranges] == [(1, 0, 0, 0, 0, 1_960_000, 1, 4_020_000, 5_980_000, 100)] and ranges[0][12] == "b4 b5"
    assert refusals == [(2, 0, "voice_outlasts_picture", 1_960_000, 51), (3, 0, "no_transcript", None, None), (4, None, "nothing_left", None, None)]


def test_no_items(spark, spoken):
    assert compiled(spark, spoken, []) == ([], [])


MOVE = "edit_id long, move_id string, kind string, start_us long, end_us long, look string"


def test_accepted_moves_depend_on_their_order(spark):
    proposed = [
        (1, "t1", "transition", 1_000_000, 1_000_000, "cut"), (1, "z", "zoom", 1_020_000, 1_020_000, ""), (1, "t2", "transition", 1_010_000, 1_010_000, "cut"), (1, "h", "title", 0, 2_000_000, "hi"),
        (1, "e1", "effect", 1_500_000, 3_000_000, "glow"), (1, "e2", "effect", 2_500_000, 4_000_000, "glow"), (1, "p", "punch", 0, 1_000_000, ""),
    ]
    plan = [(1, "transition", 1_005_000, 1_005_000, "old"), (1, "punch", 900_000, 1_500_000, "")]

    def outcomes(order):
        chosen = spark.createDataFrame([(1, n, m) for n, m in enumerate(order)], "edit_id long, seq long, move_id string")
        log, after = moves.accept_moves(chosen, spark.createDataFrame(proposed, MOVE), spark.createDataFrame(plan, "edit_id long, kind string, start_us long, end_us long, look string"))
        return {r.move_id: r.outcome for r in log.collect()}, sorted((r.kind, r.start_us) for r in after.collect())

    log, after = outcomes(["t1", "z", "t2", "h", "e1", "e2", "p", "none", "t2"])
    assert log == {"t1": "present", "z": "accepted", "t2": "accepted", "h": "accepted", "e1": "under_title", "e2": "accepted", "p": "overlaps", "none": "unknown"}
    assert after == [("effect", 2_500_000), ("punch", 900_000), ("title", 0), ("transition", 1_010_000)]
    log, after = outcomes(["e1", "h", "e2", "t2", "z"])
    assert log == {"e1": "accepted", "h": "accepted", "e2": "overlaps", "t2": "present", "z": "accepted"}
    assert after == [("effect", 1_500_000), ("punch", 900_000), ("title", 0)]


def _seams(rows):
    """The rule gone through in order: (start, end, how) of ranges (start, end, speed, zoom, source)."""
    start, end, how = [r[0] for r in rows], [r[1] for r in rows], [None] * len(rows)
    for i in range(1, len(rows)):
        p, r = rows[i - 1], rows[i]
        seam = (end[i - 1] + start[i]) // 2
        if r[4] == p[4] and r[2] == p[2] == 100 and start[i] - end[i - 1] < 300_000 and start[i] > start[i - 1] and end[i] > end[i - 1] and seam - start[i - 1] >= 80_000 and end[i] - seam >= 80_000:
            end[i - 1] = start[i] = seam
            how[i] = "continuous" if r[3] == p[3] else "punch"
    return list(zip(start, end, how, strict=True))


def test_seams_follow_from_the_one_before_without_another_shuffle(spark):
    import random

    from tempora.operators.cuts import join_seams

    rng, edits = random.Random(5), {}
    for e in range(300):
        at, rows = rng.randrange(100_000), []
        for _ in range(rng.randrange(1, 12)):
            rows.append((at, at + rng.randrange(60_000, 260_000, 10_000), rng.choice([100] * 9 + [125]), rng.choice([100, 120]), rng.choice([0] * 9 + [1])))
            at += rng.randrange(20_000, 260_000, 10_000)
        edits[e] = rows
    table = spark.createDataFrame([(e, i, r[4], *r[:4]) for e, rows in edits.items() for i, r in enumerate(rows)], "edit_id long, range_idx long, source_id long, start_us long, end_us long, speed_pct int, zoom_pct int")
    out = join_seams(table.repartition("edit_id"))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.edit_id, r.range_idx)):
        got.setdefault(r.edit_id, []).append((r.start_us, r.end_us, r.transition_in))
    assert got == {e: _seams(rows) for e, rows in edits.items()}


def test_snapping_sorts_only_recordings_that_are_asked_for(spark):
    from tempora.operators.amends import snap_to_word

    w = spark.createDataFrame([(s, i * 1000, i * 1000 + 600) for s in range(3) for i in range(5)], "source_id long, start_us long, end_us long")
    out = snap_to_word(spark.createDataFrame([(1, 1100), (1, 1500), (7, 40)], "source_id long, at_us long"), w)
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [(1, 1100, 1000), (1, 1500, 1600), (7, 40, 40)]


def _accepted(chosen, proposed, plan):
    """The rule gone through in order, every move against all that is there: ({move_id: (seq, kind, outcome)}, plan) of an edit."""
    live, log, seqs = list(plan), {}, {}
    for seq, m in chosen:
        seqs[m] = min(seq, seqs.get(m, seq))
    for m in sorted(seqs, key=lambda m: (seqs[m], len(m), m)):
        if m not in proposed:
            log[m] = seqs[m], None, "unknown"
            continue
        kind, a, b, look = row = proposed[m]
        near = [x for x in live if x[0] == "transition" and abs(x[1] - a) < 50_000]
        over = lambda k: any(x[0] == k and x[1] < b and a < x[2] for x in live)  # noqa: B023, E731
        if kind in ("element", "title"):
            told = "present" if row in live else "accepted"
        elif kind == "transition":
            told = "present" if near else "accepted"
        elif kind == "zoom":
            told, live = "accepted", [x for x in live if x not in near]
        else:
            told = "overlaps" if over(kind) else "under_title" if kind == "effect" and over("title") else "accepted"
        if told == "accepted" and kind != "zoom":
            live.append(row)
        log[m] = seqs[m], kind, told
    return log, live


def test_moves_are_dealt_once(spark):
    dice = random.Random(7)
    kinds = ["element", "title", "punch", "transition", "effect", "zoom"]

    def some():
        kind, a = dice.choice(kinds), dice.randrange(0, 400_000, 5_000)
        return kind, a, a if kind in ("transition", "zoom") else a + dice.choice([0, 5_000, 60_000, 200_000]), dice.choice(["x", None])

    edits = {e: ([(dice.randrange(9), f"m-{dice.randrange(30)}") for _ in range(30)], {f"m-{n}": some() for n in range(25)}, [r for r in (some() for _ in range(6)) if r[0] != "zoom"]) for e in range(60)}
    rows = "edit_id long, {}kind string, start_us long, end_us long, look string"
    log, after = moves.accept_moves(
        spark.createDataFrame([(e, *c) for e, x in edits.items() for c in x[0]], "edit_id long, seq long, move_id string"),
        spark.createDataFrame([(e, m, *r) for e, x in edits.items() for m, r in x[1].items()], rows.format("move_id string, ")),
        spark.createDataFrame([(e, *r) for e, x in edits.items() for r in x[2]], rows.format("")),
    )
    told, plans = {e: {} for e in edits}, {e: [] for e in edits}
    for r in log.collect():
        assert r["move_id"] not in told[r["edit_id"]]
        told[r["edit_id"]][r["move_id"]] = r["seq"], r["kind"], r["outcome"]
    for e, *row in after.collect():
        plans[e].append(tuple(row))
    for e, x in edits.items():
        log_e, live = _accepted(*x)
        assert told[e] == log_e and sorted(plans[e], key=str) == sorted(live, key=str)
    assert {o for t in told.values() for *_, o in t.values()} == {"accepted", "present", "overlaps", "under_title", "unknown"}
    for df in (log, after):
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
        assert plan.count("Exchange") == 1 and "Join" not in plan and "FileScan" not in plan


def test_items_stay_with_their_edit(spark, spoken, monkeypatch):
    items = [(e, i, None if e % 2 else 9 - i, "keep", (e + i) % 2 if i < 4 or e % 5 else 7, 100_000 + i * 1_000_000, 1_900_000 + i * 1_000_000, None if i % 3 else 1, 100_000, 900_000, 100, 100, "") for e in range(20) for i in range(6)]
    cuts = [(1, "c1", 2_950_000, 3_050_000), (0, "c2", 5_900_000, 6_050_000)]
    got = compiled(spark, spoken, items, cuts)
    assert len(got[0]) > 60 and {r[2] for r in got[1]} == {"no_transcript"} and any(r[13] for r in got[0])
    c = spark.createDataFrame(cuts, "source_id long, cut_id string, cut_start long, cut_end long")
    plan = lambda: compiling.compile_items(spark.createDataFrame(items, ITEM), c, *spoken)[0]._jdf.queryExecution().executedPlan().toString()
    # light stretches come to the items, which go to their edit once; heavy ones are never broadcast
    assert plan().count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan()
    monkeypatch.setattr(compiling, "SENT_BYTES", 0)
    assert compiled(spark, spoken, items, cuts) == got
    assert "SortMergeJoin" in plan() and "Broadcast" not in plan()
    of = compiling.compile_refusals(spark.createDataFrame(items, ITEM), c, *spoken)
    assert sorted(map(tuple, of.collect()), key=repr) == got[1]
