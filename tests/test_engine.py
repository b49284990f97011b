"""The engine's queries against their oracles at the smallest size, folds against plain Python, and invariants."""

import glob
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tempora import plans
from tempora.fixtures import recordings, words
from tempora.operators import cuts as C
from tempora.operators import intervals as I
from tempora.operators import speech as P
from tempora.operators import timeline as T

NAMES = sorted(plans.ORACLES)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def told(v):
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(columns), sorted(tuple(told(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, sf, duck, name):
    df = plans.QUERIES[name](spark, sf)
    rel = duck.sql(plans.ORACLES[name])
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(rel.fetchall(), rel.columns)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() >= 0


def speech(spark, seed, n=120, vocabulary="a b c er um the".split()):
    rnd, rows = random.Random(seed), []
    for source in range(3):
        at = 0
        for i in range(n):
            at += rnd.choice([0, 20_000, 200_000, 700_000, 1_000_000])
            end = at + rnd.randint(100_000, 600_000)
            rows.append((source, i, rnd.choice(vocabulary), rnd.choice(["u", "v"]), 0, at, end, 50))
            at = end
    return rows, spark.createDataFrame(rows, "source_id long, idx long, word string, speaker string, turn long, start_us long, end_us long, confidence_pct int")


def by_source(rows):
    return [[r for r in rows if r[0] == s] for s in range(3)]


@pytest.mark.parametrize("seed", range(3))
def test_loops(spark, seed):
    rows, df = speech(spark, seed, vocabulary=["a", "b"])
    want = set()
    for own in by_source(rows):
        keys, at = [r[2] for r in own], 0
        while at < len(keys):
            step = 1
            for size in range(1, 5):
                phrase, n = keys[at : at + size], 1
                if len(phrase) < size:
                    break
                while keys[at + n * size : at + (n + 1) * size] == phrase:
                    n += 1
                if n >= 4:
                    want.add((own[0][0], own[at][1], own[at][5], size, n))
                    step = size * n
                    break
            at += step
    assert {tuple(r) for r in P.find_loops(df).collect()} == want and want


@pytest.mark.parametrize("seed", range(3))
def test_false_starts(spark, seed):
    rows, df = speech(spark, seed, vocabulary=["a", "b", "c"])
    want = set()
    for own in by_source(rows):
        keys, at = [r[2] for r in own], 0
        while at < len(keys):
            for n in range(5, 1, -1):
                if len(keys) >= at + 2 * n and keys[at : at + n] == keys[at + n : at + 2 * n]:
                    want.add((own[0][0], "high" if n >= 3 else "medium", own[at][5], max(own[at + n - 1][6], own[at + n][5] - 50_000)))
                    at += n
                    break
            else:
                at += 1
    assert {(r[0], r[2], r[3], r[4]) for r in C.false_starts(df).collect()} == want and want


def test_candidates_never_overlap(spark, sf):
    w = words(spark, sf)
    lex = spark.createDataFrame([("the", False), ("la", True)], "key string, ambiguous boolean")
    found = C.find_cut_candidates([C.false_starts(w), C.stutters(w, lex, lex), C.fillers(w, lex), C.pause_cuts(w, recordings(w))]).collect()
    for a in found:
        assert all(a["source_id"] != b["source_id"] or a["cut_id"] == b["cut_id"] or a["end_us"] <= b["start_us"] or b["end_us"] <= a["start_us"] for b in found)


def test_phrases_partition_the_words(spark, sf):
    w = words(spark, sf)
    assert P.group_phrases(w).agg(F.sum("n_words")).first()[0] == w.count()
    assert P.group_phrases(w).agg(F.max("n_words")).first()[0] <= 28


@pytest.mark.parametrize("seed", range(4))
def test_subtract_matches_the_loop(spark, seed):
    rnd = random.Random(seed)
    ranges = [(e, i, e % 2, s := rnd.randrange(0, 900), s + rnd.randrange(1, 400)) for e in range(6) for i in range(4)]
    cuts = sorted((k % 2, f"c{k}", s := rnd.randrange(0, 1300), s + rnd.randrange(1, 120)) for k in range(20))
    want = set()
    for e, i, source, start, end in ranges:
        cursor, pending, piece = start, [], 0
        for _, cid, a, b in sorted((c for c in cuts if c[0] == source), key=lambda c: (c[2], c[3], c[1])):
            if b <= start or a >= end:
                continue
            if a > cursor:
                want.add((e, i, piece, cursor, a, ",".join(pending)))
                piece, pending = piece + 1, []
            pending.append(cid)
            cursor = max(cursor, b)
        if cursor < end:
            want.add((e, i, piece, cursor, end, ",".join(pending)))
    r = spark.createDataFrame(ranges, "edit_id long, range_idx long, source_id long, start_us long, end_us long")
    c = spark.createDataFrame(cuts, "source_id long, cut_id string, cut_start long, cut_end long")
    got = I.subtract(r, c, "source_id", ["edit_id", "range_idx"])
    assert {(x.edit_id, x.range_idx, x.piece, x.start_us, x.end_us, ",".join(x.cut_ids)) for x in got.collect()} == want


def test_range_join_gives_each_pair_once(spark):
    rnd = random.Random(1)
    a = [(k % 2, k, s := rnd.randrange(0, 5000), s + rnd.randrange(0, 900)) for k in range(40)]
    b = [(k % 2, k, s := rnd.randrange(0, 5000), s + rnd.randrange(0, 900)) for k in range(40)]
    want = sorted((x[1], y[1], max(x[2], y[2]), min(x[3], y[3])) for x in a for y in b if x[0] == y[0] and max(x[2], y[2]) < min(x[3], y[3]))
    left = spark.createDataFrame(a, "k int, a int, a0 long, a1 long")
    right = spark.createDataFrame(b, "k int, b int, b0 long, b1 long")
    got = I.overlap_join(left, right, ["k"], ("a0", "a1"), ("b0", "b1"), 100).select("a", "b", "lo_us", "hi_us")
    assert sorted(tuple(r) for r in got.collect()) == want


def test_frames_sum_to_the_rounded_end(spark):
    rnd = random.Random(2)
    rows = [(e, i, rnd.choice([1, 5_000, 20_000, 500_000])) for e in range(5) for i in range(30)]
    got = C.allocate_frames(spark.createDataFrame(rows, "edit_id long, range_idx long, duration_us long")).collect()
    for e in range(5):
        bound, cursor = 0, 0
        for _, i, d in (r for r in rows if r[0] == e):
            cursor += d
            now = max(bound + 1, round(cursor * 30 / 1e6))
            assert next(r["frames"] for r in got if (r["edit_id"], r["range_idx"]) == (e, i)) == now - bound
            bound = now


def test_cues_cover_every_word_once(spark, sf):
    w = words(spark, sf).select(F.col("source_id").alias("edit_id"), "idx", "word", "speaker", F.col("start_us").alias("out_start"), F.col("end_us").alias("out_end"))
    cues = T.build_cues(w)
    assert cues.agg(F.sum("n_words")).first()[0] == w.count() and cues.agg(F.max("n_words")).first()[0] <= 4
    assert T.overlapping_cues(T.deoverlap(cues)).count() <= T.overlapping_cues(cues).count()


def test_streams_equal_batches(spark, sf):
    q = plans.QUERIES
    for stream, batch in (("stream_phrases", "group_phrases"),):
        assert sorted(map(str, q[stream](spark, sf).collect())) == sorted(map(str, q[batch](spark, sf).select(*q[stream](spark, sf).columns).collect()))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_a_session_and_without_the_llm_part(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("tempora", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(f"{root}/{name}") else shutil.copy)(f"{root}/{name}", tmp_path / name)
    listed = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    assert subprocess.run([sys.executable, "-c", listed], cwd=root).returncode == 0
    shutil.rmtree(tmp_path / "tempora" / "llm", ignore_errors=True)
    out = subprocess.run([sys.executable, "-c", listed], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0 and int(out.stdout.split()[0]) == len(plans.QUERIES)


def tracks_by_hand(faces):
    """Sample by sample over whole tracks: the most recent first, each takes its nearest free face."""
    out, tracks = {}, []
    for t in sorted({f[0] for f in faces}):
        free = [f for f in faces if f[0] == t]
        for n, path in sorted(enumerate(tracks), key=lambda p: (-p[1][-1][0], p[0])):
            last = path[-1]
            dist = {f: ((f[2] - last[2]) ** 2 + (f[3] - last[3]) ** 2) ** 0.5 for f in free}
            near = [f for f in free if dist[f] <= 1.2 * max(1, last[4])]
            if near and t - last[0] <= 3:
                best = min(near, key=lambda f: (dist[f], f[1]))
                path.append(best)
                free.remove(best)
                out[best[:2]] = n
        for f in free:
            out[f[:2]] = len(tracks)
            tracks.append([f])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_tracks_match_a_plain_loop(spark, seed):
    from tempora.operators.framing import track_faces

    rnd = random.Random(seed)
    faces = [(t, k, rnd.randint(0, 400), rnd.randint(0, 60), rnd.randint(20, 90)) for t in range(40) if rnd.random() < 0.8 for k in range(rnd.randint(1, 4))]
    df = spark.createDataFrame([(7, *f) for f in faces], "source_id long, sample_idx long, face_idx long, x long, y long, w long")
    got = {(r["sample_idx"], r["face_idx"]): r["track_id"] for r in track_faces(df).collect()}
    assert got == tracks_by_hand(faces)


@pytest.mark.parametrize("seed", range(3))
def test_cues_match_a_search(spark, seed):
    """Each cue is as long as the rules allow: found by trying every end from its first word on."""
    rnd = random.Random(seed)
    words_, at = [], 0
    for n in range(150):
        at += rnd.choice([0, 50_000, 400_000, -10_000]) if n else 0
        text = rnd.choice(["a", "the", "of", "boats", "and", "mountains"]) + rnd.choice(["", "", "", ",", ".", "?"])
        words_.append((at, at + rnd.randint(90_000, 300_000), text, rnd.choice(["u", "u", "u", "v"])))
        at = words_[-1][1]
    rows = [(1, n, w, who, a, b) for n, (a, b, w, who) in enumerate(sorted(words_, key=lambda x: x[0]))]
    df = spark.createDataFrame(rows, "edit_id long, idx long, word string, speaker string, out_start long, out_end long")
    got = sorted((r["cue_idx"], r["start_us"], r["text"]) for r in T.build_cues(df, leaning=frozenset(["the", "of"])).collect())

    def barred(k):
        """No cue holds words k and k + 1."""
        (_, _, w, who, _, b), (_, _, _, who2, a2, _) = rows[k], rows[k + 1]
        return a2 < b or a2 - b > 350_000 or who != who2 or w[-1] in ".?"

    want, first = [], 0
    while first < len(rows):
        end, limit = first + 1, False
        while end < len(rows) and not barred(end - 1) and not (rows[end - 1][2].endswith(",") and end - first >= 2):
            if end - first >= 4 or len(" ".join(r[2] for r in rows[first : end + 1])) > 24:
                limit = True
                break
            end += 1
        moved = 0
        while limit and moved < 2 and end - moved - first > 1 and rows[end - moved - 1][2] in ("the", "of"):
            moved += 1
        end -= moved
        want.append((len(want), rows[first][4], " ".join(r[2] for r in rows[first:end])))
        first = end
    assert got == want


def test_story_lines(spark):
    from tempora.sources.tables import parse_story_rows

    lines = ['"One  two" -> a.mp4 @ 2.5 1,4 s', "plain → b.mp4", "x -> y -> c @3", "\u201ehe said\u201d -> d 2s", "no arrow", " -> e", "f ->", "g -> h @", "i -> j @ 1 2", "k -> l 1 s s"]
    got = [tuple(r)[1:] for r in parse_story_rows(spark.createDataFrame([(1, "\n".join(lines))], "k long, text string"), "k").orderBy("line_no").collect()]
    assert got == [(0, "One two", "a.mp4", 2500, 1400), (1, "plain", "b.mp4", 0, None), (2, "x -> y", "c", 3000, None), (3, "he said", "d", 0, 2000)]


def greedy_pairs(motion, turns_):
    import numpy as np

    r = {}
    for label in {t[2] for t in turns_}:
        for track in {m[0] for m in motion}:
            own = [(m[2], float(any(a <= m[1] < b for a, b, x in turns_ if x == label))) for m in motion if m[0] == track]
            if len(own) >= 4 and len({v for _, v in own}) > 1:
                r[label, track] = round(float(np.corrcoef(*zip(*own))[0, 1]), 9)
    out = {}
    for (label, track), v in sorted(r.items(), key=lambda x: (-x[1], x[0])):
        if v >= 0.15 and label not in out and track not in out.values():
            out[label] = track
    return out


def test_speakers_match_a_plain_choice(spark):
    from tempora.operators.framing import assign_speakers

    rnd = random.Random(1)
    turns_ = [(k * 1_000_000, (k + 1) * 1_000_000, rnd.choice("ABC")) for k in range(20)]
    who = {t[0] // 1_000_000: t[2] for t in turns_}
    motion = [(t, at, rnd.random() + ("ABC".index(who[at // 1_000_000]) == t)) for t in range(4) for at in range(0, 20_000_000, 250_000)]
    m = spark.createDataFrame([(1, *x) for x in motion], "source_id long, track_id int, at_us long, motion double")
    t = spark.createDataFrame([(1, *x) for x in turns_], "source_id long, start_us long, end_us long, label string")
    assert {r["label"]: r["track_id"] for r in assign_speakers(m, t).collect()} == greedy_pairs(motion, turns_)


@pytest.mark.parametrize("seed", range(3))
def test_fixes_carried_match_a_plain_loop(spark, seed):
    """Several fixes an edit, each on what the ones before it left."""
    from tempora.operators.amends import carry_fixes

    rnd = random.Random(seed)
    cues = [(1, n, n * 2_000_000, n * 2_000_000 + 1_500_000, [(rnd.choice("Abcd") + rnd.choice(["", ","]), n * 2_000_000 + k * 300_000, n * 2_000_000 + k * 300_000 + 200_000) for k in range(4)]) for n in range(6)]
    fixes = [(1, k, rnd.randrange(0, 15_000_000, 250_000), " ".join(rnd.choice("abcdz") for _ in range(rnd.randint(1, 2))), rnd.choice(["x", "y z", "b"])) for k in range(25)]
    track, states = {c[1]: [w[0] for w in c[4]] for c in cues}, []

    def find(n, want):
        for low in (False, True):
            have = [t.strip(",").lower() if low else t for t in track[n]]
            for k in range(len(have) - len(want) + 1):
                if have[k : k + len(want)] == want:
                    return k

    for _, _, at, old, new in fixes:
        old, new = old.split(), new.split()
        away = {n: max(c[2] - at, at - c[3], 0) for n, c in enumerate(cues)}
        near = [n for n in sorted(away, key=lambda n: (away[n], n))[:1] if away[n] <= 1_000_000 and find(n, old) is not None]
        says = [n for n in track if find(n, old) is not None]
        go = near or (says if len(says) == 1 else [])
        if go and len(track[go[0]]) - len(old) + len(new) > 0:
            k = find(go[0], old)
            track[go[0]][k : k + len(old)] = new
            states.append("applied" if near else "moved")
        else:
            states.append("done" if any(find(n, new) is not None for n in track) else "lost")
    c = spark.createDataFrame(cues, "edit_id long, cue_idx long, start_us long, end_us long, words array<struct<text:string,start_us:long,end_us:long>>")
    f = spark.createDataFrame(fixes, "edit_id long, fix_id long, at_us long, old string, new string")
    out = carry_fixes(c, f).collect()
    assert [r["text"] for r in sorted((r for r in out if r["kind"] == "fix"), key=lambda r: r["n"])] == states
    got = sorted((r["n"], r["pos"], r["text"]) for r in out if r["kind"] == "word")
    assert got == [(n, k, t) for n in sorted(track) for k, t in enumerate(track[n])]


def test_labels_land_on_their_scenes(spark):
    from tempora.operators.staging import pin_labels

    line = spark.createDataFrame([(1, k, b, s * 1000, e * 1000) for k, (b, s, e) in enumerate([("Intro", 0, 3000), ("Body", 3000, 7000), ("body ", 7000, 9000), ("End", 9000, 12_000)])], "edit_id long, range_idx long, beat string, output_start long, output_end long")
    rows = [("INTRO", 200, 2500), ("Body", 2600, 5000), ("body", 5100, 8000), ("Other", 8100, 20_000), ("Far", 9000, 9100)]
    labels = spark.createDataFrame([(1, k, t, a * 1000, b * 1000) for k, (t, a, b) in enumerate(rows)], "edit_id long, label_idx long, text string, start_us long, end_us long")
    got = [(r["label_idx"], r["start_us"] // 1000, r["end_us"] // 1000, r["n_joined"], r["problem"]) for r in pin_labels(labels, line).orderBy("start_us", "end_us").collect()]
    assert got == [(0, 0, 3000, 0, None), (1, 3000, 9000, 1, None), (4, 9000, 9100, 0, "shares its scene with the next"), (3, 9000, 12_000, 0, None)]


def test_a_word_takes_its_first_free_prop(spark):
    from tempora.operators.staging import props

    w = spark.createDataFrame([(1, k, t, "u", k * 1_000_000 + 500_000, k * 1_000_000 + 900_000) for k, t in enumerate("lamp lamps, Lamp table lamp".split())], "source_id long, idx long, word string, speaker string, start_us long, end_us long")
    lib = spark.createDataFrame([(7, 0, "lamp"), (8, 1, "Lamps"), (9, 2, "table"), (10, 3, "ta")], "prop_id long, ord int, keyword string")
    rec = spark.createDataFrame([(1, 20_000_000)], "source_id long, duration_us long")
    got = sorted((r["idx"], r["prop_id"], r["exact"]) for r in props(w, rec, lib).collect())
    assert got == [(0, 7, True), (1, 8, True), (3, 9, True)]


@pytest.mark.parametrize("seed", range(3))
def test_voice_matches_a_plain_mask(spark, seed):
    import numpy as np

    from tempora.operators.acoustics import voiced

    rnd = random.Random(seed)
    level, at = [], -600
    for _ in range(900):
        at = rnd.choice([-600, -250, -480]) if rnd.random() < 0.15 else at
        level.append(at + rnd.randint(-30, 30))
    frames = spark.createDataFrame([(1, n, v) for n, v in enumerate(level)], "source_id long, frame_no long, level_db10 long")
    spans = [(k, lo, lo + rnd.randint(200_000, 3_000_000)) for k, lo in enumerate(rnd.randrange(0, 8_000_000, 10_000) for _ in range(12))]
    windows = spark.createDataFrame([(k, 1, a, b) for k, a, b in spans], "k long, source_id long, w_lo long, w_hi long")
    want = set()
    for k, a, b in spans:
        first = a // 10_000
        own = np.array(level[first : min(b // 10_000, 900)], dtype=float)
        low, peak = np.percentile(own, 10), np.percentile(own, 95)
        loud = [peak - low >= 100 and v > low + max(80, (peak - low) / 5) for v in own]
        n = 0
        while n < len(loud):
            end = n
            while end < len(loud) and loud[end]:
                end += 1
            if end - n >= 3:
                want |= {(k, first + j, first + end) for j in range(n, end)}
            n = max(end, n + 1)
    assert {tuple(r) for r in voiced(windows, frames, ["k"]).collect()} == want


def test_amends_of_empty_tables_and_nulls(spark):
    from tempora.operators import amends as M

    w = spark.createDataFrame([(1, 0, "One", 0, 100_000), (1, 1, None, 200_000, 300_000)], "source_id long, idx long, word string, start_us long, end_us long")
    at = spark.createDataFrame([(1, 140_000), (2, 5)], "source_id long, at_us long")
    assert sorted(tuple(r) for r in M.snap_to_word(at, w).collect()) == [(1, 140_000, 100_000), (2, 5, 5)]
    assert M.snap_to_word(at, w.limit(0)).where("at_us <> to_us").count() == 0
    spans = spark.createDataFrame([], "source_id long, lo_us long, hi_us long")
    passages = spark.createDataFrame([], "source_id long, pos long, word string, start_us long, end_us long")
    assert [r["word"] for r in M.splice_refined(w, passages, spans).orderBy("idx").collect()] == ["One", None]
    cues = spark.createDataFrame([(1, 0, None), (1, 1, ""), (1, 2, "a b")], "edit_id long, cue_idx long, text string")
    assert [r["size_px"] for r in M.fit_check(cues, 40, 500, 2).orderBy("cue_idx").collect()] == [None, None, 40]
