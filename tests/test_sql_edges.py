"""Queries against their SQL on small tables made of the values that once told them apart."""

import datetime as dt

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import __spark_entry__ as driver


def both(spark, tmp_path, name, **tables):
    """Rows of a query and of its SQL over the given tables, sorted."""
    con = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(rows, f"{tmp_path}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    df = driver.queries()[name](spark, str(tmp_path))
    want = con.execute(driver.oracle_sql()[name])
    order = [d[0] for d in want.description]
    return sorted((tuple(r) for r in df.select(*order).collect()), key=str), sorted(want.fetchall(), key=str)


def vectors(values):
    return pa.table({"vec_id": pa.array(range(len(values)), pa.int64()), "embedding": pa.array(values, pa.list_(pa.float32())), "label": pa.array([3] * len(values), pa.int32())})


def turning(by, n):
    """Components whose product with `by` is on the other side of a whole number in doubles."""
    k = np.arange(1, 60000)
    x = np.concatenate([np.nextafter((k % 997 / by).astype(np.float32), np.float32(s), dtype=np.float32) for s in (0, 1)])
    x = x[np.floor(x * np.float32(by)) != np.floor(x.astype(float) * by)]
    assert len(x) > 0
    return [float(v) for v in np.resize(x, n)]


def test_components_are_scaled_as_floats(spark, tmp_path):
    dice = np.random.default_rng(5)
    for n, (name, by) in enumerate([("mouth_motion", 1000), ("speech_mask", 1000), ("crop_path", 100)]):
        rows = [[float(v) for v in dice.random(64, np.float32)] for _ in range(40)]
        odd = turning(by, 40)
        rows = [[a] * 16 + r[16:] if i % 2 else r for i, (r, a) in enumerate(zip(rows, odd))]
        folder = tmp_path / str(n)
        folder.mkdir()
        got, want = both(spark, folder, name, embeddings=vectors(rows))
        assert got == want and len(got) >= 30


def test_positions_are_rounded_once(spark):
    from tempora.functions.scalars import rounded
    from tempora.operators import project

    # 1.2344999996 is 1.234, but 1.2345 and then 1.235 by way of six places
    df = spark.createDataFrame([(1, 1, 1.2344999996), (2, 1, -1.2344999996)], "series long, step long, x double")
    got = project.crop_path(df).withColumn("x", rounded(F.col("x"), 3)).orderBy("series")
    assert [r["x"] for r in got.collect()] == [1.234, -1.234]


def test_a_sharp_s_in_capitals(spark, tmp_path):
    text = ["Ein Gruß an alle. Mehr.", "Ein Gruß an alle. Mehr.", "Ein Gruß an alle. Mehr."]
    b = pa.table({"item_id": pa.array([3, 4, 5], pa.int64()), "text": text})
    got, want = both(spark, tmp_path, "variant_lines", benchmark=b)
    assert got == want and (3, 1, "EIN GRUẞ AN ALLE.") in got and len(got) == 4


def test_capitals_of_two_letters_are_one_line(spark):
    from tempora.operators import drafts

    rows = spark.createDataFrame([(1, 0, ["EIN GRUSS."], "Ein Gruß.")], "brief_id long, row_idx int, on_screen array<string>, said string")
    assert [tuple(r) for r in drafts.variant_lines(rows).collect()] == [(1, 1, "EIN GRUSS.")]


def test_events_of_a_days_last_half_second(spark, tmp_path):
    at = [dt.datetime(2024, 1, 1, 12), dt.datetime(2024, 1, 1, 23, 59, 59, 400_000), dt.datetime(2024, 1, 1, 23, 59, 59, 500_000), dt.datetime(2024, 1, 1, 23, 59, 59, 700_000), dt.datetime(2024, 1, 2, 0, 0, 1)]
    e = pa.table({"event_id": pa.array(range(5), pa.int64()), "ts": pa.array(at, pa.timestamp("us")), "user_id": pa.array([1] * 5, pa.int64()), "event_type": ["view"] * 5, "value": [10.0, 50.0, 10.0, 50.0, 39.0], "props": ["{}"] * 5})
    got, want = both(spark, tmp_path, "stream_qa_rollup", events=e)
    assert got == want == [(19723, "view", 2, 1), (19724, "view", 3, 1)]


def test_moves_of_one_place_in_turn(spark):
    from tempora.operators import moves

    # m-2 and m-13 have the same seq, as have a title and the effect under it; the names decide, whatever the order of the rows
    chosen = [(1, 4, "m-13"), (1, 4, "m-2"), (2, 7, "m-12"), (2, 7, "m-1"), (3, 5, "m-15"), (3, 5, "m-4")]
    proposed = [(1, "m-13", "punch", 0, 90, None), (1, "m-2", "punch", 50, 120, None), (2, "m-1", "effect", 0, 90, None), (2, "m-12", "title", 50, 120, None), (3, "m-4", "transition", 90_000, 90_000, None), (3, "m-15", "transition", 60_000, 60_000, None)]
    kinds = "edit_id long, {}kind string, start_us long, end_us long, look string"
    log, plan = moves.accept_moves(
        spark.createDataFrame(chosen, "edit_id long, seq long, move_id string"), spark.createDataFrame(proposed, kinds.format("move_id string, ")), spark.createDataFrame([], kinds.format(""))
    )
    told = {(r["edit_id"], r["move_id"]): r["outcome"] for r in log.collect()}
    assert told == {(1, "m-2"): "accepted", (1, "m-13"): "overlaps", (2, "m-1"): "accepted", (2, "m-12"): "accepted", (3, "m-4"): "accepted", (3, "m-15"): "present"}
    assert {tuple(r)[:3] for r in plan.collect()} == {(1, "punch", 50), (2, "effect", 0), (2, "title", 50), (3, "transition", 90_000)}


def test_frames_travel_as_blocks(spark):
    from tempora.operators import acoustics as X

    # loud from 0.9 s to 1.1 s, over the edge of a block, and for two frames at 1.5 s, which is no run
    rows = [(1, n, -200 if 90 <= n < 110 or n in (150, 151) else -600) for n in range(300)] + [(2, n, -600) for n in range(300)]
    frames = spark.createDataFrame(rows, "source_id long, frame_no long, level_db10 long")
    windows = spark.createDataFrame([(7, 1, 0, 2_000_000), (8, 1, 950_000, 2_000_000), (9, 2, 0, 2_000_000), (10, 1, 2_990_000, 2_990_000), (11, 1, 600_000, 5_000_000)], "k long, source_id long, w_lo long, w_hi long")
    got = {r["k"]: [tuple(x) for x in r["runs"]] for r in X.voice_runs(windows, frames, ["k"]).collect()}
    assert got == {7: [(90, 109)], 8: [(95, 109)], 9: [], 11: [(90, 109)]}
    plan = X.voice_runs(windows, frames, ["k"])._jdf.queryExecution().executedPlan().toString()
    # what meets windows are blocks, not frames
    assert "collect_list" in plan and "ShuffledHashJoin" in plan and "_bin" not in plan


def test_a_replay_has_as_many_files_as_its_rows_need(spark):
    from tempora.plans.stream_queries import replay

    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64kb")
        stream = replay(spark.range(0, 400_000, 1, 8).selectExpr("id", "uuid() as word"), "id")
        path = stream._jdf.queryExecution().analyzed().toString()
        files = spark.read.parquet(path[path.index("file:") : path.index("/in") + 3]).inputFiles() if "file:" in path else []
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert len(files) > 4


def test_stretches_of_frames_are_read_like_single_ones(spark):
    from tempora.operators import acoustics as X

    level = [-200 if n % 97 < 25 else -600 + n % 5 for n in range(2_000)]
    rows = spark.createDataFrame([(1, n, v) for n, v in enumerate(level)], "source_id long, frame_no long, level_db10 long")
    edges = [0, 1, 450, 1400, 1401, 2000]  # stretches of a frame and over several bins
    runs = spark.createDataFrame([(1, a, level[a:b]) for a, b in zip(edges, edges[1:])], "source_id long, frame_no long, levels array<int>")
    windows = spark.createDataFrame([(k, 1, k * 170_000, k * 170_000 + 900_000) for k in range(110)], "k long, source_id long, w_lo long, w_hi long")
    a, b, c = (X.voice_runs(windows, f, ["k"], widest) for f, widest in ((rows, None), (runs, None), (runs, 900_000)))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) == sorted(map(str, c.collect())) and a.where("size(runs) > 0").count() > 90
    # levels go to their windows once and aren't gathered by window again
    assert c._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_tokens_are_numbered_without_sorting_them(spark):
    from tempora.operators import speech as P

    rows = [(1, "a", 0, 0, "x"), (1, "b", 10_000, 30_000, "y"), (1, "c", 39_999, 60_000, "y"), (1, "d", 50_000, 55_000, None), (1, None, 90_000, None, "x"), (1, "f", 200_000, 210_000, "x"), (1, "g", None, 5, "x"), (2, "h", 7, 9, "z")]
    words = spark.createDataFrame(rows, "source_id long, word string, start_us long, end_us long, speaker string")
    tokens = P.build_tokens(words)
    got = sorted(tuple(r) for r in tokens.where("source_id = 1").select("token_idx", "kind", "text", "start_us", "end_us", "speaker").collect())
    assert got == [
        (0, "word", "g", None, 5, "x"), (1, "word", "a", 0, 0, "x"), (2, "spacing", "", 0, 10_000, "x"), (3, "word", "b", 10_000, 30_000, "y"), (4, "word", "c", 39_999, 60_000, "y"), (5, "word", "d", 50_000, 55_000, None),
        (6, "spacing", "", 55_000, 90_000, None), (7, "word", None, 90_000, None, "x"), (8, "word", "f", 200_000, 210_000, "x"),
    ]
    plan = tokens._jdf.queryExecution().sparkPlan().toString()
    assert "Union" not in plan and plan.count("Scan ExistingRDD") == 1


def test_voice_is_looked_for_in_whole_vectors_and_runs_of_three(spark, tmp_path):
    # a stream of two vectors: quiet, but for two loud frames, then four over the seam of the vectors, then three at the end
    row = [-0.4] * 128
    for k in (10, 11, 62, 63, 64, 65, 125, 126, 127):
        row[k] = 0.3
    got, want = both(spark, tmp_path, "speech_mask", embeddings=vectors([row[:64], row[64:]]))
    assert got == want and len(got) == 128
    assert sorted(r[1] for r in got if r[3]) == [62, 63, 64, 65, 125, 126, 127]


def test_accepted_moves_shuffle_their_lines_once(spark, sf):
    for name in ("accept_moves", "accepted_plan"):
        plan = driver.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
        # lines are dealt by order to be numbered; neither the union of what is made of them nor the moves deal them again
        assert plan.count("Exchange") == plan.count("hashpartitioning(l_orderkey") > 0
