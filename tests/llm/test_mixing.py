import random
import re

from tempora.llm import mixing as M


def water(sizes, weights=M.WEIGHTS):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: float(weights[n % len(weights)]) for n, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        rate = left / sum(w[s] for s in open_)
        full = {s for s in open_ if rate * w[s] > 2 * sizes[s]}
        if not full:
            return target | {s: rate * w[s] for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def rows(seed, n=150):
    rnd = random.Random(seed)
    return [(d, " ".join(["w"] * rnd.choice([0, 1, 3, 40, 200])) if d % 17 else None, "en", rnd.choice(["a", "a", "a", "b", "c", "É", None, "zz"])) for d in range(n)]


def test_targets_and_taken(make_docs):
    for seed in (1, 2):
        data = rows(seed)
        got = M.mix(make_docs(data), block_tokens=16).collect()
        sizes = {}
        for _, text, _, source in data:
            sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        want = water(sizes)
        taken = dict.fromkeys(sizes, 0)
        for r in got:
            assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
            taken[r["source"]] += r["taken"]
        assert len(got) == len(data) and all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_reruns_agree_and_blocks_do_not_change_the_mix(make_docs):
    data = rows(3)
    a, b = (sorted(map(str, M.mix(make_docs(data).repartition(p), block_tokens=t).collect())) for p, t in ((2, 16), (7, 64)))
    assert a == b


def test_schedule_is_a_low_discrepancy_sequence(spark):
    plan = spark.createDataFrame([("a", 1000, 2000.0), ("b", 1000, 1000.0), (None, 300, 150.0), ("c", 0, 0.0)], "source string, source_size long, target double")
    slots = sorted(M.schedule(plan, 10).collect(), key=lambda r: r["slot"])
    n = len(slots)
    assert sum(r["take"] for r in slots) == 3150 and len({r["slot"] for r in slots}) == n == 315
    share, seen = {"a": 200 / n, "b": 100 / n, None: 15 / n}, dict.fromkeys(("a", "b", None), 0)
    for k, r in enumerate(slots, 1):
        seen[r["source"]] += 1
        assert all(abs(seen[s] - share[s] * k) < 10 for s in seen)
    for s in ("a", "b", None):
        ranks = sorted(r["rank"] for r in slots if r["source"] == s)
        assert ranks == list(range(len(ranks)))


def test_awkward_rows(awkward, nothing):
    got = M.mix(awkward).collect()
    assert len(got) == 12 and {r["taken"] for r in got if r["doc_id"] in (3, 4, 5)} == {0}
    assert M.mix(nothing).count() == 0
    kept = M.mixed(awkward)
    assert kept.columns == [c for c in awkward.columns if c != "size"] + ["size", "source_size", "target", "taken"]


def test_repeated_rows_reach_the_target_together(make_docs):
    data = rows(5, 60) + [(7, "one two three", "en", "a")] * 5 + [(7, "other words", "en", "a"), (None, "x y", "en", "b"), (None, "x y", "en", "b")]
    docs = make_docs(data)
    per = lambda df: sorted((str(r["source"]), r["taken"]) for r in df.groupBy("source").agg({"taken": "sum"}).toDF("source", "taken").collect())
    assert per(M.mixed(docs)) == per(M.mix(docs)) and M.mixed(docs).count() == len(data)
