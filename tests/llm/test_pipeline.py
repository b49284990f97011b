import pytest

import corpus_pipeline as C
from tempora.llm import decontaminate, line_dedup, mixing, quality, simhash

TABLES = ("documents", "labels", "benchmark")


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in C.STAGES:
        out = stage(spark, docs, sf).cache()
        seen.append((name, docs, out))
        docs = out
    return seen


def test_each_stage_decides_on_all_of_its_input(spark, sf, stages):
    (_, docs, good), (_, _, lines), (_, _, one), (_, _, clean), (_, _, mix) = stages
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    scored = quality.score(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert ids(good) == ids(scored.where("predicted = 1"))
    assert ids(lines) == ids(good)
    assert ids(one) == sorted({r["component_id"] for r in simhash.near_duplicates(lines).collect()})
    found = {r["doc_id"] for r in decontaminate.find(one, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert ids(clean) == [d for d in ids(one) if d not in found]
    assert ids(mix) == ids(mixing.mix(clean).where("taken > 0"))
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns


def test_lines_match_brute_force(stages):
    from .test_line_dedup import brute

    _, docs, out = stages[1]
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())[:60]
    small = docs.where(docs["doc_id"].isin([d for d, _ in rows]))
    first = {(d, n): (cd, cn) for d, n, cd, cn, _ in brute(rows)}
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(small).collect()}
    for d, text in rows:
        kept = [x for n, x in enumerate(text.split("\n")) if (d, n) not in first or first[d, n] == (d, n)]
        assert got[d] == "\n".join(kept)


def test_run_is_the_stages_in_turn(spark, sf, stages):
    got = {r["doc_id"]: r["taken"] for r in C.run(spark, sf).collect()}
    assert got == {r["doc_id"]: r["taken"] for r in stages[-1][2].collect()}


def test_empty_tables(spark, sf, tmp_path):
    for t in TABLES:
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_awkward_rows_in_every_stage(spark, sf, awkward, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    docs, got = awkward, {}
    for name, stage in C.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        got[name] = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    before = sorted(((r["doc_id"], r["text"]) for r in awkward.collect()), key=str)
    texts = {d: t for d, t in before}
    # without labels nothing goes
    assert got["quality"] == before
    # 2 repeats the line of 1, 9 is two edits from it; of equal lines in one document the first stays
    want = {**texts, 2: "", 9: "", 10: "x\n"}
    assert got["lines"] == sorted(((d, want[d]) for d, _ in before), key=str)
    # 2, 3, 4, 5 and 9 have no words
    assert [d for d, _ in got["near-duplicates"]] == [d for d, _ in got["benchmark"]] == sorted([None, 1, 2, 6, 7, 8, 10], key=lambda d: str((d, want[d])))
    assert sorted(map(str, (d for d, _ in got["mixing"]))) == sorted(["None", "1", "6", "7", "8", "10"])
    for column in ("size", "source_size", "target", "taken"):
        assert docs.columns.count(column) == 1
