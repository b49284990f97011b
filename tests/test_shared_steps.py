"""Steps that a query reads more than once are written once: its plan reads what was written, not the given table again."""

import pytest

from tempora import plans
from tempora.operators.folds import choose_apart


def test_choose_apart_reads_its_input_once(spark, tmp_path):
    path = f"{tmp_path}/given"
    rows = [(1, 0, 0, 10), (1, 1, 5, 15), (1, 2, 12, 20), (1, 3, 30, 40), (2, 0, 5, 5)]
    spark.createDataFrame(rows, "k long, nth int, start_us long, end_us long").write.parquet(path)
    out = choose_apart(spark.read.parquet(path), ["k"], ["nth"])
    assert not any("/given/" in f for f in out.inputFiles())
    assert {tuple(r) for r in out.collect()} == {(1, 0, 0, 10), (1, 2, 12, 20), (1, 3, 30, 40), (2, 0, 5, 5)}


@pytest.mark.parametrize("name", ["find_cut_candidates", "editorial_stills", "match_phrases", "replacements"])
def test_words_are_made_once(spark, sf, name):
    assert not any("conversations.parquet" in f for f in plans.QUERIES[name](spark, sf).inputFiles())


def test_tracks_are_read_a_row_a_cue(spark, monkeypatch):
    from tempora.operators import amends

    word = "struct<text:string,start_us:long,end_us:long>"
    cues = spark.createDataFrame([(1, 0, 0, 30, [("a", 0, 10), ("b", 10, 30)]), (1, 1, 40, 60, [("c", 40, 60)]), (2, 0, 0, 5, [])], f"edit_id long, cue_idx long, start_us long, end_us long, words array<{word}>")
    fixes = spark.createDataFrame([(1, 7, 10, "b", "x y"), (2, 8, 0, "q", "r")], "edit_id long, fix_id long, at_us long, old string, new string")
    seen, real = [], amends.fold
    monkeypatch.setattr(amends, "fold", lambda df, *a, **k: seen.append(df) or real(df, *a, **k))
    got = {tuple(r) for r in amends.carry_fixes(cues, fixes).collect()}
    assert seen[0].count() == 4  # two cues with words and two fixes
    assert got == {
        (1, "fix", 7, 0, "applied", 10, 10), (2, "fix", 8, 0, "lost", 0, 0), (1, "word", 0, 0, "a", 0, 10),
        (1, "word", 0, 1, "x", 10, 20), (1, "word", 0, 2, "y", 20, 30), (1, "word", 1, 0, "c", 40, 60),
    }
