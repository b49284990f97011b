import base64
import os
import random
import tempfile

import pytest

from tempora.llm import token_counts as T

CHANGES = "op string, doc_id long, source string, lang string, tokenizer string, n_tokens long, seq int, extra string"


def ledger(spark):
    return T.Ledger(spark, "file://" + tempfile.mkdtemp(prefix="spark-ledger-"))


def totals(led):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in led.totals().collect()}


def test_random_batches_match_a_plain_dictionary(spark):
    rnd, led, held = random.Random(7), ledger(spark), {}
    for b in range(4):
        rows, now = [], {}
        for seq in range(60):
            op, d, tok = rnd.choice(["insert", "revise", "delete"]), rnd.randrange(25), rnd.choice(["v1", "v2"])
            rows.append((op, d, rnd.choice(["s1", "s2", None]), rnd.choice(["en", None]), tok, rnd.randrange(50), seq, "x"))
            now[d, tok] = rows[-1]
        assert led.commit(f"b{b}", spark.createDataFrame(rows, CHANGES))
        for key, r in now.items():
            held.pop(key, None)
            if r[0] != "delete":
                held[key] = (r[2], r[3], r[4], r[5])
        want = {}
        for s, lang, tok, n in held.values():
            docs, tokens = want.get((s, lang, tok), (0, 0))
            want[s, lang, tok] = (docs + 1, tokens + n)
        assert totals(led) == want
        assert led.documents().count() == len(held)


def test_a_batch_counts_once(spark):
    led = ledger(spark)
    rows = spark.createDataFrame([("insert", 1, "s", "en", "v1", 5, 0, ""), ("insert", 1, "s", "en", "v2", 9, 0, "")], CHANGES)
    assert led.commit("a", rows) and not led.commit("a", rows)
    # what a failed attempt left is never read
    rows.write.parquet(f"{led.path}/data/left-behind/rows")
    assert totals(led) == {("s", "en", "v1"): (1, 5), ("s", "en", "v2"): (1, 9)}
    gone = spark.createDataFrame([("delete", 1, None, None, None, None, 0, ""), ("delete", 77, None, None, None, None, 0, "")], CHANGES)
    assert led.commit("b", gone) and totals(led) == {}


def test_awkward_changes(spark):
    led = ledger(spark)
    odd = [("insert", None, "s", "en", "v1", 5, 0, ""), ("insert", 2, "s", "en", "v1", None, 0, ""), ("insert", 3, None, None, "v1", 4, 0, ""), ("insert", 3, None, None, "v1", 4, 0, "")]
    assert led.commit("a", spark.createDataFrame(odd, CHANGES)) and totals(led) == {(None, None, "v1"): (1, 4)}
    assert led.commit("empty", spark.createDataFrame([], CHANGES)) and totals(led) == {(None, None, "v1"): (1, 4)}
    with pytest.raises(Exception, match="unknown op"):
        led.commit("bad", spark.createDataFrame([("upsert", 1, "s", "en", "v1", 5, 0, "")], CHANGES))
    assert "bad" not in led.batches()
    with pytest.raises(ValueError):
        led.commit("a@b", spark.createDataFrame([], CHANGES))


def test_counts(spark, awkward, nothing):
    rows = T.count(awkward).collect()
    assert len(rows) == 24 and {(r["tokenizer"], r["n_tokens"]) for r in rows if r["doc_id"] == 8} == {("words-1", 5), ("pieces-1", 5)}
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)} == {0} and T.count(nothing).count() == 0


def test_byte_pair_counts(spark, awkward):
    P = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = T.count_bpe(awkward, "file://" + os.path.abspath(path), "bpe-50k", P.PATTERN).collect()
    want = sorted(len(coder.encode_ordinary(r["text"])) if r["text"] else 0 for r in awkward.collect())
    assert sorted(r["n_tokens"] for r in got) == want
