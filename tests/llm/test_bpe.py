"""Encoding and decoding against the tokenizers library, the dealt way against the plain one, and awkward rows."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tempora.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load(PATH))


def test_every_early_character_in_context(encoder, library):
    for c in [*range(0x250), 0x300, 0x3A3, 0x6F22, 0xFB01, 0x1F642, 0x200D]:
        for s in (chr(c), f"a{chr(c)}b", f"1{chr(c)}{chr(c)}'s"):
            assert bpe.unpack(encoder.encode(s)) == library.encode(s, add_special_tokens=False).ids, hex(c)


@pytest.mark.parametrize("alphabet", ["a", "ab", "aeiouthnr", "abc'st !?1", "é́àΣσ漢🙂 a", ".-!<|>", "<|endoftext|> "])
def test_long_unsplit_text(encoder, library, alphabet):
    dice = random.Random(7)
    for size in (1, 31, 33, 64, 65, 200, 3000):
        s = "".join(dice.choice(alphabet) for _ in range(size)) + "<|endoftext|>" * (size % 2)
        want = library.encode(s, add_special_tokens=False).ids
        assert bpe.unpack(encoder.encode(s)) == want
        found = [(n, part, encoder.parcel(part, last, body)) for n, part, last, body in encoder.parcels(s, 23)]
        assert bpe.unpack(encoder.gather(found)) == want


def test_joins_grow_only_as_far_as_both_sides_need(encoder):
    left, right = encoder.stretch(b"thesene" * 20, False), encoder.stretch(b"ration" * 20, True)
    asked = []
    got = bpe.join(left, right, lambda tokens: asked.append(len(tokens)) or encoder.symbols_of(tokens), encoder.ranks)
    assert got == encoder.stretch(b"thesene" * 20 + b"ration" * 20, True)
    assert max(asked) < len(left)


def test_merges_by_list_and_by_heap_agree(encoder):
    dice = random.Random(3)
    for _ in range(200):
        symbols = [encoder.t["inner"][ord(dice.choice("ainthe"))] for _ in range(dice.randint(2, 30))]
        assert bpe.merge(symbols, encoder.ranks) == bpe._merge_long(symbols, encoder.ranks)


def rows(df):
    return sorted(((r.doc_id, bytes(r.ids), r.decoded) for r in df.select("doc_id", "ids", "decoded").collect()), key=repr)


def test_awkward_rows(awkward, nothing, library):
    for spread in (bpe.SPREAD, 20, 1):  # 1: every text with a character is dealt
        got = bpe.decode(bpe.encode(awkward, PATH, spread=spread, parcel=16), PATH)
        assert got.columns == [*awkward.columns, "ids", "decoded"]
        want = []
        for r in awkward.collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            want.append((r.doc_id, bpe.pack(ids), library.decode(ids, skip_special_tokens=False)))
        assert rows(got) == sorted(want, key=repr)
    assert bpe.decode(bpe.encode(nothing, PATH), PATH).count() == 0


def test_ids_beyond_the_doubles_beside_null_ones(make_docs):
    got = bpe.encode(make_docs([(2**62 + 1, "a b"), (None, "c")]), PATH)
    assert {r.doc_id for r in got.collect()} == {2**62 + 1, None}


def test_clashing_columns_are_replaced(awkward, library):
    got = bpe.encode(awkward.withColumn("ids", F.lit("x")).withColumn("llm_row", F.lit(1)).withColumn("piece", F.lit(2)), PATH, spread=10)
    assert dict(got.dtypes)["ids"] == "binary" and got.select("piece", "llm_row").distinct().count() == 1


def test_query(spark, sf, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op11_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(bpe.pack(ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
