import functools
import random
import zlib

import numpy as np

from tempora.llm import language_id as L


def test_code_lengths_are_those_of_the_trees():
    """Code lengths against escapes worked out byte by byte, and every context's probabilities sum to one."""
    text = "abracadabra abrakadabra alakazam é漢 é字"
    marks = L.folded(text)
    codes, n = np.unique(L.grams(marks), return_counts=True)
    orders = L.tree(codes, n.astype(float))
    seen = [{} for _ in range(L.ORDER + 1)]
    padded = [L.SPACE] * L.ORDER + marks.tolist()
    for at in range(L.ORDER, len(padded)):
        for k in range(L.ORDER + 1):
            row = seen[k].setdefault(tuple(padded[at - k : at]), {})
            row[padded[at]] = row.get(padded[at], 0) + 1

    @functools.cache
    def p(ctx, s, k):
        if k < 0:
            return 1 / 256
        row = seen[k].get(ctx)
        if row is None:
            return p(ctx[1:], s, k - 1)
        total, kinds = sum(row.values()), len(row)
        if s in row:
            return row[s] / (total + kinds)
        free = sum(p(ctx[1:], x, k - 1) for x in range(256) if x not in row)
        return kinds / (total + kinds) * p(ctx[1:], s, k - 1) / free

    for ctx in (b"abr", b"ara", b"zzz", b"a a", "漢".encode(), "é".encode() + b"x"):
        code = np.array([int.from_bytes(ctx + bytes([s]), "big") for s in range(256)], np.uint32)
        got = np.exp2(-L.code_bits(orders, code))
        assert abs(got.sum() - 1) < 1e-6
        for s in (97, 98, 32, 0xC3, 0xE6, 7):
            assert abs(got[s] - p(tuple(ctx), s, 3)) < 1e-9
    want = -sum(np.log2(p(tuple(padded[at - 3 : at]), padded[at], 3)) for at in range(3, len(padded)))
    got = L.text_bits([orders, orders], [text, "", text])
    assert np.allclose(got, [[want] * 2, [0] * 2, [want] * 2])


def test_scripts_are_told_apart(make_docs):
    """Languages that share a script of multi-byte letters, beside Latin ones."""
    rnd = random.Random(3)
    words = {
        "ru": "это не только очень хорошая погода но она была где мы его ждали", "uk": "це не тільки дуже гарна погода але вона була де ми його чекали",
        "ja": "これ は とても いい 天気 です が 私 たち は 待って いました", "zh": "这 不 只 是 很 好 的 天气 但是 我们 在 那里 等 他",
        "el": "αυτό δεν είναι μόνο πολύ καλός καιρός αλλά ήταν εκεί", "en": "this is not only very good weather but it was where we waited",
        "hi": "यह केवल बहुत अच्छा मौसम नहीं है लेकिन वह वहाँ था", "mr": "हे फक्त खूप चांगले हवामान नाही पण ते तिथे होते",
    }
    rows = [(n, " ".join(rnd.choice(words[x].split()) for _ in range(25)), x) for n, x in enumerate(sorted(words) * 30)]
    got = {r["doc_id"]: r for r in L.identify(make_docs(rows)).collect()}
    assert all(got[n]["lang_pred"] == x for n, _, x in rows if got[n]["held_out"]) and sum(r["held_out"] for r in got.values()) > 20


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = L.identify(docs).collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(truth) and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_held_out_and_unlabelled_rows_teach_nothing(make_docs):
    rows = [(n, "the cat and the dog sat on the mat", "en") for n in range(30)] + [(50 + n, "der hund und die katze auf der matte", "de") for n in range(30)]
    more = [(n, "xx yy zz", "qq") for n in range(200, 260) if zlib.crc32(str(n).encode()) % 5 == 0] + [(400, "some text", None)]
    assert L.train(make_docs(rows + more)).langs == ["de", "en"]


def test_awkward_rows(awkward, nothing):
    got = {r["doc_id"]: r for r in L.identify(awkward).collect()}
    assert {got[d]["lang_pred"] for d in (3, 4, 5)} == {"und"} and got[1]["lang_pred"] in ("en", "de") and got[6]["lang_pred"] in ("en", "de")
    assert L.identify(nothing).count() == 0
    assert {r["lang_pred"] for r in L.identify(awkward, L.train(nothing)).collect()} == {"und"}


def test_marks_and_numbers_are_no_letters():
    assert not any(L.LETTER.search(t) for t in ("²", "½", "Ⅷ", "12 _ -", "́")) and all(L.LETTER.search(t) for t in ("a", "ß", "漢", "ª"))
