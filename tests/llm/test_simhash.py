import random
import re

import xxhash

from tempora.llm import shared, simhash


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def test_fingerprints(sf, spark):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r["fp"] & (2**64 - 1) for r in simhash.fingerprints(docs).collect()}
    assert got == {r["doc_id"]: plain(r["text"]) for r in docs.collect()}
    for text in ("", None, "one", "Two words", "ÀB ÀB\x0bab", "a b c " * 3):
        assert simhash.fingerprint(text) & (2**64 - 1) == plain(text)
    long = " ".join(str(n % 1013) for n in range(simhash.CHUNK + 500))
    assert simhash.fingerprint(long) & (2**64 - 1) == plain(long)


def test_links_match_brute_force(spark):
    rnd = random.Random(4)
    fps = set()
    for _ in range(60):
        f = rnd.getrandbits(64)
        fps.add(f)
        for _ in range(5):
            g = f
            for b in rnd.sample(range(64), rnd.randint(1, 5)):
                g ^= 1 << b
            fps.add(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    got = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want) > 50


def test_components(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(n, n + 1) for n in range(400, 440)] + [(500, n) for n in range(501, 560)] + [(7, 7)]
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    got = {r["node"]: r["component"] for r in shared.components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == components(nodes, [p for p in pairs if p[0] != p[1]])
    assert shared.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_near_duplicates_and_the_one_that_stays(make_docs):
    base = " ".join(f"w{n}" for n in range(400))
    rows = [(5, base), (3, base), (8, base.replace("w200", "x")), (9, "other words here entirely"), (4, None), (2, ""), (3, base)]
    rows += [(20 + n, " ".join(random.Random(n).choices(["alpha", "beta", "gamma", "delta", "eps"], k=60))) for n in range(15)]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(make_docs(rows)).collect()}
    fps = {d: plain(t) for d, t in rows}
    linked = [(a, b) for a in fps for b in fps if bin(fps[a] ^ fps[b]).count("1") <= 3]
    assert {d: r["component_id"] for d, r in got.items()} == components(list(fps), linked)
    kept = [r["doc_id"] for r in simhash.keep_one(make_docs(rows)).collect()]
    assert sorted(kept) == sorted({r["component_id"] for r in got.values()}) and 3 in kept and 2 in kept


def test_awkward_rows(awkward, nothing):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == 12 and {r["component_id"] for r in rows if r["doc_id"] in (3, 4, 5)} == {3}
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [1, 3, 6, 7, 8, 9, 10]
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0
