import random
import zlib

import numpy as np

from tempora.llm import quality

LABELS = "doc_id long, quality int, toxic int, score double"


def corpus(n=240, seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    rows, labels = [], []
    for d in range(n):
        good = rnd.random() < 0.8
        words = [word() for _ in range(rnd.randint(30, 120))]
        rows.append((d, " ".join(words).capitalize() + "." if good else " ".join(w + rnd.choice(["###", "%%%", "$$$"]) for w in words)))
        labels.append((d, int(good), 0, 0.5))
    return rows, labels


def test_held_out_documents_are_told_apart(spark, make_docs):
    rows, labels = corpus()
    got = quality.score(make_docs(rows), spark.createDataFrame(labels, LABELS)).collect()
    truth = {d: q for d, q, *_ in labels}
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_held_out_labels_change_nothing(spark, make_docs):
    rows, labels = corpus()
    swapped = [(d, 1 - q if zlib.crc32(str(d).encode()) % 4 == 2 else q, t, s) for d, q, t, s in labels]
    a = quality.train(make_docs(rows), spark.createDataFrame(labels, LABELS))
    b = quality.train(make_docs(rows), spark.createDataFrame(swapped, LABELS))
    assert np.array_equal(a.weights, b.weights) and a.at == b.at


def test_pairs_are_fitted_by_logistic_loss():
    rng = np.random.default_rng(0)
    d = rng.normal(size=(400, 3)) + np.array([1.0, 0, 0])
    w = quality.Ranker._newton(d)
    loss = lambda v: np.logaddexp(0, -(d @ v)).mean() + quality.RIDGE / 2 * v @ v
    assert all(loss(w) <= loss(w + e) for e in rng.normal(size=(50, 3)) * 0.05)


def test_scores_match_brute_force(spark, make_docs):
    """Features, pairs, loss, threshold and scores worked out again in plain Python, one number at a time."""
    import math

    rows, labels = corpus(90, seed=5)
    texts, truth = dict(rows), {d: q for d, q, *_ in labels if zlib.crc32(str(d).encode()) % 4 != 2}
    ids = sorted(truth)

    def plain_features(text):
        raw = text.encode()
        words, ink = raw.split(), [c for c in raw if c not in b" \t\n\v\f\r"]
        n, m = len(words), len(ink)
        low = [c for c in ink if 97 <= c <= 122 or c >= 128]
        up = [c for c in ink if 65 <= c <= 90]
        dig = [c for c in ink if 48 <= c <= 57]
        marks = m - len(low) - len(up) - len(dig)
        kinds = set(words)
        odd = [w for w in words if not w.strip(b".,;:").isalpha() and any(33 <= c < 127 and not chr(c).isalpha() for c in w.strip(b".,;:"))]
        lines = [x for x in raw.split(b"\n") if x.strip()]
        return [
            math.log(1 + n), m / n, (len(low) + len(up)) / m, len(dig) / m, len(up) / max(len(low) + len(up), 1), marks / m, len(kinds) / n**0.8,
            max(words.count(w) for w in kinds) / n, sum(a == b for a, b in zip(words, words[1:])) / n, len(odd) / n,
            sum(len(w) <= 3 for w in words) / n, math.log(1 + len(raw) / len(lines)), 1 - len(set(lines)) / len(lines), raw.count(b"|") / n, len(set(raw)) / 64,
        ]

    x = {d: plain_features(t) for d, t in texts.items()}
    k = len(quality.FEATURES)
    mean = [sum(x[d][j] for d in ids) / len(ids) for j in range(k)]
    scale = [max(math.sqrt(sum((x[d][j] - mean[j]) ** 2 for d in ids) / len(ids)), 1e-6) for j in range(k)]
    z = {d: [min(8, max(-8, (v - m) / s)) for v, m, s in zip(x[d], mean, scale)] for d in x}
    up, down = [d for d in ids if truth[d]], [d for d in ids if not truth[d]]
    n = max(len(up), len(down))
    pairs = [(up[(t + 17 * r) % len(up)], down[(t + 31 * r) % len(down)]) for r in range(quality.RIVALS) for t in range(n)]
    diffs = [[a - b for a, b in zip(z[g], z[b])] for g, b in pairs]
    w = [0.0] * k  # gradient descent with momentum on the logistic loss
    speed = [0.0] * k
    for _ in range(3000):
        slope = [quality.RIDGE * v for v in w]
        for d in diffs:
            p = 1 / (1 + math.exp(sum(a * b for a, b in zip(d, w))))
            for j in range(k):
                slope[j] -= d[j] * p / len(diffs)
        speed = [0.9 * v - 0.3 * s for v, s in zip(speed, slope)]
        w = [v + s for v, s in zip(w, speed)]
        if max(map(abs, slope)) < 1e-7:
            break
    strength = {d: sum(a * b for a, b in zip(z[d], w)) for d in z}
    got = {r["doc_id"]: r["score"] for r in quality.score(make_docs(rows), spark.createDataFrame(labels, LABELS)).collect()}
    # scores are a logistic curve of the strengths, 0.7 where as many training documents lie below as are labelled bad
    logit = {d: math.log(s / (1 - s)) for d, s in got.items() if 1e-9 < s < 1 - 1e-9}
    at = {d: strength[d] - logit[d] for d in logit}
    assert len(logit) > 60 and max(at.values()) - min(at.values()) < 0.05
    assert abs(sum(got[d] < quality.CUT for d in ids) - len(down)) <= 1


def test_awkward_rows(spark, awkward, nothing):
    none = spark.createDataFrame([], LABELS)
    odd = spark.createDataFrame([(1, 1, 0, 0.1), (2, None, 0, 0.1), (None, 1, 1, 0.1), (7, 0, 0, 0.1), (7, 1, 0, 0.1), (9, 5, None, None)], LABELS)
    assert {r["score"] for r in quality.score(awkward, none).collect()} == {quality.CUT}
    assert quality.score(awkward, odd).count() == 12 and quality.keep_good(awkward, none).count() == 12 and quality.score(nothing, odd).count() == 0


def test_every_labelled_document_counts(spark, make_docs):
    """20,000 good documents: the model is that of all of them, not of some."""
    rng = np.random.default_rng(3)
    rows = [(d, ("good plain words here " * (1 + d % 7)).strip() if d % 2000 else "### $$ %%% 12 " * (1 + d % 5)) for d in range(20_000)]
    labels = [(d, int(d % 2000 > 0), 0, 0.5) for d, _ in rows]
    ranker = quality.train(make_docs(rows), spark.createDataFrame(labels, LABELS))
    x = np.array([quality.features(t) for d, t in rows if zlib.crc32(str(d).encode()) % 4 != 2])
    assert np.allclose(ranker.mean, x.mean(axis=0), rtol=1e-9) and len(x) > 14_000
    s, q = rng.normal(size=30_000).round(3), (rng.random(30_000) < 0.8).astype(int)
    share = float((q == 0).mean())
    weight = (share / (q == 0).sum(), (1 - share) / q.sum())
    order = np.argsort(s, kind="stable")
    below = int(np.searchsorted(np.cumsum(np.where(q == 1, weight[1], weight[0])[order]), share - 1e-9))
    strengths = spark.createDataFrame(list(zip(s.tolist(), q.tolist())), "s double, quality int")
    assert abs(quality._threshold(strengths, weight, share) - s[order][max(below - 1, 0) : below + 2].mean()) < 2e-3
