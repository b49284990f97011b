"""Quality classifier: Bradley-Terry ranking of documents, cut at a quantile of the scores.

A document's strength is linear in features of its text. A pair of a good and a bad document is a comparison the good
one won, with probability logistic(difference of strengths); the weights minimise the logistic loss over feature differences. The
threshold is the quantile of training strengths at the share of bad labels.

The fit uses every labelled document outside the held-out fold: features, pairs and strengths are tables, and the driver sees sums (a matrix of weights by weights for each task and step)
and counts of strengths in ranges. Every text is scored in one pass without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, fold, materialise

#: Good documents each bad one is compared with, and the other way round.
RIVALS = 8
RIDGE = 1e-3
STEPS = 40
CUT = 0.7
#: Ranges that strengths are counted in, how often a range is cut into as many, and strengths that are few enough to be looked at singly.
RANGES, ROUNDS, FEW = 1024, 6, 10_000
FEATURES = (
    "log_words", "word_length", "letters", "digits", "upper", "marks", "distinct_words", "top_word", "doubled_words",
    "odd_words", "short_words", "line_length", "repeated_lines", "bars", "distinct_bytes",
)

_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 lower or non-ASCII letter byte, 2 upper, 3 digit, 4 white space, 5 mark
_CLASS[33:127] = 5
_CLASS[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = 1
_CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4


def features(text: str | None) -> list[float]:
    """FEATURES of a whole text; zeros for a null, empty or blank one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    data = np.frombuffer(raw, np.uint8)
    kinds = np.bincount(_CLASS[data], minlength=6)
    ink = len(raw) - kinds[4]
    letters = kinds[1] + kinds[2]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    n = len(words)
    bare = [w.strip(b".,;:") for w in counts]
    odd = sum(counts[w] for w, b in zip(counts, bare, strict=True) if not b.isalpha() and any(c < 128 and _CLASS[c] in (3, 5) for c in b))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    byte_counts = np.bincount(data, minlength=256)
    return [
        np.log1p(n),
        ink / n,
        letters / ink,
        kinds[3] / ink,
        kinds[2] / max(letters, 1),
        kinds[5] / ink,
        len(counts) / n**0.8,
        max(counts.values()) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        odd / n,
        sum(c for w, c in counts.items() if len(w) <= 3) / n,
        np.log1p(len(raw) / len(lines)),
        1 - len(set(lines)) / len(lines),
        byte_counts[ord("|")] / n,
        np.count_nonzero(byte_counts) / 64,
    ]


def _sums(d: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Sums over the rows of d of the logistic loss at w, its slope and its bend."""
    m = d @ w
    p = 1 / (1 + np.exp(np.clip(m, -500, 500)))
    return float(np.logaddexp(0, -m).sum()), -(d * p[:, None]).sum(axis=0), (d * (p * (1 - p))[:, None]).T @ d


def _descend(sums, n: int, k: int) -> np.ndarray:
    """The k weights with the least mean loss + RIDGE |w|^2 / 2, by Newton steps; sums(w) is `_sums` of n rows."""

    def look(w):
        loss, slope, bend = sums(w)
        return loss / n + RIDGE / 2 * w @ w, slope / n + RIDGE * w, bend / n + RIDGE * np.eye(k)

    w = np.zeros(k)
    now, slope, bend = look(w)
    for _ in range(STEPS):
        step, size = np.linalg.solve(bend, slope), 1.0
        then = look(w - step)
        while size > 1e-6 and then[0] > now:
            size /= 2
            then = look(w - size * step)
        w, was, (now, slope, bend) = w - size * step, now, then
        if was - now < 1e-10:
            break
    return w


class Ranker:
    """Standardisation, weights, threshold and slope; without rivals to learn from, every score is CUT."""

    def __init__(self, mean=None, scale=None, weights=None, at: float = 0.0, slope: float = 0.0):
        k = len(FEATURES)
        self.mean, self.scale = np.zeros(k) if mean is None else mean, np.ones(k) if scale is None else scale
        self.weights, self.at, self.slope = np.zeros(k) if weights is None else weights, at, slope

    @staticmethod
    def _newton(d: np.ndarray) -> np.ndarray:
        """Weights with the least mean log(1 + exp(-d w)) + RIDGE |w|^2 / 2."""
        return _descend(lambda w: _sums(d, w), len(d), d.shape[1])

    def plain(self) -> tuple:
        """What scores are made of, as arrays and numbers: workers that read it need no copy of this package."""
        return self.mean, self.scale, self.weights, self.at, self.slope

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, CUT at the threshold."""
        return scores_of(self.plain(), x)


def scores_of(plain: tuple, x: np.ndarray) -> np.ndarray:
    mean, scale, weights, at, slope = plain
    away = slope * (np.clip((x - mean) / scale, -8, 8) @ weights - at) + np.log(CUT / (1 - CUT))
    return 1 / (1 + np.exp(-np.clip(away, -500, 500)))


def _mapped(rows: DataFrame, kept: list[str], schema: str, make):
    def run(batches):
        for pdf in batches:
            x = np.array([features(t) for t in pdf["text"]]).reshape(-1, len(FEATURES))
            yield pd.DataFrame({c: pdf[c] for c in kept} | make(x))

    return rows.mapInPandas(run, schema)


def _known(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) outside the held-out fold. Labels other than 0 and 1, and documents labelled both ways, aren't used; repeated labels count once."""
    return (
        labels.where("quality in (0, 1) and doc_id is not null")
        .where(fold(labels) % 4 != 2)
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("_most"))
        .where("quality = _most")
        .select("doc_id", "quality")
    )


def _numbered(docs: DataFrame, known: DataFrame, n_known: int) -> DataFrame:
    """(quality, nth, x): the features of every known document, numbered from 0 in each class by doc_id. Rows are ordered in their files, so that sums over them are the same in each run."""
    kept = known.select(F.col("doc_id").alias("_id"), "quality")
    pick = lambda rows, side: rows.join(side, F.col("doc_id") == F.col("_id")).drop("_id")
    make = lambda rows, kept, schema: _mapped(rows, kept, schema + ", x array<double>", lambda x: {"x": list(x)})
    texts = docs.select("doc_id", "text")
    if n_known <= BROADCAST_ROWS:
        found = make(pick(texts, F.broadcast(kept)).select("doc_id", "quality", "text"), ["doc_id", "quality"], "doc_id long, quality int")
    else:  # features are small next to texts: they go to the labels
        found = pick(make(texts.where("doc_id is not null"), ["doc_id"], "doc_id long"), kept)
    once = found.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x"))
    dealt = once.repartitionByRange("quality", "doc_id").sortWithinPartitions("quality", "doc_id").withColumn("part", F.spark_partition_id())
    dealt = materialise(dealt, "quality-features")
    ahead, passed = {0: 0, 1: 0}, []
    for r in dealt.groupBy("quality", "part").count().orderBy("quality", "part").collect():  # two rows a partition at most
        passed.append((r["quality"], r["part"], ahead[r["quality"]]))
        ahead[r["quality"]] += r["count"]
    offsets = F.broadcast(docs.sparkSession.createDataFrame(passed, "quality int, part int, ahead long"))
    row = F.row_number().over(Window.partitionBy("part", "quality").orderBy("doc_id"))
    placed = dealt.join(offsets, ["quality", "part"]).select("quality", (F.col("ahead") + row - 1).alias("nth"), "x")
    return materialise(placed.repartitionByRange("quality", "nth").sortWithinPartitions("quality", "nth"), "quality-numbered")


def _totals(rows: DataFrame, column: str, make) -> list[np.ndarray]:
    """Sums of the arrays that make gives for a matrix of the rows' column, added up by task in order."""

    def run(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                told = np.concatenate([np.ravel(v) for v in make(np.array(pdf[column].tolist(), dtype=float))])
                total = told if total is None else total + told
        if total is not None:
            yield pd.DataFrame({"v": [total.tolist()]})

    parts = rows.select(column).mapInPandas(run, "v array<double>").collect()
    return np.sum([np.array(r["v"]) for r in parts], axis=0)


def _pairs(numbered: DataFrame, n_up: int, n_down: int, mean: np.ndarray, scale: np.ndarray) -> DataFrame:
    """(d): standardised features of a good document less those of a bad one. Each shift pairs every document of the larger class with one of the smaller."""
    up_leads = n_up >= n_down
    own, n, other, m = (17, n_up, 31, n_down) if up_leads else (31, n_down, 17, n_up)
    shift = F.explode(F.sequence(F.lit(0), F.lit(RIVALS - 1)))
    turn = F.pmod(F.col("nth") - own * F.col("k"), F.lit(n))
    lead = numbered.where(F.col("quality") == int(up_leads)).select("nth", "x", shift.alias("k")).select("nth", "k", "x", F.pmod(turn + other * F.col("k"), F.lit(m)).alias("rival"))
    rivals = numbered.where(F.col("quality") == int(not up_leads)).select(F.col("nth").alias("rival"), F.col("x").alias("y"))
    z = lambda xs: np.clip((np.array(xs.tolist(), dtype=float).reshape(-1, len(mean)) - mean) / scale, -8, 8)
    sign = 1.0 if up_leads else -1.0

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"nth": pdf["nth"], "k": pdf["k"], "d": list(sign * (z(pdf["x"]) - z(pdf["y"])))})

    made = lead.join(rivals, "rival").select("nth", "k", "x", "y").mapInPandas(run, "nth long, k int, d array<double>")
    return materialise(made.repartitionByRange("nth", "k").sortWithinPartitions("nth", "k").select("d"), "quality-pairs")


def _threshold(strengths: DataFrame, weight: tuple[float, float], share: float) -> float:
    """The mean of three strengths (s, quality) around where the sum of weights (bad, good), from the lowest strength on, reaches share. Ranges are cut until few strengths are left in the one that holds it."""
    counts = [F.count_if(F.col("quality") == q).alias(f"n{q}") for q in (0, 1)]
    heavy = lambda r: weight[0] * r["n0"] + weight[1] * r["n1"]
    lo, hi = strengths.agg(F.min("s"), F.max("s")).first()
    inside, before = F.col("s").between(lo, hi), 0.0
    for _ in range(ROUNDS):
        if hi <= lo or strengths.where(inside).count() <= FEW:
            break
        at = F.least(F.floor((F.col("s") - lo) / (hi - lo) * RANGES), F.lit(RANGES - 1))
        told = strengths.where(inside).groupBy(at.alias("r")).agg(*counts, F.min("s").alias("lo"), F.max("s").alias("hi")).orderBy("r").collect()
        for r in told:
            if before + heavy(r) >= share - 1e-9 or r is told[-1]:
                lo, hi = r["lo"], r["hi"]
                break
            before += heavy(r)
        inside = F.col("s").between(lo, hi)
    values = [(r["s"], r["n0"], r["n1"]) for r in strengths.where(inside).groupBy("s").agg(*counts).orderBy("s").collect()]
    ends = strengths.agg(F.max(F.when(F.col("s") < lo, F.col("s"))).alias("under"), F.min(F.when(F.col("s") > hi, F.col("s"))).alias("over")).first()
    s = np.repeat([v[0] for v in values], [min(v[1] + v[2], 3) for v in values])
    below, reached = 0, before
    for _, n0, n1 in values:
        if reached + n0 * weight[0] + n1 * weight[1] >= share - 1e-9:
            # which of equal strengths it is only matters at their ends
            each = (n0 * weight[0] + n1 * weight[1]) / (n0 + n1)
            nth = max(1, int(np.ceil((share - 1e-9 - reached) / each)))
            below += 0 if nth == 1 else min(n0 + n1, 3) - 1 if nth >= n0 + n1 else 1
            break
        reached, below = reached + n0 * weight[0] + n1 * weight[1], below + min(n0 + n1, 3)
    padded = [*([ends["under"]] if ends["under"] is not None else []), *s, *([ends["over"]] if ends["over"] is not None else [])]
    below += ends["under"] is not None
    return float(np.mean(padded[max(below - 1, 0) : below + 2]))


def train(docs: DataFrame, labels: DataFrame) -> Ranker:
    """Fit on all labelled documents outside the held-out fold (crc32 of doc_id mod 4 is 2).

    Labels other than 0 and 1, and documents labelled both ways, aren't used; repeated labels count once.
    """
    known = materialise(_known(labels), "quality-labels")
    n = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Ranker()
    bad_share = n[0] / (n[0] + n[1])
    numbered = _numbered(docs, known, n[0] + n[1])
    here = {r["quality"]: r["n"] for r in numbered.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(here) < 2:
        return Ranker()
    size, k = here[0] + here[1], len(FEATURES)
    mean = _totals(numbered, "x", lambda x: [x.sum(axis=0)]) / size
    scale = np.maximum(np.sqrt(_totals(numbered, "x", lambda x: [((x - mean) ** 2).sum(axis=0)]) / size), 1e-6)
    pairs = _pairs(numbered, here[1], here[0], mean, scale)

    def sums(w):
        told = _totals(pairs, "d", lambda d: _sums(d, w))
        return told[0], told[1 : k + 1], told[k + 1 :].reshape(k, k)

    weights = _descend(sums, RIVALS * max(here.values()), k)

    def run(batches):
        for pdf in batches:
            x = np.array(pdf["x"].tolist(), dtype=float).reshape(-1, k)
            yield pd.DataFrame({"quality": pdf["quality"], "s": np.clip((x - mean) / scale, -8, 8) @ weights})

    strengths = materialise(numbered.mapInPandas(run, "quality int, s double"), "quality-strengths")
    return Ranker(mean, scale, weights, _threshold(strengths, (bad_share / here[0], (1 - bad_share) / here[1]), bad_share), 1.0)


def score(docs: DataFrame, labels: DataFrame, ranker: Ranker | None = None) -> DataFrame:
    """Per row of docs (doc_id, text, any more columns): doc_id, held_out, score, predicted.

    Null and empty texts have the features of an empty text and are scored like any other, very long ones are read whole; without labels of both kinds every score is 0.7.
    A null doc_id isn't held out. Rows that repeat get a row each; an empty table gives an empty one. Other columns, whatever their names, play no part.
    """
    ranker = train(docs, labels) if ranker is None else ranker
    model = docs.sparkSession.sparkContext.broadcast(ranker.plain())  # a few dozen numbers
    rows = docs.select("doc_id", F.coalesce(fold(docs) % 4 == 2, F.lit(False)).alias("held_out"), "text")
    scored = _mapped(rows, ["doc_id", "held_out"], "doc_id long, held_out boolean, score double", lambda x: {"score": scores_of(model.value, x)})
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, ranker: Ranker | None = None) -> DataFrame:
    """docs without the rows that score under CUT; all columns stay, whatever their names.

    Null, empty, very long and repeated rows are scored as in `score`: equal texts stay or go together. Without labels of both kinds, all rows stay.
    """
    ranker = train(docs, labels) if ranker is None else ranker
    model = docs.sparkSession.sparkContext.broadcast(ranker.plain())

    def run(texts: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))
        return pd.Series(scores_of(model.value, x))

    return docs.where(F.pandas_udf(run, "double")("text") >= CUT)
