"""Secret scans: fixed patterns, and character Markov models that tell random strings from ordinary identifiers.

Two first-order character models, one of random strings and one of ordinary identifiers, score a token by the
log-likelihood ratio of its characters. Both learn from the corpus: what the patterns find are the random
samples, every other token is an ordinary one. Training is a sum of transition counts (about 9,500 of them at any corpus size); only these
go through the driver.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kind, pattern, the group whose length counts, and its least length.
BASE = (
    ("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
ORDER = {kind: k for k, (kind, *_) in enumerate(BASE)} | {"markov": len(BASE)}
PATTERNS = [(kind, re.compile(p, re.A | (re.I if kind == "assign" else 0)), g, n) for kind, p, g, n in BASE]

#: Characters of tokens; every other character is a boundary, symbol 0.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SYMBOLS = len(ALPHABET) + 1
LOOKUP = np.zeros(129, np.int64)
LOOKUP[[ord(c) for c in ALPHABET]] = np.arange(1, SYMBOLS)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}", re.A)
VALUE = re.compile(r"[A-Za-z0-9+/_-]{12,}={0,2}", re.A)

#: Weight of what is expected of a transition before any is seen.
PRIOR = 8.0
#: Nats a token must be likelier as a random string: in all and per character.
LLR_TOTAL = 12.0
LLR_EACH = 0.4


def base_spans(text: str) -> list[tuple[int, int, str, int, int]]:
    """(start, end, kind, start and end of the secret itself) of every base match, by start, then kind as listed."""
    out = []
    for kind, pattern, group, least in PATTERNS:
        for m in pattern.finditer(text):
            a, b = m.span(group)
            if b - a >= least:
                out.append((*m.span(), kind, a, b))
    return sorted(out, key=lambda x: (x[0], ORDER[x[2]]))


def suspects(text: str) -> list[tuple[int, int]]:
    """Tokens of 12 or more characters, of whatever classes: the models tell. In those under 20, = is no part but at the end, so a key doesn't lengthen its value."""
    out = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        out += [(a, b)] if b - a >= 20 else [v.span() for v in VALUE.finditer(text, a, b)]
    return out


def symbols(text: str) -> np.ndarray:
    """The symbol of each code point, between two boundaries."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.concatenate(([0], LOOKUP[np.minimum(points, 128)], [0]))


def transitions(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Transition counts of ordinary tokens and of the random strings in a text. Tokens that are to be judged are neither."""
    marks, ordinary, random = symbols(text), np.zeros(SYMBOLS**2, np.int64), np.zeros(SYMBOLS**2, np.int64)
    for _, _, _, a, b in base_spans(text):
        if marks[a + 1 : b + 1].any():
            own = np.concatenate(([0], marks[a + 1 : b + 1], [0]))
            random += np.bincount(own[:-1] * SYMBOLS + own[1:], minlength=SYMBOLS**2)
            marks[a + 1 : b + 1] = 0
    for a, b in suspects(text):
        marks[a + 1 : b + 1] = 0
    ordinary += np.bincount(marks[:-1] * SYMBOLS + marks[1:], minlength=SYMBOLS**2)
    ordinary[0] = 0
    return ordinary, random


def train(docs: DataFrame) -> np.ndarray:
    """Log-likelihood ratio (random over ordinary) of each transition, from all whole texts of docs.

    A transition counts beside PRIOR more that follow the single characters of ordinary tokens, or for random strings an even
    choice; with that choice the random model is also mixed in halves, as secrets outside the patterns need not use the characters of those
    found, and the ordinary one by a tenth, so that a few transitions a corpus lacks don't make an identifier random. An empty table leaves the even choice against itself.
    """

    def run(batches):
        sums = np.zeros((2, SYMBOLS**2), np.int64)
        for pdf in batches:
            for text in pdf["text"]:
                if text:
                    ordinary, random = transitions(text)
                    sums[0] += ordinary
                    sums[1] += random
        kind, step = np.nonzero(sums)
        yield pd.DataFrame({"kind": kind.astype(np.int32), "step": step.astype(np.int32), "n": sums[kind, step]})

    counted = docs.select("text").mapInPandas(run, "kind int, step int, n long").groupBy("kind", "step").agg(F.sum("n").alias("n"))
    sums = np.zeros((2, SYMBOLS**2))
    for row in counted.collect():  # at most 2 x SYMBOLS**2 rows
        sums[row["kind"], row["step"]] = row["n"]
    steps = sums.reshape(2, SYMBOLS, SYMBOLS)
    each = steps.sum(axis=1, keepdims=True) + 0.1
    prior = np.stack((each[0] / each[0].sum(), np.full((1, SYMBOLS), 1 / SYMBOLS)))
    p = (steps + PRIOR * prior) / (steps.sum(axis=2, keepdims=True) + PRIOR)
    return np.log(0.5 * p[1] + 0.5 / SYMBOLS) - np.log(0.9 * p[0] + 0.1 / SYMBOLS)


def markov_spans(text: str, llr: np.ndarray, taken: list[tuple]) -> list[tuple[int, int, str]]:
    """Suspects that the models call random, but those inside a base span."""
    out = []
    for start, end in suspects(text):
        if any(a <= start and end <= b for a, b, *_ in taken):
            continue
        marks = symbols(text[start:end])[:-1]
        total = llr[marks[:-1], marks[1:]].sum()
        if total >= LLR_TOTAL and total >= LLR_EACH * (end - start):
            out.append((start, end, "markov"))
    return out


def scan(docs: DataFrame, llr: np.ndarray | None = None) -> DataFrame:
    """Per row of docs (doc_id, text, any more columns): doc_id, spans (array of start, end, kind, by start, then kind as listed).

    Offsets are code points, ends exclusive. A null or empty text has no spans. Whole texts are read, however long. llr: as
    `train` returns it; learned from docs where it is None.
    """
    llr = train(docs) if llr is None else llr
    model = docs.sparkSession.sparkContext.broadcast(llr)  # SYMBOLS**2 numbers

    def run(batches):
        for pdf in batches:
            found = []
            for text in pdf["text"]:
                base = base_spans(text) if text else []
                more = markov_spans(text, model.value, base) if text else []
                every = sorted([x[:3] for x in base] + more, key=lambda x: (x[0], ORDER[x[2]]))
                found.append([{"start": a, "end": b, "kind": k} for a, b, k in every])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "spans": pd.Series(found, dtype=object, index=pdf.index)})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, spans array<struct<start:long,end:long,kind:string>>")


def digest_columns(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans (text) of what `scan` returns."""
    told = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return scanned.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex", "markov")],
        F.sha2(told(base).cast("binary"), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )
