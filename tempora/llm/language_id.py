"""Language identification by prediction by partial matching over bytes.

Each language has a context tree: counts of the byte that follows each context of three, two, one and no bytes. A byte's
probability comes from the longest context seen, by its count; a byte unseen there costs an escape (method C: as likely as
the number of different bytes seen) and is looked up in the next shorter context, where bytes already ruled out are left out, so the code is
exact. Statistics are frozen after training; a text's language is the one that codes its bytes shortest.

All 256 bytes are told apart (ASCII letters are folded to lower case, white space to blanks). Trees are sparse: sorted arrays of the byte
strings seen, with their code lengths, and of the contexts seen, with their escapes, 12 bytes an entry. Their size follows the
training sample, not the number of possible contexts. Each different string of four bytes in a batch is looked up once a language.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import fold, materialise, sized

ORDER = 3
#: Training reads at most so many documents of a language, by hash of doc_id.
SAMPLE_PER_LANG = 600
#: Languages the sample's documents may have; more are trained on fewer documents each.
SAMPLE_ALL = 60_000
#: Bytes of a batch that are coded at a time.
CHUNK = 1 << 21
#: Of the letter categories: marks and numbers like ² or Ⅷ aren't letters.
LETTER = regex.compile(r"\p{L}")
SPACE = 32

_BLANKS = bytes(SPACE if b in b"\t\n\x0b\x0c\r" else b for b in range(256))


def folded(text: str) -> np.ndarray:
    """Bytes of a text, ASCII letters in lower case and white space as spaces."""
    raw = text.encode("utf-8", "surrogatepass").lower().translate(_BLANKS)
    return np.frombuffer(raw, np.uint8)


def grams(marks: np.ndarray) -> np.ndarray:
    """The four bytes that end at each place as one number, the last byte lowest; spaces stand before the first."""
    padded = np.concatenate((np.full(ORDER, SPACE, np.uint32), marks.astype(np.uint32)))
    code = padded[: len(marks)].copy()
    for k in range(1, ORDER + 1):
        code = (code << np.uint32(8)) | padded[k : k + len(marks)]
    return code


def tree(codes: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Code lengths of a language from the counts of its four-byte strings: per order 0 to ORDER (strings, bits, contexts, bits of their escape)."""
    orders: list[tuple] = []
    for k in range(ORDER + 1):
        own, at = np.unique(codes & np.uint32((1 << 8 * (k + 1)) - 1), return_inverse=True)
        n = np.bincount(at, weights=counts)
        context, of = np.unique(own >> np.uint32(8), return_inverse=True)
        total, kinds = np.bincount(of, weights=n), np.bincount(of).astype(float)
        # where all bytes were seen there is nothing to escape to
        escape = np.where(kinds == 256, 0.0, kinds)
        # what is left below when the bytes seen here are ruled out
        below = np.full(len(own), 1 / 256) if not k else np.exp2(-code_bits(orders, own))
        free = np.maximum(1 - np.bincount(of, weights=below), 1e-12)
        with np.errstate(divide="ignore"):
            out = np.where(escape > 0, -np.log2(escape / (total + escape) / free), 1000.0)
        orders.append((own, -np.log2(n / (total + escape)[of]), context, out))
    return orders


def code_bits(orders: list[tuple], codes: np.ndarray) -> np.ndarray:
    """Bits of the last byte of each string after the bytes before it, under the tree of a language up to the orders given."""
    bits, left = np.zeros(len(codes)), np.arange(len(codes))
    for k in range(len(orders) - 1, -1, -1):
        own, known, context, escape = orders[k]
        code = codes[left] & np.uint32((1 << 8 * (k + 1)) - 1)
        at = np.minimum(np.searchsorted(own, code), len(own) - 1)
        hit = own[at] == code
        bits[left[hit]] += known[at[hit]]
        left, code = left[~hit], code[~hit] >> np.uint32(8)
        if not len(left):
            return bits
        at = np.minimum(np.searchsorted(context, code), len(context) - 1)
        bits[left] += np.where(context[at] == code, escape[at], 0.0)
    bits[left] += 8.0
    return bits


def text_bits(trees: list[list[tuple]], texts: list[str]) -> np.ndarray:
    """Code length of each whole text (a row) under each language (a column)."""
    out, at = np.zeros((len(texts), len(trees))), 0
    while at < len(texts):
        parts, size, to = [], 0, at
        while to < len(texts) and (not parts or size < CHUNK):
            parts.append(grams(folded(texts[to])))
            size += len(parts[-1])
            to += 1
        place, own = pd.factorize(np.concatenate(parts))
        owner = np.repeat(np.arange(to - at), [len(p) for p in parts])
        for n, orders in enumerate(trees if len(own) else []):
            out[at:to, n] = np.bincount(owner, weights=code_bits(orders, own)[place], minlength=to - at)
        at = to
    return out


class Model:
    """langs, sorted, and the context tree of each."""

    def __init__(self, langs: list[str], trees: list[list[tuple]]):
        self.langs, self.trees = langs, trees


def predictions(langs: list[str], trees: list[list[tuple]], texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, its probability) of each text."""
    told: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    asked = [n for n, t in enumerate(texts) if t and langs and LETTER.search(t)]
    bits = text_bits(trees, [texts[n] for n in asked])
    for n, row in zip(asked, bits, strict=True):
        best = int(row.argmin())
        told[n] = (langs[best], float(1.0 / np.exp2(np.maximum(row[best] - row, -1000)).sum()))
    return told


def train(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Context trees from rows of docs (doc_id, text, lang) outside the held-out fold (crc32 of doc_id mod 5 is 0), lang not null.

    At most `per_lang` documents a language and SAMPLE_ALL in all, chosen by hash of doc_id, whole texts. A hash threshold leaves little more than that many
    before any are ranked, so no language is a hot group. Without such rows there are no languages.
    """
    known = (
        docs.where("lang is not null and doc_id is not null and text is not null")
        .where(fold(docs) % 5 != 0)
        .select("doc_id", F.col("lang").alias("_lang"), F.xxhash64("doc_id").alias("h"))
    )
    sizes = sized(known.groupBy("_lang").agg(F.count("*").alias("n")).select(F.col("_lang").alias("_of"), "n"), "langid-sizes")
    share = F.pmod("h", F.lit(1 << 20)) * F.col("n") < F.lit(float(1 << 20) * (1.5 * per_lang + 50))
    nth = F.row_number().over(Window.partitionBy("_lang").orderBy("h", "doc_id"))
    chosen = (
        known.join(sizes, F.col("_lang") == F.col("_of"))
        .where(share)
        .withColumn("nth", nth)
        .where(F.col("nth") <= per_lang)
        .orderBy("nth", "_lang")
        .limit(SAMPLE_ALL)
        .select(F.col("doc_id").alias("_id"), "_lang")
        .distinct()
    )
    sample = materialise(
        docs.select("doc_id", "lang", "text")
        .join(F.broadcast(chosen), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")), "left_semi")  # SAMPLE_ALL rows at most
        .select("lang", "text"),
        "langid-sample",
    )

    def gram_counts(batches):
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                code, n = np.unique(np.concatenate([grams(folded(t)) for t in part["text"]]), return_counts=True)
                yield pd.DataFrame({"lang": lang, "code": code.astype(np.int64), "n": n.astype(np.int64)})

    # the strings of the bounded sample: about 50,000 a language
    counted = sample.mapInPandas(gram_counts, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counted["lang"].unique())
    of = [counted[counted["lang"] == x].sort_values("code") for x in langs]
    return Model(langs, [tree(x["code"].to_numpy().astype(np.uint32), x["n"].to_numpy(float)) for x in of])


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row of docs (doc_id, text, lang, any more columns): doc_id, held_out, lang_pred, score.

    lang_pred is `und` with score 0 where the text is null or has no letter, or no language was learned; ties go to the language first by code
    point. score is the probability of lang_pred among the learned languages, each as likely beforehand. Whole texts are scored, however long.
    A null doc_id is never held out (null fold counts as false). Rows that repeat get a row each; an empty table gives an empty one.
    """
    model = train(docs) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.trees))  # lists and arrays: workers need no copy of this package

    def run(batches):
        for pdf in batches:
            told = predictions(*shared.value, pdf["text"].tolist())
            yield pd.DataFrame(
                {"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "lang_pred": [x for x, _ in told], "score": [y for _, y in told]}
            )

    rows = docs.select("doc_id", F.coalesce(fold(docs) % 5 == 0, F.lit(False)).alias("held_out"), "text")
    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")
