"""SimHash near-duplicates: fingerprints, links at few differing bits, and their components.

Candidate search embeds a fingerprint as the bit counts of its two-bit segments. The Manhattan distance of two such vectors
never exceeds the Hamming distance, and of three differing bits one 32-bit half holds at most one. So two linked
fingerprints have, in one of the halves, grid cells (16 counts of 0 to 2) that are equal or one step apart in one segment.
The grid range join probes a fingerprint's own cell and the steps upwards from it; a probe meets the steps
downwards from the other side. The join's condition then counts the differing bits exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import components, materialise

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the whole text as a signed integer; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones, digest, join = np.zeros(64, np.int64), xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, CHUNK):
        part = words[at : min(n, at + CHUNK) + shingle - 1]
        grams = zip(*(part[k:] for k in range(shingle))) if len(words) >= shingle else [part]
        hashes = np.fromiter((digest(join(g), SEED) for g in grams), ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for every row of docs."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": np.array([fingerprint(t, shingle) for t in pdf["text"]], np.int64)})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, fp long")


def _counts(half: Column) -> Column:
    """Bit counts of the sixteen two-bit segments of a 32-bit number, two bits each."""
    return half - F.shiftright(half, 1).bitwiseAND(F.lit(0x55555555).cast("long"))


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints (column fp) within `radius` (3 at most) differing bits."""
    if radius > 3:
        raise ValueError("one half holds at most one of three differing bits, not of more")
    mask = F.lit(0xFFFFFFFF).cast("long")
    halves = distinct.select(
        "fp", F.posexplode(F.array(F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(mask))).alias("half", "bits")
    ).select("fp", F.col("half").cast("long").alias("half"), _counts(F.col("bits")).alias("cell"))
    tag = lambda c: F.shiftleft(F.col("half"), 32).bitwiseOR(c)
    own = halves.select(tag(F.col("cell")).alias("cell"), F.col("fp").alias("b"))
    steps = [
        F.when(F.shiftright("cell", 2 * j).bitwiseAND(F.lit(3)) < 2, F.col("cell") + F.lit(1 << (2 * j)).cast("long")) for j in range(16)
    ]
    probes = halves.select(
        F.col("fp").alias("a"), F.posexplode(F.array(tag(F.col("cell")), *[tag(s) for s in steps])).alias("step", "cell")
    ).where("cell is not null")
    near = probes.join(own, "cell").where(
        (F.col("a") != F.col("b")) & ((F.col("step") > 0) | (F.col("a") < F.col("b"))) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    )
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """Per row of docs (doc_id, text, any more columns): doc_id, fp, component_id.

    component_id is the smallest doc_id that can be reached over links, itself included; equal fingerprints are linked. Null and
    empty texts have fingerprint 0. A row with null doc_id takes part and never gives the id of a component, unless all of its
    ids are null. An empty table gives an empty one.
    """
    marked = materialise(fingerprints(docs, shingle), "simhash-fp")
    classes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    groups = components(links(classes, radius).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    rooted = classes.join(groups, classes["fp"] == groups["node"], "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component")
    )
    least = rooted.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_fp = rooted.join(least, "component").select("fp", "component_id")
    return marked.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """docs with one document of each component, that of the smallest doc_id; all columns stay.

    Rows that repeat the kept doc_id count as the same document: one row stays. Rows with a null doc_id have no identity and stay.
    """
    found = near_duplicates(docs, radius, shingle).where(F.col("doc_id") == F.col("component_id"))
    ids = found.select(F.col("doc_id").alias("__llm_kept")).distinct()
    once = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    return (
        docs.join(ids, docs["doc_id"] == ids["__llm_kept"], "left")
        .where("__llm_kept is not null or doc_id is null")
        .withColumn("__llm_nth", F.row_number().over(once))
        .where("__llm_nth = 1 or doc_id is null")
        .select(*[docs[c] for c in docs.columns])
    )
