"""Ranked lexical search for many items at once: what their term sets have in common is summed once for each document.

Documents become rows of term frequencies, of the items' terms only, written once. Then N, L and every df are known, and with them each term's share in a score.
Shared term sets are mined from the items: the largest intersection of two term sets becomes a node of its own, every set that holds it gets that node instead of its terms,
and so on, nodes included, until nothing is saved any more. The result is a DAG from terms over nodes to items. A task takes a block of documents, sums each
node's accumulator (a number a document) once, in order, and items add up the few nodes they are left with. Each task keeps the best of its documents;
these are merged by groups of tasks, then by item.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

#: Best documents of an item.
K = 50
#: Items that one DAG serves; more items take another pass over the documents.
ITEMS = 1024
#: Numbers that a task's block of documents takes, over terms and nodes.
CELLS = 4_000_000
#: Tasks whose best are merged before those of all are.
MERGED = 256

#: A term is a run of bytes of these kinds; all others end one. A-Z count as a-z.
_KEPT = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_KEPT).split()


class Dag:
    """nodes[i]: the members of node number `terms + i`, all of smaller number; items[name]: the members of an item."""

    def __init__(self, terms: int, nodes: list[list[int]], items: dict):
        self.terms, self.nodes, self.items = terms, nodes, items


def share(sets: dict, terms: int) -> Dag:
    """The query-sharing DAG of items' term sets (numbers below `terms`)."""
    rows = [sum(1 << t for t in s) for s in sets.values()]
    first_node, n_nodes = len(rows), 0
    heap: list[tuple[int, int, int, int]] = []

    def meet(i: int, others) -> None:
        for j in others:
            if i != j and (both := rows[i] & rows[j]) and (size := both.bit_count()) > 1:
                heapq.heappush(heap, (-size, min(i, j), max(i, j), both))

    for i in range(len(rows)):
        meet(i, range(i))
    while heap:
        _, i, j, both = heapq.heappop(heap)
        if rows[i] & rows[j] != both:
            continue  # one of the two has changed
        holders = [r for r, mask in enumerate(rows) if mask & both == both]
        size = both.bit_count()
        if len(holders) * (size - 1) <= size:
            continue  # the node would cost as many sums as it saves
        node = 1 << (terms + n_nodes)
        n_nodes += 1
        for r in holders:
            rows[r] = rows[r] & ~both | node
        rows.append(both)
        for r in (*holders, len(rows) - 1):
            meet(r, range(len(rows)))
    members = [[b for b in _bits(mask)] for mask in rows]
    # a node may have later ones as members: number them so that members come first
    place: dict[int, int] = {}

    def settle(node: int) -> None:
        stack = [node]
        while stack:
            at = stack[-1]
            open_ = [m - terms for m in members[first_node + at] if m >= terms and m - terms not in place]
            if open_:
                stack.extend(open_)
            else:
                stack.pop()
                place.setdefault(at, len(place))

    for node in range(n_nodes):
        settle(node)
    new = lambda ms: sorted(m if m < terms else terms + place[m - terms] for m in ms)
    nodes: list[list[int]] = [[]] * n_nodes
    for old, at in place.items():
        nodes[at] = new(members[first_node + old])
    return Dag(terms, nodes, {name: new(members[i]) for i, name in enumerate(sets)})


def _bits(mask: int):
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


def accumulate(dag_nodes: list[list[int]], items: list[list[int]], shares: np.ndarray) -> np.ndarray:
    """Scores (items x documents) from the terms' shares (terms x documents): every node is summed once."""
    acc = np.concatenate([shares, np.empty((len(dag_nodes), shares.shape[1]), dtype=np.int64)])
    for n, of in enumerate(dag_nodes, len(shares)):
        acc[of].sum(axis=0, out=acc[n])
    return np.stack([acc[of].sum(axis=0) for of in items]) if items else np.empty((0, shares.shape[1]), dtype=np.int64)


def frequencies(docs: DataFrame, vocabulary: dict[bytes, int], text: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs) of each document with a term: n of all its terms, numbers and frequencies of those in the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = shared.value
        for batch in batches:
            rows, n, terms, tfs = [], [], [], []
            for i, v in enumerate(batch.column(1)):
                if v.is_valid and (all_of := terms_of(v.as_buffer().to_pybytes())):
                    counts = Counter(all_of)
                    if len(counts) > len(known):
                        held = [(known[t], counts[t]) for t in known if t in counts]
                    else:
                        held = [(known[t], c) for t, c in counts.items() if t in known]
                    rows.append(i)
                    n.append(len(all_of))
                    terms.append([t for t, _ in held])
                    tfs.append([c for _, c in held])
            arrays = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


class _Best:
    """The k best (score, id) of one item, seen block by block."""

    def __init__(self, k: int):
        self.k, self.floor, self.found = k, 1, []
        self.held = 0

    def add(self, ids: np.ndarray, null: np.ndarray, scores: np.ndarray) -> None:
        at = np.flatnonzero(scores >= self.floor)
        if len(at):
            self.found.append((ids[at], null[at], scores[at]))
            self.held += len(at)
            if self.held > 16 * self.k:
                self.cut()

    def cut(self) -> tuple:
        ids, null, scores = (np.concatenate(x) for x in zip(*self.found, strict=True))
        best = np.lexsort((ids, null, -scores))[: self.k]
        self.found, self.held = [(ids[best], null[best], scores[best])], len(best)
        if len(best) == self.k:
            self.floor = int(scores[best].min())
        return self.found[0]


def _ranked(found: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(docs: DataFrame, sets: dict[int, list[bytes]], text: str, k: int) -> DataFrame:
    """search for a bounded number of items; sets: the terms of each."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for s in sets.values() for t in s}))}
    rows = materialise(frequencies(docs, vocabulary, text), "lexical-frequencies")
    n_docs, length = rows.agg(F.count("*"), F.sum("n")).first()
    df = dict(rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # a row a term of the items
    weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(vocabulary))]
    dag = share({i: {vocabulary[t] for t in s} for i, s in sets.items()}, len(vocabulary))
    names = list(dag.items)
    shared = spark.sparkContext.broadcast((np.array(weights, dtype=np.int64), dag.nodes, [dag.items[i] for i in names], names, n_docs, length))

    def run(batches):
        weights, nodes, items, names, n_docs, length = shared.value
        best = [_Best(k) for _ in names]
        size = max(1, CELLS // max(1, len(weights) + len(nodes) + len(items)))
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                n, terms, tfs = part.column(1).to_numpy(), part.column(2), part.column(3)
                held = np.diff(terms.offsets.to_numpy())
                doc, term, tf = np.repeat(np.arange(len(n)), held), terms.flatten().to_numpy(), tfs.flatten().to_numpy()
                m = 50 + (n * (50 * n_docs)) // length
                shares = np.zeros((len(weights), len(n)), dtype=np.int64)
                shares[term, doc] = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
                null = part.column(0).is_null().to_numpy(zero_copy_only=False)
                ids = part.column(0).fill_null(0).to_numpy()
                for one, scores in zip(best, accumulate(nodes, items, shares), strict=True):
                    one.add(ids, null, scores)
        for name, one in zip(names, best, strict=True):
            if one.found:
                ids, null, scores = one.cut()
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids), pa.int64()), pa.array(ids, pa.int64(), mask=null), pa.array(scores, pa.int64())], ["item_id", "doc_id", "score"])

    found = rows.mapInArrow(run, "item_id long, doc_id long, score long")
    grouped = found.withColumn("llm_group", (F.spark_partition_id() / MERGED).cast("int"))
    return _ranked(_ranked(grouped, k, "item_id", "llm_group").drop("rank"), k, "item_id")


def search(docs: DataFrame, items: DataFrame, text: str = "text", k: int = K, block: int = ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of docs (doc_id, text, any more columns) with the highest scores for each of items (item_id, text).

    Every row of docs with a term is a document, repeated rows and those with a null doc_id (last among equal scores) too; null and empty texts have no terms. An item without
    terms, or whose terms no document holds, gives no rows, and so do empty tables. Rows that repeat an item_id are one item with the terms of all; a null
    item_id is none. Texts are read whole, however long. Items are served by blocks of about `block`, chosen by hash; a block's terms are held by the driver and each task.
    """
    spark = docs.sparkSession
    n_items = items.where("item_id is not null").count()
    blocks = max(1, math.ceil(n_items / block))
    asked = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text"))
    out = None
    for b in range(blocks):
        sets: dict[int, set] = {}
        for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toLocalIterator():
            sets.setdefault(r.item_id, set()).update(terms_of((r.text or "").encode()))
        sets = {i: sorted(s) for i, s in sorted(sets.items()) if s}
        if sets:
            found = _search(docs, sets, text, k)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
