"""Near-duplicate lines: a segment-partition edit join over the distinct lines of a corpus.

Two lines link when at most EDITS insertions, deletions or replacements, and no more than one for each SHARE characters of the shorter line, turn
one into the other. A line of n characters with threshold t is indexed by the t + 1 segments it is cut into; whatever t edits do, one segment
survives in the other line, moved by no more than the edits on its
sides allow. A probe of length l therefore asks, for each indexed length down to l - EDITS and each segment, only for the few substrings
that can be that segment. Probes and index rows are hashes, joined on (length, segment, content); pairs that meet, and whose character counts
allow it, are verified on their texts by a banded bit-parallel edit distance.

What is asked for are classes: lines joined by chains of links. So a key that many different lines share (variants of one template) never
makes all of their pairs:

1. Keys with more than HEAVY index rows pair each of their lines with LEADERS lines of the key alone. With the pairs of all other keys
   this gives first classes.
2. Heavy keys that still hold two classes are taken apart. Their lines agree in a segment, so what is left of them, with what all
   of them begin and end with cut off too, is a shorter problem of the same kind: cut again, probed again, below the key it came from. Subkeys of one class go;
   those with few index rows give pairs of different classes; the heavy ones are taken apart again. Where no more is left of lines than the threshold allows to replace, they link without any look.

Each step handles a bounded number of rows per line of a heavy key, so a group of m near lines costs rows in proportion to m, and no link between two classes is lost.

Lines are known by 128-bit hashes. Texts aren't shuffled but for candidates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, components, materialise, sized

EDITS = 2
#: Characters of a line for each edit that it may differ by.
SHARE = 10
#: Index rows of a key up to which its pairs are formed at once.
HEAVY = 64
#: Lines of a heavy key that each of its lines is compared with first.
LEADERS = 4
#: Bits of a line's id that hold the parities of its character counts; an edit flips two at most.
PARITIES = 24


def allowed(length: int, edits: int = EDITS, share: int = SHARE) -> int:
    """Edits that a line of so many characters may differ by from a line at least as long."""
    return min(edits, length // share)


def cuts(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of the edits + 1 segments of a line; the last ones are longer by one where it doesn't divide."""
    n = edits + 1
    short, longer = n - length % n, length // n
    starts = [k * longer + max(0, k - short) for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(starts, starts[1:], strict=False)]


def spots(length: int, indexed: int, edits: int) -> list[tuple[int, int, int]]:
    """(segment, start, length) of the substrings a line of `length` probes for lines of `indexed` <= length characters.

    Before segment k at most k edits count (an earlier segment would have survived otherwise), behind it at most edits - k; the
    lengths' difference must be made up on either side.
    """
    gap, out = length - indexed, []
    for k, (p, n) in enumerate(cuts(indexed, edits)):
        lo = max(p - k, p + gap - (edits - k), 0)
        hi = min(p + k, p + gap + (edits - k), length - n)
        out += [(k, at, n) for at in range(lo, hi + 1)]
    return out


def distance_within(a: str, b: str, most: int) -> int:
    """Edit distance of a and b, or most + 1 if it is greater. Bit vectors hold the 2 * most + 1 cells around the diagonal."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    lead = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[lead : len(a) - tail], b[lead : len(b) - tail]
    if not a or not b:
        return max(len(a), len(b))
    # cell k of column j is row j - most + k; rows over the top have the distance of their column
    width = 2 * most + 1
    full = (1 << width) - 1
    seen: dict[str, int] = {}
    for i, c in enumerate(a):
        seen[c] = seen.get(c, 0) | 1 << i
    n, m = len(a), len(b)
    # column 0: row i costs i; rows above row 0 fall towards it
    plus, minus = full & ~((1 << (most + 1)) - 1), (1 << (most + 1)) - 1
    score = most  # of the lowest cell: row `most` of column 0
    for j, c in enumerate(b, 1):
        first = j - most  # row of cell 0
        eq = seen.get(c, 0)
        eq = eq >> (first - 1) if first >= 1 else eq << (1 - first)
        eq &= full
        if first < 1:
            # rows at or over the top: one more than the column before along the row, so equal along the diagonal's other side
            eq &= ~((1 << (1 - first)) - 1) & full
        plus, minus = plus >> 1 | 1 << (width - 1), minus >> 1
        zero = (((eq & plus) + plus) ^ plus) & full | eq | minus
        right_up, right_down = minus | (full & ~(zero | plus)), zero & plus
        score += 0 if zero >> (width - 1) & 1 else 1
        over, under = right_up << 1 & full | 1, right_down << 1 & full
        plus, minus = under | (full & ~(zero | over)), over & zero
        if score > 3 * most + abs(n - m) + 2:
            return most + 1
    # walk up the last column from its lowest cell to row n
    row = m + most
    for k in range(width - 1, -1, -1):
        if row == n:
            break
        score += (minus >> k & 1) - (plus >> k & 1)
        row -= 1
    return min(score, most + 1)


def _lines(text: str | None) -> list[str]:
    return text.split("\n") if text else []


def _row_key() -> list:
    """Columns that tell documents apart, whether ids repeat or are null: rows with equal id and text are one document."""
    return [F.col("doc_id"), F.xxhash64("doc_id", "text").alias("row")]


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, row, line_no, h1, h2) of every line that isn't blank; h1, h2: its 128-bit hash."""

    def run(batches):
        for pdf in batches:
            out = []
            for d, r, text in zip(pdf["doc_id"].astype("Int64").array, pdf["row"], pdf["text"], strict=True):
                for n, line in enumerate(_lines(text)):
                    if line and not line.isspace():
                        out.append((d, r, n, line_hash(line)))
            if not out:
                continue
            got = pd.DataFrame(out, columns=["doc_id", "row", "line_no", "h"])
            h = np.frombuffer(b"".join(got.pop("h")), ">i8").reshape(-1, 2).astype(np.int64)
            yield got.assign(doc_id=got["doc_id"].astype("Int64"), h1=h[:, 0], h2=h[:, 1])

    return docs.select(*_row_key(), "text").mapInPandas(run, "doc_id long, row long, line_no int, h1 long, h2 long")


def line_hash(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def line_ids(lines: list[str]) -> np.ndarray:
    """Search ids: 40 bits of each line's hash, then the parities of its counts of characters by code point mod PARITIES."""
    ids = np.frombuffer(b"".join(line_hash(x)[:8] for x in lines), ">i8").astype(np.int64) & ~np.int64((1 << PARITIES) - 1)
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) % PARITIES
    owner = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    odd = np.bincount(owner * PARITIES + points, minlength=len(lines) * PARITIES).reshape(-1, PARITIES) & 1
    return ids | (odd << np.arange(PARITIES)).sum(axis=1)


def _chunks(texts, chars: int = 1_000_000):
    """Lists of the different lines in a batch, about `chars` characters a list."""
    out, size, seen = [], 0, set()
    for text in texts:
        for line in _lines(text):
            if line and line not in seen and not line.isspace():
                seen.add(line)
                out.append(line)
                size += len(line)
                if size >= chars:
                    yield out
                    out, size = [], 0
    if out:
        yield out


def places(n: int, edits: int, probes: bool) -> list[tuple[int, int, int, bool]]:
    """(start, end, seed, straight) of the substrings of a line of n characters that it is indexed by, or that it probes with.

    The seed tells indexed length and segment; straight: the substring stands where it does in the indexed line. Straight probes for a line's own length
    are its index rows, and are left out.
    """
    if not probes:
        t = allowed(n, edits)
        return [(p, p + w, (n << 8) | k, True) for k, (p, w) in enumerate(cuts(n, t))] if t else []
    out = []
    for d in range(edits + 1):
        t = allowed(n - d, edits)
        if t and d <= t:
            own = cuts(n - d, t)
            out += [(p, p + w, ((n - d) << 8) | k, p == own[k][0]) for k, p, w in spots(n, n - d, t) if d or p != own[k][0]]
    return out


def _keys(docs: DataFrame, edits: int, probes: bool) -> DataFrame:
    """(key, id): index rows, or probes, of the lines of docs. A line that repeats inside a batch is taken once."""

    def run(batches):
        digest, known = xxhash.xxh3_64_intdigest, {}
        for pdf in batches:
            for lines in _chunks(pdf["text"]):
                keys, counts = [], []
                for line in lines:
                    at = known.get(len(line))
                    if at is None:
                        at = known[len(line)] = places(len(line), edits, probes)
                    keys += [digest(line[a:b].encode("utf-8", "surrogatepass"), seed) for a, b, seed, _ in at]
                    counts.append(len(at))
                yield pd.DataFrame({"key": np.array(keys, np.uint64).view(np.int64), "id": np.repeat(line_ids(lines), counts)})

    return docs.select("text").mapInPandas(run, "key long, id long")


def _may_link(a: str, b: str, edits: int):
    """Whether two ids differ and their parities allow a link."""
    mask = F.lit((1 << PARITIES) - 1).cast("long")
    return (F.col(a) != F.col(b)) & (F.bit_count(F.col(a).bitwiseXOR(F.col(b)).bitwiseAND(mask)) <= 2 * edits)


def candidates(docs: DataFrame, edits: int = EDITS, heavy: int = HEAVY) -> tuple[DataFrame, DataFrame]:
    """(pairs, rows): pairs (a, b), a < b, of search ids that meet in a key of at most `heavy` index rows or with a leader of another; and
    the rows (key, id, probe) of those other keys."""
    index = materialise(_keys(docs, edits, False).distinct(), "lines-index")
    full = sized(index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > heavy).select("key"), "lines-heavy")
    # a heavy key stands in the index by one row without id: what probes it is met once, and listed
    listed = index.join(full, "key", "left_anti").unionByName(full.select("key", F.lit(None).cast("long").alias("id")))
    probes = _keys(docs, edits, True).unionByName(index.join(full, "key", "left_anti")).withColumnRenamed("id", "other")
    met = probes.join(listed, "key").where(F.col("id").isNull() | _may_link("id", "other", edits))
    met = materialise(
        met.select(
            F.when(F.col("id").isNull(), F.col("key")).alias("key"),
            F.coalesce(F.least("id", "other"), F.col("other")).alias("a"),
            F.when(F.col("id").isNotNull(), F.greatest("id", "other")).alias("b"),
        ).distinct(),
        "lines-met",
    )
    rows = index.join(full, "key", "left_semi").withColumn("probe", F.lit(False)).unionByName(
        met.where("b is null").select("key", F.col("a").alias("id"), F.lit(True).alias("probe"))
    )
    rows = materialise(rows, "lines-rows")
    leaders = rows.where(~F.col("probe")).groupBy("key").agg(
        *[F.min(F.struct(F.xxhash64("id", F.lit(n)), "id"))["id"].alias(f"l{n}") for n in range(LEADERS)]
    )
    led = rows.join(sized(leaders, "lines-leaders"), "key").select("id", F.explode(F.array_distinct(F.array(*[f"l{n}" for n in range(LEADERS)]))).alias("other"))
    led = led.where(_may_link("id", "other", edits)).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    return met.where("b is not null").select("a", "b").unionByName(led).distinct(), rows


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, h1, line) of the lines whose search ids are wanted."""
    few = wanted.count() <= BROADCAST_ROWS
    listed = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r["id"] for r in wanted.collect()], np.int64)) if few else None)

    def run(batches):
        among = listed.value
        for pdf in batches:
            for lines in _chunks(pdf["text"]):
                ids = line_ids(lines)
                keep = np.arange(len(ids))
                if among is not None:
                    at = np.minimum(np.searchsorted(among, ids), max(0, len(among) - 1))
                    keep = keep[among[at] == ids] if len(among) else keep[:0]
                if not len(keep):
                    continue
                h1 = [int.from_bytes(line_hash(lines[k])[:8], signed=True) for k in keep]
                yield pd.DataFrame({"id": ids[keep], "h1": np.array(h1, np.int64), "line": [lines[k] for k in keep]})

    texts = docs.select("text").mapInPandas(run, "id long, h1 long, line string")
    if not few:
        texts = texts.join(wanted, "id", "left_semi")
    return texts.dropDuplicates(["id", "h1"])


def _verified(pairs: DataFrame, texts: DataFrame, by: str, edits: int) -> DataFrame:
    """(a, b), a < b: h1 of the pairs, given by the column `by` of texts, whose lines link."""
    side = lambda c, x: texts.select(F.col(by).alias(c), F.col("h1").alias(f"{c}1"), F.col("line").alias(x))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        most = [allowed(min(len(p), len(q)), edits) for p, q in zip(x, y, strict=True)]
        return pd.Series([distance_within(p, q, t) <= t for p, q, t in zip(x, y, most, strict=True)], dtype=bool)

    return both.where(near("x", "y")).select(F.least("a1", "b1").alias("a"), F.greatest("a1", "b1").alias("b")).where("a <> b").distinct()


_STATE = "key long, probe boolean, h1 long, id long, class long, rest string, t int, straight boolean"


def _opened(rows: DataFrame, edits: int) -> DataFrame:
    """Rows (key, probe, h1, id, class, line) of heavy keys with what the line has beside the substring that gave the key."""

    def run(batches):
        for pdf in batches:
            out = []
            for key, probe, h1, i, of, line in zip(*(pdf[c] for c in pdf.columns), strict=True):
                for a, b, seed, straight in places(len(line), edits, probe):
                    if xxhash.xxh3_64_intdigest(line[a:b].encode("utf-8", "surrogatepass"), seed) == key % (1 << 64):
                        out.append((key, probe, h1, i, of, line[:a] + line[b:], allowed(seed >> 8, edits), straight))
            if out:
                yield pd.DataFrame(out, columns=[x.split()[0] for x in _STATE.split(", ")])

    return rows.select("key", "probe", "h1", "id", "class", "line").mapInPandas(run, _STATE)


def common(lo: str, hi: str) -> int:
    """Length of the common prefix."""
    n = 0
    for x, y in zip(lo, hi, strict=False):
        if x != y:
            break
        n += 1
    return n


def _cut_again(rows: DataFrame) -> DataFrame:
    """State rows of the subkeys of heavy keys. rows: state rows with n, head and tail, the length of index rows and what all rows begin and end with.

    An index row is indexed again, and probes where segments are shifted; a probe probes."""

    def run(batches):
        for pdf in batches:
            out = []
            for key, probe, h1, i, of, rest, t, straight, n, head, tail in zip(*(pdf[c] for c in pdf.columns), strict=True):
                core, m = rest[head : len(rest) - tail], n - head - tail
                own = cuts(m, t)
                places = [(True, k, p, w) for k, p, w in spots(len(core), m, t) if probe or p != own[k][0]]
                for asks, k, p, w in places if probe else places + [(False, k, p, w) for k, (p, w) in enumerate(own)]:
                    below = xxhash.xxh3_64_intdigest(core[p : p + w].encode("utf-8", "surrogatepass"), (key * 31 + k + 1) % (1 << 64))
                    below -= (below >> 63) << 64
                    out.append((below, asks, h1, i, of, core[:p] + core[p + w :], t, straight and p == own[k][0]))
            if out:
                yield pd.DataFrame(out, columns=[x.split()[0] for x in _STATE.split(", ")])

    columns = [*[x.split()[0] for x in _STATE.split(", ")], "n", "head", "tail"]
    return rows.select(*columns).mapInPandas(run, _STATE)


def between_classes(state: DataFrame, edits: int = EDITS, heavy: int = HEAVY) -> tuple[list[DataFrame], list[DataFrame]]:
    """(pairs to verify, links) of h1 of different classes that share a heavy key: takes keys apart until each is small, done or all links."""
    head = F.pandas_udf(lambda a, b: pd.Series([common(x, y) for x, y in zip(a, b, strict=True)], dtype="int32"), "int")
    pairs, links = [], []
    while True:
        state = materialise(state.distinct(), "lines-state")
        keys = (
            state.groupBy("key")
            .agg(
                F.count_if(~F.col("probe")).alias("index_rows"), F.min("class").alias("one"), F.max("class").alias("two"),
                F.max(F.when(~F.col("probe"), F.length("rest"))).alias("n"), F.min(F.length("rest")).alias("least"),
                F.min("rest").alias("lo"), F.max("rest").alias("hi"), F.min(F.reverse("rest")).alias("back_lo"), F.max(F.reverse("rest")).alias("back_hi"),
                F.min(F.when(~F.col("probe"), F.col("h1"))).alias("leader"), F.min("t").alias("most"),
            )
            .where("one < two and index_rows > 0")
        )
        keys = keys.withColumn("head", head("lo", "hi")).withColumn("tail", F.least(head("back_lo", "back_hi"), F.col("least") - F.col("head")))
        few = F.col("index_rows") <= heavy
        done = F.col("n") - F.col("head") - F.col("tail") <= F.col("most")
        keys = sized(
            keys.select("key", "n", "head", "tail", "leader", F.when(few, "few").when(done, "done").otherwise("cut").alias("what")), "lines-keys"
        )
        met = materialise(state.join(keys, "key"), "lines-state")
        same = (F.col("what") == "done") & F.col("straight") & (F.length("rest") - F.col("head") - F.col("tail") <= F.col("t"))
        stars = met.where(same & (F.col("h1") != F.col("leader")))
        links.append(stars.select(F.col("h1").alias("a"), F.col("leader").alias("b")).distinct())
        index = met.where("not probe and what <> 'cut'").select("key", F.col("h1").alias("a"), F.col("id").alias("ia"), F.col("class").alias("other"))
        asking = met.where((F.col("what") != "cut") & ~same).select("key", F.col("h1").alias("b"), F.col("id").alias("ib"), "class")
        pairs.append(
            asking.join(index, "key")
            .where((F.col("other") != F.col("class")) & _may_link("ia", "ib", edits))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct()
        )
        left = met.where("what = 'cut'")
        if left.isEmpty():
            return pairs, links
        state = _cut_again(left)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def groups(docs: DataFrame, edits: int = EDITS, heavy: int = HEAVY) -> DataFrame:
    """(node, component): h1 of every line that has a link, and the smallest h1 that chains of links reach from it."""
    found, rows = candidates(docs, edits, heavy)
    pairs = materialise(found, "lines-candidates")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(rows.select("id"))
    texts = materialise(_texts(docs, materialise(ids.distinct(), "lines-wanted")), "lines-texts")
    as_edges = lambda df: df.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    first = materialise(components(as_edges(_verified(pairs, texts, "id", edits))), "lines-groups")
    if rows.isEmpty():
        return first
    of = texts.join(first, texts["h1"] == first["node"], "left").select("id", "h1", "line", F.coalesce("component", "h1").alias("class"))
    asked, links = between_classes(_opened(rows.join(of, "id"), edits), edits, heavy)
    more = _verified(materialise(_union(asked).distinct(), "lines-candidates"), texts.dropDuplicates(["h1"]), "h1", edits).unionByName(_union(links))
    return materialise(components(as_edges(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))), "lines-groups")


def classes(docs: DataFrame, edits: int = EDITS) -> tuple[DataFrame, DataFrame]:
    """(occurrences, lines): lines has a row per different line, (h1, h2, first, near): the first place of its class, and whether it links with another line.

    A class joins equal lines and, by chains of links, near ones. Places order by doc_id (null first), row and line number.
    """
    found = materialise(occurrences(docs), "lines-found")
    place = F.struct("doc_id", "row", "line_no")
    each = materialise(found.groupBy("h1", "h2").agg(F.min(place).alias("first")), "lines-each")
    linked = each.join(groups(docs, edits).withColumnRenamed("node", "h1"), "h1")
    firsts = linked.groupBy("component").agg(F.min("first").alias("class_first"))
    moved = linked.join(firsts, "component").select(F.col("h1").alias("n1"), F.col("h2").alias("n2"), "class_first")
    lines = each.join(moved, (F.col("h1") == F.col("n1")) & (F.col("h2") == F.col("n2")), "left").select(
        "h1", "h2", F.coalesce("class_first", "first").alias("first"), F.col("n1").isNotNull().alias("near")
    )
    return found, materialise(lines, "lines-classes")


def line_classes(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """(doc_id, line_no, class_doc, class_line, near): a row for every line of docs (doc_id, text, any more columns) that isn't blank.

    class_doc and class_line say where the class of the line stands first, near whether a different line is within its threshold: classes are given
    as membership, not as pairs. Lines end at \\n; line_no counts from 0. Lines under SHARE characters are in a class with equal lines alone. Null and
    empty texts have no lines; rows that repeat id and
    text have their lines listed each time; a null doc_id orders first; an empty table gives an empty one.
    """
    found, lines = classes(docs, edits)
    return found.join(lines, ["h1", "h2"]).select(
        "doc_id", "line_no", F.col("first.doc_id").alias("class_doc"), F.col("first.line_no").alias("class_line"), "near"
    )


def dedup(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """docs with every line left out that isn't the first of its class; n_chars, if there, follows the text.

    Blank lines stay. Documents stay, even if no line does (their text is then empty); a null text stays null, an empty one empty. Rows that repeat id and text
    are treated alike: they keep the same lines. An empty table gives an empty one. All columns stay, whatever their names.
    """
    found, lines = classes(docs, edits)
    gone = (
        found.join(lines, ["h1", "h2"])
        .where(~F.struct("doc_id", "row", "line_no").eqNullSafe(F.col("first")))
        .select(F.col("doc_id").alias("__llm_d"), F.col("row").alias("__llm_r"), "line_no")
        .distinct()
        .groupBy("__llm_d", "__llm_r")
        .agg(F.collect_list("line_no").alias("__llm_gone"))
    )

    @F.pandas_udf("string")
    def rest(text: pd.Series, out: pd.Series) -> pd.Series:
        kept = []
        for t, gone in zip(text, out, strict=True):
            away = set(gone) if gone is not None else ()
            kept.append("\n".join(x for n, x in enumerate(t.split("\n")) if n not in away) if away and t else t)
        return pd.Series(kept, dtype=object)

    keyed = docs.withColumn("__llm_row", F.xxhash64("doc_id", "text"))
    joined = keyed.join(gone, (F.col("__llm_row") == F.col("__llm_r")) & F.col("doc_id").eqNullSafe(F.col("__llm_d")), "left")
    cut = joined.withColumn("text", F.when(F.col("__llm_gone").isNull(), F.col("text")).otherwise(rest("text", "__llm_gone")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("__llm_gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return cut.select(*docs.columns)
