"""Benchmark decontamination by template canonicalisation.

Numbers, units and names of a text become typed placeholders, everything else lower-case words; windows of the
resulting templates are hashed and joined between documents and benchmark items. A window found in both at a fixed offset gives pairs
of slot values. A document repeats an item if the values of such a stretch map one to one: the same number or name of the item
always stands for the same one of the document. All values equal: an exact copy; otherwise a re-parameterised question. A value that
contradicts an earlier one ends a stretch and no more: windows before and behind it count in stretches of their own, and windows whose values are all equal count together.

A second hash of each window takes all tokens as they are but for their case, with no placeholders. It finds exact copies that are re-cased
(where names and words change places) and windows that are mostly numbers and names, which as templates would match anything.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, materialise, sized

WINDOW = 13
#: Least share of words that are no placeholders in a template window.
LITERALS = 0.5
#: An item of fewer tokens is evidence only where it makes up a whole sentence or line: "yes" stands in many texts that never saw the question.
EVIDENT = 8
#: Texts of a batch are handled this many characters at a time.
CHUNK_CHARS = 4_000_000
TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[%$€£°]|[.!?\n]")
# Units, after a number.
UNITS = frozenset(
    "% $ € £ ° mm cm m km in inch inches ft foot feet yd yard yards mi mile miles g kg mg lb lbs oz pound pounds gram grams kilogram kilograms "
    "l ml liter liters litre litres gallon gallons cup cups s sec second seconds min minute minutes h hr hour hours day days week weeks "
    "month months year years cent cents dollar dollars euro euros percent degree degrees w kw v hz j n pa k c f".split()
)
_NUMBER, _UNIT, _NAME = (np.uint64(xxhash.xxh64_intdigest(t, 7)) for t in ("<number>", "<unit>", "<name>"))
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Told apart from templates: added to the width in hashes of windows without placeholders.
_PLAIN = 1 << 32
#: What a token is by itself; whether it opens a sentence or follows a number depends on the one before.
STOP, NUMBER, UNIT, SIGN, CAPITAL = 1, 2, 4, 8, 16
MARKS = ("", "n:", "u:", "a:")


class Tokens(dict):
    """Numbers of tokens as they are met; by number: flags, hash of the word, hash without case, value as a slot."""

    def __init__(self):
        self.flags, self.words, self.plain, self.values = array("B"), array("Q"), array("Q"), []

    def __missing__(self, t: str) -> int:
        c, low = t[0], t.lower()
        if t in ".!?\n":
            flags = STOP
        elif c.isdecimal():
            flags, low = NUMBER, t.replace(",", "")
        else:
            flags = UNIT * (low in UNITS) | SIGN * (not c.isalpha()) | CAPITAL * (c.isupper() and len(t) > 1)
        self.flags.append(flags)
        self.words.append(xxhash.xxh64_intdigest(low, 7))
        self.plain.append(xxhash.xxh64_intdigest(low if low.isascii() else t.casefold(), 7))
        self.values.append(low)
        n = self[t] = len(self.values) - 1
        return n

    def clear(self):
        super().clear()
        self.__init__()


def rolling(ids: np.ndarray, widths: list[int]):
    """(width, hash of each run of so many ids) for each of the widths, which ascend."""
    h = np.zeros(len(ids), np.uint64)
    for w in range(1, min(widths[-1], len(ids)) + 1 if widths else 0):
        h = h[: len(ids) - w + 1]
        h = (h ^ (h >> np.uint64(29))) * _STEP + ids[w - 1 :]
        if w in widths:
            yield w, h ^ (h >> np.uint64(32))


def _tokens(texts, cache: Tokens):
    """(owner, place, template ids, ids without case, roles, codes, opens, closes) of the tokens of texts; roles index MARKS, 0 for words; a token opens or closes a
    sentence or line, or doesn't."""
    if len(cache) > 500_000:
        cache.clear()
    codes, counts = array("I"), []
    for text in texts:
        before = len(codes)
        codes.extend(map(cache.__getitem__, TOKEN.findall(text)) if text else ())
        counts.append(len(codes) - before)
    code = np.array(codes, np.int64)
    flags = np.array(cache.flags, np.uint8)[code]
    owner = np.repeat(np.arange(len(counts)), counts)
    before = np.concatenate((np.full(min(1, len(flags)), STOP, np.uint8), flags[:-1]))
    before[1:][owner[1:] != owner[:-1]] = STOP
    number = flags & NUMBER > 0
    unit = (flags & UNIT > 0) & ((before & NUMBER > 0) | (flags & SIGN > 0))
    name = ~unit & (flags & CAPITAL > 0) & (before & STOP == 0)
    keep = flags & STOP == 0
    after = np.concatenate((flags[1:], np.full(min(1, len(flags)), STOP, np.uint8)))
    after[:-1][owner[1:] != owner[:-1]] = STOP
    opens, closes = (before & STOP > 0)[keep], (after & STOP > 0)[keep]
    role = np.select([number, unit, name], [1, 2, 3], 0)[keep]
    code, owner = code[keep], owner[keep]
    ids = np.where(role > 0, np.array([0, _NUMBER, _UNIT, _NAME], np.uint64)[role], np.array(cache.words, np.uint64)[code])
    place = np.arange(len(owner)) - np.searchsorted(owner, np.arange(len(counts)))[owner]
    return owner, place, ids, np.array(cache.plain, np.uint64)[code], role, code, opens, closes


def _windows(keys, texts, widths, wanted, cache: Tokens):
    """Rows (key, pos, hash, plain, slots, alone) of all windows of the given widths: templates with enough words, and tokens as they are without case; alone: from the opening of
    a sentence or line to the closing of one.

    wanted: sorted hashes to keep, None for all. Plain windows have no slots.
    """
    owner, place, ids, bare, role, code, opens, closes = _tokens(texts, cache)
    slots_before = np.concatenate(([0], np.cumsum(role > 0)))
    for plain, stream in ((False, ids), (True, bare)):
        for w, h in rolling(stream, widths):
            h = (h * _STEP + np.uint64(w + _PLAIN * plain)).view(np.int64)
            n = len(h)
            ok = owner[:n] == owner[w - 1 :]
            if not plain:
                ok &= slots_before[w:] - slots_before[:n] <= (1 - LITERALS) * w
            at = np.flatnonzero(ok)
            if wanted is not None:
                if not len(wanted):
                    continue
                at = at[wanted[np.minimum(np.searchsorted(wanted, h[at]), len(wanted) - 1)] == h[at]]
            for i in at:
                slots = [] if plain else [MARKS[role[j]] + cache.values[code[j]] for j in range(i, i + w) if role[j]]
                yield keys[owner[i]], int(place[i]), int(h[i]), plain, slots, bool(opens[i] and closes[i + w - 1])


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(h, item_id, item_pos, width, plain, item_slots): all windows of the items, as templates and plain; an item shorter than a window is one by itself."""

    def run(batches):
        cache = Tokens()
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["item_id"], pdf["text"], strict=True):
                n = len(_tokens([text], cache)[0])
                w = min(n, window)
                if w:
                    rows += [(h, key, pos, w, plain, slots) for key, pos, h, plain, slots, _ in _windows([key], [text], [w], None, cache)]
            if rows:
                yield pd.DataFrame(rows, columns=["h", "item_id", "item_pos", "width", "plain", "item_slots"])

    return benchmark.select("item_id", "text").mapInPandas(run, "h long, item_id long, item_pos int, width int, plain boolean, item_slots array<string>")


def one_to_one(pairs) -> bool:
    """Whether no value of either side stands for two of the other."""
    return len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})


def longest(windows: list[set[tuple[str, str]]]) -> tuple[int, int, bool]:
    """(windows, slots, exact) of the longest stretch whose pairs (item value, document value) map one to one; (0, 0, False) if there is none.

    windows: pairs of each matching window, in order. Windows that contradict themselves are in no stretch. Those whose values are
    all equal are a stretch whatever lies between them; it wins over others that aren't longer.
    """
    exact = [w for w in windows if all(a == b for a, b in w)]
    best, slots = len(exact), len(set().union(*exact)) if exact else 0
    whole, sound = True, [w for w in windows if one_to_one(w)]
    forth: dict[str, dict[str, int]] = {}
    back: dict[str, dict[str, int]] = {}
    left = kept = 0  # kept: different pairs of the windows from left on
    for right, w in enumerate(sound):
        while any(b not in forth.get(a, (b,)) or a not in back.get(b, (a,)) for a, b in w):
            for a, b in sound[left]:
                for side, x, y in ((forth, a, b), (back, b, a)):
                    side[x][y] -= 1
                    if not side[x][y]:
                        del side[x]
                kept -= a not in forth
            left += 1
        for a, b in w:
            kept += a not in forth
            for side, x, y in ((forth, a, b), (back, b, a)):
                side.setdefault(x, {y: 0})[y] += 1
        if right + 1 - left > best:
            best, slots, whole = right + 1 - left, kept, False
    return best, slots, whole and best > 0


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, windows, slots, exact, evident): a row per document and item that it repeats in one consistent stretch or more.

    windows: windows of the longest consistent stretch at one offset; slots: different slot values in it; exact: whether all of them are equal; evident: whether the item has EVIDENT tokens
    or more, or makes up a whole sentence or line (or several) of the document. Null and
    empty texts and items without tokens repeat nothing; an item shorter than a window is found where it stands whole. Rows of one doc_id (null too) count as one document, repeated ones
    once. Texts are read whole. Without documents or items the result is empty.
    """
    spark = docs.sparkSession
    bench = materialise(benchmark_windows(benchmark, window).distinct(), "decon-benchmark")
    widths = sorted(r["width"] for r in bench.select("width").distinct().collect())  # 1 to window
    hashes = bench.select("h").distinct()
    # membership by broadcast hashes (8 bytes each) where they are counted to be few enough; else every window goes to the join
    few = hashes.count() <= BROADCAST_ROWS
    wanted = spark.sparkContext.broadcast(np.sort(np.array([r["h"] for r in hashes.collect()], np.int64)) if few else None)

    def run(batches):
        cache = Tokens()
        for pdf in batches:
            size, from_ = 0, 0
            lengths = [len(t) if t else 0 for t in pdf["text"]]
            keys, texts = pdf["doc_id"].astype("Int64").array, pdf["text"].tolist()
            for to in range(len(pdf)):
                size += lengths[to]
                if size >= CHUNK_CHARS or to == len(pdf) - 1:
                    rows = list(_windows(range(from_, to + 1), texts[from_ : to + 1], widths, wanted.value, cache))
                    if rows:
                        got = pd.DataFrame(rows, columns=["n", "doc_pos", "h", "plain", "doc_slots", "alone"])
                        n = got["n"].to_numpy()
                        row = {k: xxhash.xxh3_64_intdigest(texts[k].encode("utf-8", "surrogatepass")) for k in np.unique(n)}
                        yield got[["doc_pos", "h", "doc_slots", "alone"]].assign(doc_id=keys[n], row=np.array([row[k] for k in n], np.uint64).view(np.int64))
                    size, from_ = 0, to + 1

    seen = docs.select("doc_id", "text").mapInPandas(run, "doc_pos int, h long, doc_slots array<string>, alone boolean, doc_id long, row long")
    both = seen.join(bench, "h").where(F.size("doc_slots") == F.size("item_slots"))

    @F.pandas_udf("windows long, slots long, exact boolean")
    def judge(places: pd.Series, item: pd.Series, doc: pd.Series) -> pd.DataFrame:
        told = []
        for at, xs, ys in zip(places, item, doc, strict=True):
            pairs: dict[int, set] = {}  # a plain window has none of its own, so the two rows of a place are one
            for k, x, y in zip(at, xs, ys, strict=True):
                pairs.setdefault(k, set()).update(zip(x, y, strict=True))
            told.append(longest([pairs[k] for k in sorted(pairs)]))
        return pd.DataFrame(told, columns=["windows", "slots", "exact"])

    # a group holds the windows of one item at most, twice each
    stretches = (
        both.groupBy("doc_id", "row", "item_id", (F.col("doc_pos") - F.col("item_pos")).alias("offset"))
        .agg(F.collect_set(F.struct("item_pos", "item_slots", "doc_slots")).alias("w"), F.bool_or((F.col("width") >= EVIDENT) | F.col("alone")).alias("evident"))
        .select("doc_id", "item_id", "evident", judge("w.item_pos", "w.item_slots", "w.doc_slots").alias("best"))
        .select("doc_id", "item_id", "evident", "best.*")
        .where("windows > 0")
    )
    return (
        stretches.groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("exact", "windows", "slots")).alias("best"), F.bool_or("evident").alias("evident"))
        .select("doc_id", "item_id", "best.windows", "best.slots", "best.exact", "evident")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without those that evidently repeat an item; all columns stay, whatever their names.

    Rows with a null or empty text stay; all rows of a doc_id (null too) go if one of them repeats an item. Empty tables take nothing away.
    """
    bad = sized(find(docs, benchmark, window).where("evident").select(F.col("doc_id").alias("__llm_bad")).distinct(), "decon-found")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__llm_bad"]), "left_anti")
