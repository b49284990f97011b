"""Byte-pair encoding and decoding by tree concatenation.

A text is cut into pieces as the tokenizer file says. A piece of up to LEAF symbols is merged as it is; a longer one is halved down to leaves, each leaf is
encoded by itself, and neighbours are joined: a window of tokens around the join is encoded anew and grows until its first token is the left side's and
its last one the right side's. Then every two neighbours in the joined sequence stand so in some encoding, and such a sequence is the encoding of the whole.

Documents of SPREAD characters or more are cut into parcels that are dealt over the cluster, one piece's parts among them; they come together again
by document, where the parts of a piece are joined pairwise as a tree.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialise, parts

#: Symbols that are merged at once.
LEAF = 32
#: Characters from which on a document is dealt over tasks, and of one parcel of it.
SPREAD = 65_536
PARCEL = 16_384
#: Pieces and runs that a worker remembers in each of two generations.
REMEMBERED = 200_000
#: Bytes of text or ids after which a worker hands on what it has: memory follows this and the longest text, not the rows of a batch.
HANDED = 4_000_000

#: What the settings of a tokenizer file must be for the quick cut into pieces; any others are left to the library's normaliser and pre-tokeniser.
_QUICK_NORMALIZERS = ("NFC", "Replace", "Lowercase")
#: Outside of this, nothing composes, letters, numbers and case are the same in every Unicode version, and str.split cuts at the pattern's white space.
_UNSETTLED = re.compile("[\x1c-\x1fɐ-\U0010ffff]")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: its own, or the next one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def load(path: str) -> dict:
    """Tables of a BPE tokenizer file, as plain data that can be broadcast; its size is that of the vocabulary.

    Byte-level BPE without dropout, unknown token or byte fallback is supported; added tokens must be found anywhere in the raw text.
    """
    with open(path, encoding="utf-8") as f:
        whole = f.read()
    told = json.loads(whole)
    model = told["model"]
    if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "byte_fallback", "ignore_merges", "continuing_subword_prefix")):
        raise ValueError("only byte-level BPE without dropout, unknown token or byte fallback")
    if any(t[k] for t in told["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens with conditions aren't supported")
    if told.get("decoder"):
        raise ValueError("files with a decoder aren't supported: tokens are joined by blanks")
    vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
    ranks = {}
    for rank, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        ranks[vocab[a], vocab[b]] = (rank, vocab[a + b])
    added = {t["content"]: t["id"] for t in told["added_tokens"]}
    names = {n: t for t, n in vocab.items()} | {n: t for t, n in added.items()}
    letters = byte_letters()
    steps = (told.get("normalizer") or {}).get("normalizers", [])
    cuts = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
    quick = (
        tuple(s["type"] for s in steps) == _QUICK_NORMALIZERS
        and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
        and cuts[0]["invert"] and cuts[0]["behavior"] == "Removed" and "Regex" in cuts[0]["pattern"]
        and not cuts[1]["use_regex"] and not cuts[1]["add_prefix_space"]
    )
    return {
        "ranks": ranks,
        "names": [names.get(n, "") for n in range(max(names) + 1)],
        "inner": [vocab[c] for c in letters],
        "last": [vocab[c + end] for c in letters],
        "added": added,
        "pattern": cuts[0]["pattern"]["Regex"] if quick else None,
        "file": whole,
        "codes": {},
        "older": {},
    }


def merge(symbols: list[int], ranks: dict) -> list[int]:
    """The pair of lowest rank, leftmost first, is merged until none is left."""
    if len(symbols) > LEAF:
        return _merge_long(symbols, ranks)
    out = list(symbols)
    none = (1 << 60, -1)
    pairs = [ranks.get(p, none) for p in zip(out, out[1:])]
    while pairs:
        best = min(pairs)
        if best is none:
            break
        at = pairs.index(best)
        out[at : at + 2] = [best[1]]
        del pairs[at]
        if at:
            pairs[at - 1] = ranks.get((out[at - 1], out[at]), none)
        if at < len(pairs):
            pairs[at] = ranks.get((out[at], out[at + 1]), none)
    return out


def _merge_long(symbols: list[int], ranks: dict) -> list[int]:
    """merge by a heap over a linked list: n log n for windows that grow large."""
    out = list(symbols)
    after, before = list(range(1, len(out) + 1)), list(range(-1, len(out) - 1))
    heap = [(*ranks[p], i, *p) for i, p in enumerate(zip(out, out[1:])) if p in ranks]
    heap = [(rank, i, new, a, b) for rank, new, i, a, b in heap]
    heapq.heapify(heap)
    while heap:
        _, i, new, a, b = heapq.heappop(heap)
        j = after[i]
        if out[i] != a or j >= len(out) or out[j] != b:
            continue  # merged meanwhile
        out[i], out[j], after[i] = new, -1, after[j]
        if after[j] < len(out):
            before[after[j]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < len(out) and (found := ranks.get((out[x], out[y]))):
                heapq.heappush(heap, (found[0], x, found[1], out[x], out[y]))
    return [t for t in out if t >= 0]


def join(left: list, right: list, symbols_of, ranks: dict) -> list:
    """The encoding of two neighbouring stretches from their own encodings. symbols_of(tokens): the symbols that they were merged from."""
    i = j = 1
    while left and right:
        i, j = min(i, len(left)), min(j, len(right))
        window = merge(symbols_of(left[-i:] + right[:j]), ranks)
        agree_left, agree_right = i == len(left) or window[0] == left[-i], j == len(right) or window[-1] == right[j - 1]
        if agree_left and agree_right:
            return left[: len(left) - i] + window + right[j:]
        i, j = (i if agree_left else 2 * i), (j if agree_right else 2 * j)
    return left + right


def tree(encoded: list[list[int]], symbols_of, ranks: dict) -> list[int]:
    """Neighbouring encodings joined pairwise until one is left."""
    while len(encoded) > 1:
        encoded = [join(*encoded[k : k + 2], symbols_of, ranks) if k + 1 < len(encoded) else encoded[k] for k in range(0, len(encoded), 2)]
    return encoded[0] if encoded else []


class Encoder:
    """Encodes pieces with the tables that `load` gave. Lives in a worker."""

    def __init__(self, tables: dict):
        self.t, self.ranks, self.codes = tables, tables["ranks"], tables["codes"]
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(tables["added"], key=len, reverse=True))) + ")") if tables["added"] else None
        self.library = self.quick = self._spelt = self._ends = None
        if tables["pattern"]:
            import regex

            self.quick = regex.compile(tables["pattern"].replace(r"^\s", r"^\t-\r \x85\xa0"))

    def pieces(self, text: str) -> list[str]:
        """The pieces of a whole text, added tokens whole. No piece holds a blank."""
        if not self.added:
            return self._cut(text)
        return [p for n, part in enumerate(self.added.split(text)) for p in ([part] if n % 2 else self._cut(part))]

    def _cut(self, text: str) -> list[str]:
        if self.quick and not _UNSETTLED.search(text):
            return self.quick.findall(text.lower())
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.t["file"])
            self._spelt = {c: b for b, c in enumerate(byte_letters())}
        normal = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        return [bytes(map(self._spelt.__getitem__, p)).decode() for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def leaves(self, data: bytes, last: bool) -> list[list[int]]:
        """A stretch of a piece, halved down to LEAF bytes, each leaf encoded; last: the piece ends here."""
        if len(data) > LEAF:
            half = len(data) // 2
            return self.leaves(data[:half], False) + self.leaves(data[half:], last)
        return [merge([self.t["inner"][b] for b in data[:-1]] + [self.t["last" if last else "inner"][data[-1]]], self.ranks)] if data else []

    def symbols_of(self, tokens: list[int]) -> list[int]:
        """The symbols of neighbouring tokens; a token that ends a piece says so itself."""
        if self._ends is None:
            spelt = {c: b for b, c in enumerate(byte_letters())}
            last = set(self.t["last"]) - set(self.t["inner"])
            suffix = next((self.t["names"][n][1:] for n in last), "")
            self._ends = {}
            for n, name in enumerate(self.t["names"]):
                ends = bool(suffix) and name.endswith(suffix)
                body = name[: -len(suffix)] if ends else name
                if body and all(c in spelt for c in body):
                    of = [self.t["inner"][spelt[c]] for c in body]
                    self._ends[n] = of[:-1] + [self.t["last"][spelt[body[-1]]]] if ends else of
        return [s for t in tokens for s in self._ends[t]]

    def stretch(self, data: bytes, last: bool) -> list[int]:
        return tree(self.leaves(data, last), self.symbols_of, self.ranks)

    def piece(self, piece: str) -> bytes:
        """Ids of one piece, packed; remembered if it's short."""
        got = self._known(piece)
        if got is None:
            ids = [self.t["added"][piece]] if piece in self.t["added"] else self.stretch(piece.encode(), True)
            got = self._remember(piece, pack(ids))
        return got

    def _remember(self, key: str, ids: bytes) -> bytes:
        if len(key) <= LEAF:
            if len(self.codes) >= REMEMBERED:
                self.t["older"] = dict(self.codes)
                self.codes.clear()
            self.codes[key] = ids
        return ids

    def _known(self, key: str) -> bytes | None:
        got = self.codes.get(key)
        if got is None and (got := self.t["older"].get(key)) is not None:
            self._remember(key, got)
        return got

    def _run(self, run: str) -> bytes:
        """Ids of a run without white space. A piece is a run that is cut into itself, so both are remembered together."""
        got = self._known(run)
        return got if got is not None else self._remember(run, b"".join(map(self.piece, self.quick.findall(run))))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.quick and not _UNSETTLED.search(text) and not (self.added and self.added.search(text)):
            runs = text.lower().split()
            found = list(map(self.codes.get, runs))
            return b"".join(map(self._run, runs) if None in found else found)
        return self.encode_pieces(self.pieces(text))

    def encode_pieces(self, pieces: list[str]) -> bytes:
        found = list(map(self.codes.get, pieces))
        if None in found:
            found = list(map(self.piece, pieces))
        return b"".join(found)

    def parcels(self, text: str, size: int):
        """(piece, part, last, text) of one long document: runs of ordinary pieces, up to `size` characters and joined by blanks, have part -1; a piece of
        more bytes than `size` comes in parts, as the characters that stand for its bytes."""
        run, length, n = [], 0, 0
        for p in self.pieces(text):
            if len(p) <= size and len(data := p.encode()) <= size:
                run.append(p)
                length += len(p) + 1
                if length < size:
                    continue
            if run:
                yield n, -1, True, " ".join(run)
                run, length, n = [], 0, n + 1
            if len(p) > size or len(data) > size:
                data = p.encode()
                for at in range(0, len(data), size):
                    yield n, at // size, at + size >= len(data), data[at : at + size].decode("latin-1")
                n += 1
        if run:
            yield n, -1, True, " ".join(run)

    def parcel(self, part: int, last: bool, text: str) -> bytes:
        return self.encode_pieces(text.split(" ")) if part < 0 else pack(self.stretch(text.encode("latin-1"), last))

    def gather(self, found: list[tuple[int, int, bytes]]) -> bytes:
        """Ids of a document from its encoded parcels, (piece, part, ids) in order."""
        out, at = [], 0
        while at < len(found):
            to = at + 1
            while to < len(found) and found[to][0] == found[at][0]:
                to += 1
            out.append(found[at][2] if to == at + 1 else pack(tree([unpack(f[2]) for f in found[at:to]], self.symbols_of, self.ranks)))
            at = to
        return b"".join(out)


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.asarray(ids, dtype="<u4").tobytes()


def unpack(packed: bytes) -> list[int]:
    return np.frombuffer(packed, dtype="<u4").tolist()


def _handed(batches, column: str, f, kind: pa.DataType, drop: bool):
    """Each batch in slices of about HANDED bytes of `column`, with f(value) as the last column; drop: without `column`."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // HANDED
        edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), batch.num_rows]
        for at, to in zip(edges, edges[1:]):
            part = batch.slice(at, to - at)
            made = pa.array([f(v.as_py()) for v in part.column(column)], kind)
            kept = [n for n in part.schema.names if not (drop and n == column)]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), made], [*kept, "llm_made"])


def _added(df: DataFrame, column: str, make, name: str, kind, drop: bool = False) -> DataFrame:
    """df with the column `name` = f(`column`) at its end, by slices; make() gives f in the worker."""
    kept = df.drop(name)
    fields = [f for f in kept.schema.fields if not (drop and f.name == column)]
    schema = T.StructType([*fields, T.StructField("llm_made", kind)])
    arrow = pa.binary() if kind == T.BinaryType() else pa.string()
    return kept.mapInArrow(lambda batches: _handed(batches, column, make(), arrow, drop), schema).withColumnRenamed("llm_made", name)


def encode(docs: DataFrame, tokenizer: str | dict, text: str = "text", keep_text: bool = True, spread: int = SPREAD, parcel: int = PARCEL) -> DataFrame:
    """docs with `ids`, binary: the token ids of each whole text, little-endian unsigned 32-bit integers (a column of that name is replaced).

    tokenizer: path of a tokenizer file, read on the driver, or what `load` made of it. Strings of added tokens in a text are those tokens; none is added. Null
    and empty texts have no ids. Very long texts are dealt over tasks by parcels; one document's ids come together in one row. Repeated rows get a row each, an
    empty table gives an empty one, other columns pass through; without keep_text the text doesn't.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load(tokenizer) if isinstance(tokenizer, str) else tokenizer)  # as large as the vocabulary
    length = F.coalesce(F.length(text), F.lit(0))
    short = _added(docs.where(length < spread), text, lambda: Encoder(shared.value).encode, "ids", T.BinaryType(), not keep_text)

    def cut(batches):
        made = Encoder(shared.value)
        for pdf in batches:
            for row, t in zip(pdf["llm_row"], pdf["llm_text"], strict=True):
                some = []
                for p in made.parcels(t, parcel):
                    some.append((row, *p))
                    if len(some) == 64:
                        yield pd.DataFrame(some, columns=["llm_row", "piece", "part", "last", "body"])
                        some = []
                if some:
                    yield pd.DataFrame(some, columns=["llm_row", "piece", "part", "last", "body"])

    def each(batches):
        made = Encoder(shared.value)
        for pdf in batches:
            pdf["ids"] = [made.parcel(p, e, t) for p, e, t in zip(pdf["part"], pdf["last"], pdf["body"], strict=True)]
            yield pdf[["llm_row", "piece", "part", "ids"]]

    def gathered(pdf):
        pdf = pdf.sort_values(["piece", "part"])
        whole = Encoder(shared.value).gather(list(zip(pdf["piece"], pdf["part"], pdf["ids"], strict=True)))
        return pd.DataFrame({"llm_row": pdf["llm_row"].iloc[:1], "ids": [whole]})

    others = [F.col(f"`{c}`") for c in docs.columns if c != "ids" and (keep_text or c != text)]
    kept = materialise(docs.where(length >= spread).select(F.struct(*others).alias("llm_doc"), F.col(text).alias("llm_text"), F.monotonically_increasing_id().alias("llm_row")), "bpe-long")
    cuts = kept.select("llm_row", "llm_text").mapInPandas(cut, "llm_row long, piece long, part long, last boolean, body string")
    found = cuts.repartition(parts(spark), "llm_row", "piece", "part").mapInPandas(each, "llm_row long, piece long, part long, ids binary")
    whole = found.groupBy("llm_row").applyInPandas(gathered, "llm_row long, ids binary")
    long = kept.join(whole, "llm_row", "left").select("llm_doc.*", F.coalesce("ids", F.lit(b"")).alias("ids"))  # a long blank text has no parcel
    return short.unionByName(long)


def decode(df: DataFrame, tokenizer: str | dict, ids: str = "ids") -> DataFrame:
    """df with `decoded`: the names of the tokens in `ids`, joined by blanks, as a file without a decoder has it. Null stays null, no ids give an empty text."""
    tables = load(tokenizer) if isinstance(tokenizer, str) else tokenizer
    shared = df.sparkSession.sparkContext.broadcast(tables["names"])

    def make():
        names = shared.value
        return lambda p: None if p is None else " ".join(map(names.__getitem__, unpack(p)))

    return _added(df, ids, make, "decoded", T.StringType())


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: encoded, then decoded from its ids."""
    tables = load(tokenizer)
    both = decode(encode(docs.select("doc_id", "text"), tables, keep_text=False), tables)
    n = (F.length("ids") / 4).cast("long")
    return both.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))

