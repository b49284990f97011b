"""Acceptance of proposed moves: what an edit's plan takes, and what becomes of its ranges and plan items.

Times are microseconds of output, but for the spans of ranges and items, which are of their recordings.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .intervals import range_join

#: Transitions nearer than this are one; a jump takes the place of those around it.
SAME_CUT_US = 50_000
#: A range may stick out of the plan item that it came from by so much.
OWNED_US = 500_000

_PLAN = ["edit_id", "kind", "start_us", "end_us", "look"]


def accept_moves(chosen: DataFrame, proposed: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log, plan): each chosen move with its outcome, and the plan with what was accepted.

    chosen: (edit_id, seq, move_id); proposed: (edit_id, move_id, kind, start_us, end_us, look); plan: (edit_id, kind, start_us, end_us, look). Kinds are element, title, punch, transition and effect;
    proposed moves can be zooms as well. A transition or zoom is at its start_us. A move chosen again counts once, at its first place; moves of equal seq come by the length of their names, then the names: m-2 before m-13.

    Outcomes: `unknown` (no such proposal); `present` (an element or title equal to one there; a transition within 50 ms of one there); `overlaps` (a punch or effect over one of its kind); `under_title` (an effect over a
    title); else `accepted`. There is what the plan had or has accepted before. A zoom removes the transitions within 50 ms of it that are there then.

    log: (edit_id, move_id, seq, kind, outcome). All rows go to their edit once, where windows put them in turn; no table is joined or written on the way, so what a run leaves on disk is one shuffle.
    """
    dealt = _in_turn(chosen, proposed, plan)

    def gone_through(step, columns: list[str], *more: StructField) -> DataFrame:
        return dealt.mapInArrow(step, StructType([*(StructField(c, dealt.schema[c].dataType) for c in columns), *more]))

    log = gone_through(_log, _LOG, StructField("outcome", StringType()))
    return log, gone_through(_updated, _PLAN)


_LOG = ["edit_id", "move_id", "seq", "kind"]


def _in_turn(chosen: DataFrame, proposed: DataFrame, plan: DataFrame) -> DataFrame:
    """(edit_id, move_id, seq, kind, start_us, end_us, look, asked, place): of each edit what its plan holds, then its chosen moves in their order, as windows leave them: an edit's rows together and by place."""
    none = lambda c, like: F.lit(None).cast(like.schema[c].dataType).alias(c)
    seq = F.col("seq").cast("long")
    rows = (
        plan.select("edit_id", none("move_id", proposed), F.lit(None).cast("long").alias("seq"), *_PLAN[1:], F.lit(0).alias("part"))
        .unionByName(proposed.select("edit_id", "move_id", F.lit(None).cast("long").alias("seq"), *_PLAN[1:], F.lit(1).alias("part")))
        .unionByName(chosen.select("edit_id", "move_id", seq.alias("seq"), *[none(c, proposed) for c in _PLAN[1:]], F.lit(2).alias("part")))
        .withColumn("asked", F.col("part") > 0)
    )
    # all by edit, so that nothing is dealt again: the rows of a move are those of equal rank in its edit
    listed = Window.partitionBy("edit_id").orderBy("asked", "move_id", "part", "seq")
    move = Window.partitionBy("edit_id").orderBy("asked", "move_id").rangeBetween(Window.currentRow, Window.currentRow)
    same = F.lag("move_id").over(listed).eqNullSafe(F.col("move_id")) & F.lag("asked").over(listed)
    told = rows.withColumn("again", F.coalesce(same, F.lit(False))).withColumns({"seq": F.min("seq").over(move), "picked": F.max("part").over(move) == 2})
    # a move stands in its proposal, or where there is none in the first row that chose it
    turns = told.where("not asked or part = 1 and picked or part = 2 and not again")
    order = Window.partitionBy("edit_id").orderBy("asked", "seq", F.length(F.col("move_id").cast("string")), "move_id", *_PLAN[1:])
    return turns.withColumn("place", F.row_number().over(order)).select("edit_id", "move_id", "seq", *_PLAN[1:], "asked", "place")


class _Spans:
    """Spans that were added, those that share more than a point as one: sorted, and only neighbours of a span can meet it."""

    def __init__(self):
        self.kept: list[tuple[int, int]] = []

    def meets(self, a: int | None, b: int | None) -> bool:
        if a is None or b is None:
            return False
        at = bisect_left(self.kept, (a, b))
        return any(lo < b and a < hi for lo, hi in self.kept[max(0, at - 1) : at + 1])

    def add(self, a: int | None, b: int | None) -> None:
        if a is None or b is None:
            return
        at = to = bisect_left(self.kept, (a, b))
        while at and self.kept[at - 1][0] < b and a < self.kept[at - 1][1]:
            at -= 1
        while to < len(self.kept) and self.kept[to][0] < b and a < self.kept[to][1]:
            to += 1
        met = self.kept[at:to]
        self.kept[at:to] = [(min(a, *[s[0] for s in met]), max(b, *[s[1] for s in met])) if met else (a, b)]


class _Edit:
    """What the plan of an edit holds while its moves are gone through. Transitions stay until the end, as a zoom may remove them; of the rest only what later moves may meet is kept."""

    def __init__(self):
        self.shown: set[tuple] = set()
        self.spans = {"title": _Spans(), "punch": _Spans(), "effect": _Spans()}
        self.cuts: list[tuple] = []

    def take(self, asked: bool, edit_id, kind: str | None, start, end, look) -> str:
        """The outcome of a move; a row of the plan is there whatever it meets."""
        if kind in ("element", "title"):
            row = kind, start, end, look
            if asked and row in self.shown:
                return "present"
            self.shown.add(row)
            if kind == "title":
                self.spans[kind].add(start, end)
        elif kind in ("punch", "effect"):
            if asked and self.spans[kind].meets(start, end):
                return "overlaps"
            if asked and kind == "effect" and self.spans["title"].meets(start, end):
                return "under_title"
            self.spans[kind].add(start, end)
        elif kind == "transition" or kind == "zoom" and asked:
            near = slice(0, 0)
            if start is not None:
                near = slice(bisect_left(self.cuts, (start - SAME_CUT_US + 1,)), bisect_left(self.cuts, (start + SAME_CUT_US,)))
            if kind == "zoom":
                del self.cuts[near]
            elif asked and self.cuts[near]:
                return "present"
            else:
                at = float("-inf") if start is None else start
                self.cuts.insert(bisect_left(self.cuts, (at + 1,)), (at, (edit_id, kind, start, end, look)))
        elif asked:
            return "unknown" if kind is None else "present"
        return "accepted"


def _outcomes(batches):
    """Each batch with (edit, outcome, its plan row) of its rows; an edit begins at place 1, and an edit of None ends the last one."""
    edit, last = None, None
    for batch in batches:
        told = []
        for place, asked, *row in zip(*(batch.column(c).to_pylist() for c in ("place", "asked", *_PLAN)), strict=True):
            if place == 1:
                edit = _Edit()
            elif last != (row[0], place - 1):
                raise RuntimeError("the rows of an edit don't stand together and in turn")
            last = row[0], place
            told.append((edit, asked, edit.take(asked, *row), row))
        yield batch, told


def _log(batches):
    for batch, told in _outcomes(batches):
        outcome = pa.array([o if asked else None for _, asked, o, _ in told], pa.string())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _LOG), outcome], [*_LOG, "outcome"]).filter(batch.column("asked"))


def _updated(batches):
    edit, kinds = None, None
    for batch, told in _outcomes(batches):
        kinds = pa.schema([batch.schema.field(c) for c in _PLAN])
        ended, stays = [], []
        for of, asked, outcome, row in told:
            if of is not edit and edit:
                ended += [r for _, r in edit.cuts]
            edit = of
            stays.append(outcome == "accepted" and row[1] not in ("transition", *["zoom"] * asked))
        yield batch.select(_PLAN).filter(pa.array(stays, pa.bool_()))
        yield _rows(ended, kinds)
    if edit:
        yield _rows([r for _, r in edit.cuts], kinds)


def _rows(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], f.type) for n, f in enumerate(kinds)], kinds.names)


def _owners(items: DataFrame, ranges: DataFrame) -> DataFrame:
    """(edit_id, item_idx, range_idx): the kept items that a range may have come from: of its picture and voice, around the span that is heard."""
    i = items.where(F.col("action").isin("keep", "tighten")).select(
        "edit_id", "item_idx", F.col("source_id").alias("seen"), F.coalesce("audio_source", "source_id").alias("heard"),
        (F.coalesce("audio_start", "start_us") - OWNED_US).alias("i_lo"), (F.coalesce("audio_end", "end_us") + OWNED_US).alias("i_hi"),
    )
    r = ranges.select(
        "edit_id", "range_idx", F.col("source_id").alias("seen"), F.coalesce("audio_source", "source_id").alias("heard"), F.coalesce("audio_start", "start_us").alias("r_lo"), F.coalesce("audio_end", "end_us").alias("r_hi")
    )
    return range_join(i, r, ["edit_id", "seen", "heard"], ("i_lo", "i_hi"), ("r_lo", "r_hi"), (F.col("r_lo") >= F.col("i_lo")) & (F.col("r_hi") <= F.col("i_hi"))).select("edit_id", "item_idx", "range_idx")


def apply_zooms(moves: DataFrame, ranges: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ranges, items, notes): accepted zooms (edit_id, seq, move_id, range_idx, zoom_pct) put on their ranges, and on the plan item behind each, so that a new compilation keeps them.

    An item takes a zoom only if it is the range's single owner and owns no other range. Of several zooms for one range or item the last holds. notes: (edit_id, move_id, outcome, item_idx, n_ranges), outcome
    `no_range`, `no_single_item` (set on the range alone), `item_spans_ranges` (likewise; n_ranges of them) or `kept`.
    """
    owned = _owners(items, ranges)
    own = owned.groupBy("edit_id", "range_idx").agg(F.count("*").alias("owners"), F.max("item_idx").alias("item_idx"))
    spread = owned.groupBy("edit_id", "item_idx").agg(F.count("*").alias("n_ranges"))
    there = ranges.select("edit_id", "range_idx", F.lit(True).alias("there"))
    met = moves.join(there, ["edit_id", "range_idx"], "left").join(own, ["edit_id", "range_idx"], "left").join(spread, ["edit_id", "item_idx"], "left")
    outcome = (
        F.when(F.col("there").isNull(), "no_range").when(F.coalesce("owners", F.lit(0)) != 1, "no_single_item").when(F.col("n_ranges") > 1, "item_spans_ranges").otherwise("kept")
    )
    met = met.withColumn("outcome", outcome)
    on_range = met.where("there").groupBy("edit_id", "range_idx").agg(F.max_by("zoom_pct", "seq").alias("_zoom"))
    on_item = met.where("outcome = 'kept'").groupBy("edit_id", "item_idx").agg(F.max_by("zoom_pct", "seq").alias("_zoom"))
    put = lambda df, by, key: df.join(by, key, "left").withColumn("zoom_pct", F.coalesce("_zoom", "zoom_pct")).select(*df.columns)
    single = F.col("outcome").isin("item_spans_ranges", "kept")
    notes = met.select("edit_id", "move_id", "outcome", F.when(single, F.col("item_idx")).alias("item_idx"), F.when(single, F.col("n_ranges")).alias("n_ranges"))
    return put(ranges, on_range, ["edit_id", "range_idx"]), put(items, on_item, ["edit_id", "item_idx"]), notes


def apply_starts(moves: DataFrame, ranges: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ranges, items, notes): accepted in-points (edit_id, seq, move_id, range_idx, video_start) put on their ranges and on all plan items behind them. Of several for one range the last holds; of
    several for one item, too. A range with another recording's voice keeps its length. notes: (edit_id, move_id, range_idx, delta_us, item_idx), item_idx where one item owns the range.
    """
    last = moves.groupBy("edit_id", "range_idx").agg(F.max_by(F.struct("move_id", "video_start", "seq"), "seq").alias("m")).select("edit_id", "range_idx", "m.*")
    owned = _owners(items, ranges)
    own = owned.groupBy("edit_id", "range_idx").agg(F.count("*").alias("owners"), F.max("item_idx").alias("item_idx"))
    met = ranges.join(last, ["edit_id", "range_idx"], "left").withColumn("delta_us", F.col("video_start") - F.col("start_us"))
    voiced = F.col("audio_source").isNotNull() & (F.col("audio_source") != F.col("source_id"))
    moved = met.withColumns(
        {"end_us": F.when(voiced, F.col("end_us") + F.coalesce("delta_us", F.lit(0))).otherwise(F.col("end_us")), "start_us": F.coalesce("video_start", "start_us")}
    ).select(*ranges.columns)
    notes = met.where("move_id is not null").join(own, ["edit_id", "range_idx"], "left").select("edit_id", "move_id", "range_idx", "delta_us", F.when(F.col("owners") == 1, F.col("item_idx")).alias("item_idx"))
    by_item = owned.join(last, ["edit_id", "range_idx"]).groupBy("edit_id", "item_idx").agg(F.max_by("video_start", "seq").alias("_start"))
    begun = items.join(by_item, ["edit_id", "item_idx"], "left").withColumn("start_us", F.coalesce("_start", "start_us")).select(*items.columns)
    return moved, begun, notes
