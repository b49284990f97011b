"""Plans compiled item by item: several recordings an edit, voices under other pictures, an order of their own, refusals as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .acoustics import acoustic_edges
from .anchors import words_in
from .cuts import PIECE_US, join_seams, snap_ranges
from .intervals import merge, subtract

QUOTE_CHARS = 300
#: A voice may outlast its picture by so much.
VOICE_TOLERANCE_US = 1_000
#: Smallest share of normal speed that a picture can be slowed to.
SLOWEST_PCT = 25


def disjoint_cuts(cuts: DataFrame) -> DataFrame:
    """(source_id, cut_id, cut_start, cut_end): cuts that touch or overlap as one, with all their ids; kept once a recording, however many edits use it."""
    spans = merge(cuts.select("source_id", F.col("cut_start").alias("start_us"), F.col("cut_end").alias("end_us")), ["source_id"])
    order = Window.partitionBy("source_id").orderBy("at", F.desc("opens"))
    opened = spans.select("source_id", F.col("start_us").alias("at"), F.lit(True).alias("opens"), F.struct("start_us", "end_us").alias("span"), F.lit(None).cast("string").alias("cut_id"))
    each = cuts.select("source_id", F.col("cut_start").alias("at"), F.lit(False).alias("opens"), F.lit(None).cast("struct<start_us:bigint,end_us:bigint>").alias("span"), F.col("cut_id").cast("string").alias("cut_id"))
    owned = opened.unionByName(each).withColumn("span", F.last("span", ignorenulls=True).over(order)).where("not opens")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "cut_id"))), lambda c: c["cut_id"]), ",")
    return owned.groupBy("source_id", "span").agg(ids.alias("cut_id")).select("source_id", "cut_id", F.col("span.start_us").alias("cut_start"), F.col("span.end_us").alias("cut_end"))


def compile_items(
    items: DataFrame, cuts: DataFrame, words: DataFrame, recordings: DataFrame, frames: DataFrame | None = None, min_gap_us: int = 300_000, padding_us: int = 80_000
) -> tuple[DataFrame, DataFrame]:
    """(ranges, refusals) of plans whose items come from any recordings.

    items: (edit_id, item_idx, order_no, action, source_id, start_us, end_us, audio_source, audio_start, audio_end, speed_pct, zoom_pct, beat); cuts: (source_id, cut_id,
    cut_start, cut_end). Items that are kept or tightened become ranges in the order of order_no, or else of item_idx. Each is snapped to the words of the recording that is heard, and with
    `frames` on to where the voice begins and ends. An item heard from its own recording loses the cuts inside it and may become several ranges; one with another's voice runs as long as that voice.
    Neighbours of one take then meet at seams.

    ranges: (edit_id, range_idx, item_idx, source_id, start_us, end_us, audio_source, audio_start, audio_end, speed_pct, zoom_pct, beat, quote, cut_ids, transition_in). refusals:
    (edit_id, item_idx, problem, at_least_us, at_most_pct): no_transcript, voice_outlasts_picture (with the end, and the speed if one is slow enough, that would do), nothing_left (no item). An edit
    with a refusal has no ranges.

    Edits share the work on a recording: what becomes of a stretch of it (`_stretches`) is found once, whatever number of items ask for it. Stretches go to the items where they were weighed to be light enough
    (`_met`): then items go to their edit once, and all that concerns a whole edit is windows there.
    """
    kept = _kept(items, frames is not None)
    cut = _cut(_stretches(kept, words, recordings, frames, padding_us), cuts)
    edit, order = Window.partitionBy("edit_id"), Window.partitionBy("edit_id").orderBy("place", "item_idx", "piece")
    every = _held(kept, written(_quoted(cut, words), "quoted-stretches")).withColumn("refused", F.max(F.col("problem").isNotNull()).over(edit)).where("not refused")
    each = every.withColumn("p", F.explode("pieces")).select("*", F.col("p.piece").alias("piece"))
    told = each.select(
        "edit_id", "item_idx", "source_id", F.when(F.col("own"), F.col("p.s_start")).otherwise(F.col("start_us")).alias("start_us"), F.when(F.col("own"), F.col("p.s_end")).otherwise(F.col("until")).alias("end_us"),
        "audio_source", F.when(~F.col("own"), F.col("low")).alias("audio_start"), F.when(~F.col("own"), F.col("high")).alias("audio_end"), F.col("speed_pct").alias("_speed"), "zoom_pct", "beat",
        F.coalesce("p.quote", F.lit("")).alias("quote"), F.col("p.cut_ids").alias("cut_ids"), (F.row_number().over(order) - 1).cast("long").alias("range_idx"),
        # a range with another's voice, like one at another speed, is no part of a take
        F.when(F.col("own"), F.col("speed_pct")).otherwise(0).alias("speed_pct"),
    )
    ranges = join_seams(told, min_gap_us).withColumn("speed_pct", F.col("_speed")).select(
        "edit_id", "range_idx", "item_idx", "source_id", "start_us", "end_us", "audio_source", "audio_start", "audio_end", "speed_pct", "zoom_pct", "beat", "quote", "cut_ids", "transition_in"
    )
    return ranges, _refusals(items, kept, cut)


def compile_refusals(items: DataFrame, cuts: DataFrame, words: DataFrame, recordings: DataFrame, frames: DataFrame | None = None, padding_us: int = 80_000) -> DataFrame:
    """The refusals of `compile_items` alone, without what is said in the ranges."""
    kept = _kept(items, frames is not None)
    return _refusals(items, kept, _cut(_stretches(kept, words, recordings, frames, padding_us), cuts))


#: What tells stretches of recordings apart: whose, from where to where, whether seen too, and the most that a voice under a picture may last.
ASKED = ["heard", "lo", "hi", "own", "most"]
#: Stretches that weigh at most so many bytes go to the items: so much for a row and for each of its pieces, besides their texts.
SENT_BYTES, ROW_BYTES, PIECE_BYTES = 128 << 20, 96, 72


def _picture() -> Column:
    """How long a picture is seen."""
    return F.floor((F.col("end_us") - F.col("start_us")) * 100 / F.col("speed_pct"))


def _kept(items: DataFrame, framed: bool) -> DataFrame:
    """Items that are kept or tightened, with what they ask for (ASKED) and their place."""
    voiced = F.col("audio_source").isNotNull()
    return items.where(F.col("action").isin("keep", "tighten")).select(
        "edit_id", "item_idx", F.coalesce("order_no", "item_idx").alias("place"), "source_id", "start_us", "end_us", "audio_source", "speed_pct", "zoom_pct", "beat",
        F.coalesce("audio_source", "source_id").alias("heard"), F.when(voiced, F.col("audio_start")).otherwise(F.col("start_us")).alias("lo"), F.when(voiced, F.col("audio_end")).otherwise(F.col("end_us")).alias("hi"),
        (~voiced).alias("own"), F.when(voiced & F.lit(framed), _picture()).cast("long").alias("most"),
    )


def _met(pieces: DataFrame) -> DataFrame:
    """A table of stretches (ASKED, pieces) read from files, to be broadcast if it is light; else it meets the items by a shuffle, whatever Spark takes its files for."""
    of = pieces.select(*[F.col(c).alias("_" + c) for c in ASKED], F.lit(True).alias("known"), "low", "high", "pieces")
    texts = [F.coalesce(F.octet_length(f), F.lit(0)) for f in ("p.cut_ids", *(["p.quote"] if "quote" in of.schema["pieces"].dataType.elementType.names else []))]
    rows = of.select(F.explode_outer("pieces").alias("p")).agg(F.sum(F.lit(ROW_BYTES + PIECE_BYTES) + reduce(Column.__add__, texts)))
    return F.broadcast(of) if (rows.first()[0] or 0) <= SENT_BYTES else of.hint("merge")


def _held(kept: DataFrame, pieces: DataFrame) -> DataFrame:
    """Items with the pieces of their stretch, with the end of a picture as long as its voice (until), the share of the speed that would do (slower), and with their problem, if there is one."""
    voice = F.col("high") - F.col("low")
    alike = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col("_" + c)) for c in ASKED])
    outlasts = ~F.col("own") & (voice > _picture() + VOICE_TOLERANCE_US)
    problem = F.when(F.col("known").isNull(), "no_transcript").when(outlasts, "voice_outlasts_picture")
    until = F.col("start_us") + F.floor(voice * F.col("speed_pct") / 100)
    slower = F.floor((F.col("end_us") - F.col("start_us")) * 100 / voice)
    return kept.join(_met(pieces), alike, "left").select(*kept.columns, "low", "high", "pieces", until.alias("until"), slower.alias("slower"), problem.alias("problem"))


def _refusals(items: DataFrame, kept: DataFrame, cut: DataFrame) -> DataFrame:
    none = F.lit(None).cast("long")
    told = _held(kept, cut)
    late = F.col("problem") == "voice_outlasts_picture"
    refused = told.where("problem is not null").select("edit_id", "item_idx", "problem", F.when(late, F.col("until")).alias("at_least_us"), F.when(late & (F.col("slower") >= SLOWEST_PCT), F.col("slower")).alias("at_most_pct"))
    settled = told.where("problem is not null or size(pieces) > 0").select("edit_id").distinct()
    left = items.select("edit_id").distinct().join(settled, "edit_id", "left_anti")
    return refused.unionByName(left.select("edit_id", none.alias("item_idx"), F.lit("nothing_left").alias("problem"), none.alias("at_least_us"), none.alias("at_most_pct")))


def _stretches(kept: DataFrame, words: DataFrame, recordings: DataFrame, frames: DataFrame | None, padding_us: int) -> DataFrame:
    """What items ask for (ASKED) of the recordings that are known, with low and high: the stretch after snapping. Written first, as items are many and the different stretches few."""
    asked = written(kept.select(*ASKED).distinct(), "asked-stretches")
    spans = asked.select(F.col("heard").alias("source_id"), F.col("lo").alias("start_us"), F.col("hi").alias("end_us")).where("start_us is not null and end_us is not null").distinct()
    spans = spans.join(recordings.select("source_id"), "source_id", "left_semi")
    met = words.join(spans.select("source_id").distinct(), "source_id", "left_semi")
    snapped = snap_ranges(spans, met, recordings)
    moved = snapped.select(F.col("source_id").alias("heard"), F.col("start_us").alias("lo"), F.col("end_us").alias("hi"), F.col("snap_start").alias("low"), F.col("snap_end").alias("high"))
    if frames is not None:
        id = F.concat_ws("-", "heard", "lo", "hi")
        ranges = moved.select(id.alias("edit_id"), F.lit(0).cast("long").alias("range_idx"), F.col("heard").alias("source_id"), F.col("low").alias("start_us"), F.col("high").alias("end_us"))
        edges = acoustic_edges(ranges, met, frames, recordings, padding_us).select("edit_id", F.col("start_us").alias("low"), F.col("end_us").alias("high"))
        moved = moved.drop("low", "high").withColumn("edit_id", id).join(edges, "edit_id").drop("edit_id")
    out = asked.join(moved, ["heard", "lo", "hi"], "left").join(recordings.select(F.col("source_id").alias("heard")), "heard", "left_semi")
    high = F.when(F.col("most").isNotNull(), F.least("high", F.col("low") + F.col("most"))).otherwise(F.col("high"))
    return written(out.select(*ASKED, "low", high.alias("high")), "compiled-stretches")


def _cut(stretches: DataFrame, cuts: DataFrame) -> DataFrame:
    """stretches with pieces (piece, s_start, s_end, cut_ids): what the cuts leave of one that is seen too, a voice as a whole."""
    spans = stretches.where("own and low is not null").select("heard", "low", "high").distinct()
    whole = spans.select(F.col("heard").alias("source_id"), F.col("heard").alias("of"), F.col("low").alias("start_us"), F.col("high").alias("end_us"), "low", "high")
    left = subtract(whole, disjoint_cuts(cuts), "source_id", ["of", "low", "high"], PIECE_US)
    piece = F.struct("piece", F.col("start_us").alias("s_start"), F.col("end_us").alias("s_end"), F.array_join("cut_ids", ",").alias("cut_ids"))
    per = left.groupBy(F.col("source_id").alias("heard"), "low", "high").agg(F.array_sort(F.collect_list(piece)).alias("_left"))
    one = F.array(F.struct(F.lit(0).cast("long").alias("piece"), F.col("low").alias("s_start"), F.col("high").alias("s_end"), F.lit("").alias("cut_ids")))
    none = F.array().cast("array<struct<piece:bigint,s_start:bigint,s_end:bigint,cut_ids:string>>")
    pieces = F.when(F.col("low").isNull(), none).when(F.col("own"), F.coalesce("_left", none)).otherwise(one)
    return written(stretches.join(per, ["heard", "low", "high"], "left").select(*ASKED, "low", "high", pieces.alias("pieces")), "cut-stretches")


def _quoted(stretches: DataFrame, words: DataFrame) -> DataFrame:
    """stretches with what is said in each of their pieces."""
    rows = stretches.select("*", F.explode("pieces").alias("p")).select("heard", "p.s_start", "p.s_end").distinct()
    asked = rows.select(F.col("heard").alias("source_id"), "s_start", "s_end", F.concat_ws("-", "heard", "s_start", "s_end").alias("span_id"))
    met = words.join(asked.select("source_id").distinct(), "source_id", "left_semi")
    quotes = words_in(asked, met).select("span_id", F.substring("quote", 1, QUOTE_CHARS).alias("quote"))
    each = stretches.select(*ASKED, "low", "high", F.explode_outer("pieces").alias("p")).withColumn("span_id", F.concat_ws("-", "heard", "p.s_start", "p.s_end")).join(quotes, "span_id", "left")
    piece = F.when(F.col("p").isNotNull(), F.struct("p.piece", "p.s_start", "p.s_end", "p.cut_ids", "quote"))
    return each.groupBy(*ASKED, "low", "high").agg(F.collect_list(piece).alias("pieces"))
