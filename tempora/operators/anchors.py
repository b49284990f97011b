"""Moves tied to words and to moments of a recording, story edits, briefs, and the smaller plan rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ends_sentence, word_key
from .intervals import range_join


def anchor_to_words(moves: DataFrame, anchored: DataFrame) -> DataFrame:
    """moves (edit_id, move_id, key, occurrence) with at_us, the start of that occurrence among anchored words; error where it isn't said."""
    at = anchored.select("edit_id", "key", "occurrence", F.col("out_start").alias("at_us"))
    return moves.join(at, ["edit_id", "key", "occurrence"], "left").withColumn("error", F.when(F.col("at_us").isNull(), "not said"))


def anchor_to_sources(moves: DataFrame, line: DataFrame, lead_us: int = 0) -> DataFrame:
    """moves (edit_id, move_id, source_id, at_us) with out_us: the first output instant of a source moment, less a lead; error where it was removed."""
    p = moves.withColumn("_e", F.col("at_us"))
    r = line.select("edit_id", "source_id", "range_idx", "start_us", "end_us", "output_start", "speed_pct")
    inside = (F.col("at_us") >= F.col("start_us")) & (F.col("at_us") <= F.col("end_us"))
    hit = range_join(p, r, ["edit_id", "source_id"], ("at_us", "_e"), ("start_us", "end_us"), inside)
    out = F.col("output_start") + F.floor((F.col("at_us") - F.col("start_us")) * 100 / F.col("speed_pct"))
    first = hit.groupBy("edit_id", "move_id").agg(F.min_by(out, "range_idx").alias("o"))
    got = moves.join(first, ["edit_id", "move_id"], "left")
    return got.select(*moves.columns, F.greatest(F.lit(0), F.col("o") - lead_us).alias("out_us"), F.when(F.col("o").isNull(), "removed").alias("error"))


def place_end_teasers(moves: DataFrame, durations: DataFrame) -> DataFrame:
    """moves (edit_id, move_id, seconds_us) at the last `seconds_us` before the content ends (edit_id, content_end)."""
    return moves.join(durations, "edit_id").select("edit_id", "move_id", F.greatest(F.lit(0), F.col("content_end") - F.col("seconds_us")).alias("start_us"), F.col("content_end").alias("end_us"))


def hold_end_cards(cards: DataFrame, durations: DataFrame, most_us: int = 10_000_000) -> DataFrame:
    """cards (edit_id, card_no, seconds_us) laid end to end after the content, those that would pass `most_us` of holding left out."""
    order = Window.partitionBy("edit_id").orderBy("card_no").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("seconds_us").over(order)
    laid = cards.withColumn("upto", upto).where(F.col("upto") <= most_us).join(durations, "edit_id")
    return laid.select("edit_id", "card_no", (F.col("content_end") + F.col("upto") - F.col("seconds_us")).alias("start_us"), (F.col("content_end") + F.col("upto")).alias("end_us"))


def shift_plan(moves: DataFrame, shots: DataFrame) -> DataFrame:
    """moves (edit_id, move_id, start_us, end_us) after the first shot's length changed (edit_id, old_us, new_us): later ones move along, those inside are clipped, what is left under 0.1 s goes."""
    df = moves.join(shots, "edit_id")
    later, delta = F.col("start_us") >= F.col("old_us"), F.col("new_us") - F.col("old_us")
    start = F.when(later, F.col("start_us") + delta).otherwise(F.least("start_us", "new_us"))
    end = F.when(later | (F.col("end_us") > F.col("old_us")), F.col("end_us") + delta).otherwise(F.least("end_us", "new_us"))
    return df.select("edit_id", "move_id", start.alias("start_us"), end.alias("end_us")).where(F.col("end_us") - F.col("start_us") >= 100_000)


def story_plan(lines: DataFrame, sources: DataFrame, hold_us: int = 1_250_000) -> DataFrame:
    """One muted shot per story line (edit_id, line_no, sentence, clip, at_us, hold_us): (edit_id, range_idx, source_id, start_us, end_us, beat, problem).

    clip is an id or a file's stem (sources: source_id, stem, duration_us).
    """
    by_id = sources.select(F.col("source_id").alias("clip"), "source_id", "duration_us")
    by_stem = sources.select(F.col("stem").alias("clip"), "source_id", "duration_us").join(by_id.select("clip"), "clip", "left_anti")
    df = lines.join(by_id.unionByName(by_stem), "clip", "left")
    end = F.col("at_us") + F.coalesce("hold_us", F.lit(hold_us))
    problem = F.when(F.col("source_id").isNull(), "unknown clip").when(end > F.col("duration_us"), "past the end")
    order = Window.partitionBy("edit_id").orderBy("line_no")
    return df.select("edit_id", (F.row_number().over(order) - 1).cast("long").alias("range_idx"), "source_id", F.col("at_us").alias("start_us"), end.alias("end_us"), F.col("sentence").alias("beat"), problem.alias("problem"))


def brief_labels(rows: DataFrame, seconds_us: int = 3_000_000) -> DataFrame:
    """A label per on-screen text of a brief (brief_id, row_idx, start_us, on_screen array) after the first, of 48 characters at most."""
    each = rows.select("brief_id", "row_idx", "start_us", F.posexplode("on_screen").alias("pos", "label"))
    order = Window.partitionBy("brief_id").orderBy("row_idx", "pos")
    return each.withColumn("nth", F.row_number().over(order)).where("nth > 1 and length(label) <= 48").select("brief_id", "row_idx", "pos", "label", "start_us", (F.col("start_us") + seconds_us).alias("end_us"))


def unspoken_first_line(lines: DataFrame, words: DataFrame) -> DataFrame:
    """(source_id, line, unspoken): shown only if under 60 % of its words are among the first n + 4 heard. lines: (source_id, line)."""
    wanted = lines.withColumn("ws", F.filter(F.transform(F.split("line", r"\s+"), word_key), lambda x: x != "")).withColumn("n", F.size("ws"))
    heard = words.join(wanted.select("source_id", "n"), "source_id").where(F.col("idx") < F.col("n") + 4).groupBy("source_id").agg(F.collect_set(word_key(F.col("word"))).alias("heard"))
    df = wanted.join(heard, "source_id", "left")
    common = F.size(F.filter("ws", lambda x: F.array_contains(F.coalesce("heard", F.array().cast("array<string>")), x)))
    return df.select("source_id", "line", (common * 10 < F.col("n") * 6).alias("unspoken"))


def number_steps(cues: DataFrame, steps: DataFrame) -> DataFrame:
    """cues (edit_id, cue_idx, text) with step and text numbered: the longest step phrase (phrase, number) at the start of a cue. One equi-join on the first word."""
    keys = F.filter(F.transform(F.split("text", r"\s+"), word_key), lambda x: x != "")
    c = cues.withColumn("_k", keys).withColumn("_head", F.try_element_at("_k", F.lit(1)))
    s = steps.select("number", F.transform(F.split("phrase", " "), word_key).alias("_p")).withColumn("_head", F.col("_p")[0])
    hit = c.join(s, "_head").where(F.slice("_k", 1, F.size("_p")) == F.col("_p")).groupBy("edit_id", "cue_idx").agg(F.max_by("number", F.size("_p")).alias("step"))
    df = cues.join(hit, ["edit_id", "cue_idx"], "left")
    prefix = F.concat(F.col("step").cast("string"), F.lit(". "))
    return df.withColumn("text", F.when(F.col("step").isNotNull() & ~F.startswith("text", F.concat(F.col("step").cast("string"), F.lit("."))), F.concat(prefix, "text")).otherwise(F.col("text")))


def merge_lexicon(base: DataFrame, project: DataFrame) -> DataFrame:
    """(category, phrase, n_words): a project's category replaces the base one, others stay; phrases in lower case."""
    kept = base.join(project.select("category").distinct(), "category", "left_anti").unionByName(project)
    p = F.regexp_replace(F.trim(F.lower("phrase")), r"\s+", " ")
    return kept.select("category", p.alias("phrase")).distinct().withColumn("n_words", F.size(F.split("phrase", " ")))


def words_in(spans: DataFrame, words: DataFrame) -> DataFrame:
    """(span_id, quote): the words wholly inside a span (source_id, span_id, s_start, s_end)."""
    inside = (F.col("start_us") >= F.col("s_start")) & (F.col("end_us") <= F.col("s_end"))
    hit = range_join(spans, words.select("source_id", "idx", "word", "start_us", "end_us"), ["source_id"], ("s_start", "s_end"), ("start_us", "end_us"), inside)
    return hit.groupBy("span_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"]), " ").alias("quote"))


def is_multi_source(items: DataFrame) -> DataFrame:
    """(edit_id, multi): whether a plan keeps from more than its primary source. items: (edit_id, source_id, primary_id, action)."""
    return items.where(F.col("action") != "drop").groupBy("edit_id").agg(F.bool_or(F.col("source_id") != F.col("primary_id")).alias("multi"))


def lost_fixes(ranges: DataFrame, fixes: DataFrame) -> DataFrame:
    """Fixes (edit_id, range_idx, zoom_pct) that a recompiled edit no longer carries."""
    now = ranges.select("edit_id", "range_idx", F.col("zoom_pct").alias("_now"))
    return fixes.join(now, ["edit_id", "range_idx"], "left").where(F.col("_now").isNull() | (F.col("_now") != F.col("zoom_pct"))).select("edit_id", "range_idx", "zoom_pct")


def stats(words: DataFrame) -> DataFrame:
    """(source_id, idx, number, label): numbers said, years aside, 12 characters at most, with up to five words of their sentence after them."""
    order = Window.partitionBy("source_id").orderBy("idx").rowsBetween(1, 5)
    ahead = F.collect_list(F.struct("word", ends_sentence(F.col("word")).alias("e"))).over(order)
    n = F.regexp_replace("word", r"^\p{P}+|[.,;:!?]+$", "")
    is_number, year = n.rlike(r"^\d+([.,]\d+)?%?$"), n.rlike(r"^(19|20)\d\d$")
    stop = F.array_position(F.transform("ahead", lambda w: w["e"]), F.lit(True))
    take = F.when(stop > 0, stop).otherwise(F.size("ahead")).cast("int")
    label = F.array_join(F.transform(F.slice("ahead", F.lit(1), take), lambda w: w["word"]), " ")
    return words.withColumn("ahead", ahead).where(is_number & ~year & (F.length(n) <= 12)).select("source_id", "idx", n.alias("number"), F.when(F.size("ahead") > 0, label).otherwise("").alias("label"))


def caption_features(cues: DataFrame) -> DataFrame:
    """(edit_id, features): what a track of cues (edit_id, text, speaker, n_words) can carry."""
    per = cues.groupBy("edit_id").agg(F.count_distinct("speaker").alias("s"), F.max("n_words").alias("w"), F.bool_or(F.col("text").rlike(r"\d")).alias("d"))
    return per.select("edit_id", F.array_join(F.array_compact(F.array(F.when(F.col("s") > 1, "speakers"), F.when(F.col("w") > 1, "karaoke"), F.when(F.col("d"), "numbers"))), ",").alias("features"))


def translation_problems(cues: DataFrame, translated: DataFrame, max_chars: int) -> DataFrame:
    """(edit_id, cue_idx, problem): cues without translation, translations without cue, empty or too long ones, and moved times over 1 ms."""
    a = cues.select("edit_id", "cue_idx", "start_us", "end_us")
    b = translated.select("edit_id", "cue_idx", F.col("start_us").alias("s2"), F.col("end_us").alias("e2"), F.col("text").alias("t2"))
    df = a.join(b, ["edit_id", "cue_idx"], "full")
    both = F.col("start_us").isNotNull() & F.col("s2").isNotNull()
    moved = both & ((F.abs(F.col("start_us") - F.col("s2")) > 1000) | (F.abs(F.col("end_us") - F.col("e2")) > 1000))
    problems = F.array_compact(
        F.array(
            F.when(F.col("s2").isNull(), "missing"), F.when(F.col("start_us").isNull(), "unknown"), F.when(moved, "moved"), F.when(F.trim("t2") == "", "empty"), F.when(F.length("t2") > max_chars, "too long")
        )
    )
    return df.select("edit_id", "cue_idx", F.explode(problems).alias("problem"))


def apply_translation(cues: DataFrame, translated: DataFrame, max_chars: int) -> tuple[DataFrame, DataFrame]:
    """(cues, problems): tracks in another language on the times of the original, for edits whose translation has no problem at all; see `translation_problems`.

    White space in translations is evened out first. cues: (edit_id, cue_idx, start_us, end_us, text); their words get times by `estimated_words`.
    """
    even = translated.withColumn("text", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")))
    problems = translation_problems(cues, even, max_chars).join(even.select("edit_id").distinct(), "edit_id", "left_semi")
    sound = even.join(problems.select("edit_id").distinct(), "edit_id", "left_anti").select("edit_id", "cue_idx", "text")
    return cues.select("edit_id", "cue_idx", "start_us", "end_us").join(sound, ["edit_id", "cue_idx"]), problems


def weak_sources(sources: DataFrame) -> DataFrame:
    """(source_id, cover_pct, bpp_milli): recordings enlarged 1.5 times or more, or under 0.05 bits a pixel. sources: (source_id, width, height, canvas_w, canvas_h, bit_rate, fps)."""
    cover = F.floor(F.greatest(F.col("canvas_w") * 100 / F.col("width"), F.col("canvas_h") * 100 / F.col("height")))
    bpp = F.floor(F.col("bit_rate") * 1000 / (F.col("width") * F.col("height") * F.col("fps")))
    return sources.withColumns({"cover_pct": cover, "bpp_milli": bpp}).where("cover_pct >= 150 or bpp_milli < 50").select("source_id", "cover_pct", "bpp_milli")


def weighted_enlargement(ranges: DataFrame) -> DataFrame:
    """(edit_id, source_id, enlargement_pct): zoom weighted by seconds shown."""
    us = F.col("end_us") - F.col("start_us")
    return ranges.groupBy("edit_id", "source_id").agg(F.floor(F.sum(us * F.col("zoom_pct")) / F.sum(us)).alias("enlargement_pct"))


def sample_times(spans: DataFrame, most: int = 10) -> DataFrame:
    """(edit_id, n, at_us): `most` moments spread over an edit's spans in proportion to their length: the middles of equal parts of their joined length."""
    order = Window.partitionBy("edit_id").orderBy("start_us", "end_us").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum(F.col("end_us") - F.col("start_us")).over(order)
    laid = spans.withColumn("upto", upto).withColumn("from_", F.col("upto") - (F.col("end_us") - F.col("start_us"))).withColumn("total", F.max("upto").over(Window.partitionBy("edit_id")))
    each = laid.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("at", F.floor(F.col("total") * (2 * F.col("n") + 1) / (2 * most)))
    return each.where("at >= from_ and at < upto").select("edit_id", "n", (F.col("start_us") + F.col("at") - F.col("from_")).alias("at_us"))


def luma_stats(pixels: DataFrame) -> DataFrame:
    """(source_id, p5, p50, p95, cast_milli) of thumbnails' pixels (source_id, r, g, b): luma, and red over blue where a pixel is near neutral."""
    luma = F.col("r") * 299 + F.col("g") * 587 + F.col("b") * 114
    near = F.greatest("r", "g", "b") - F.least("r", "g", "b") <= 40
    return pixels.groupBy("source_id").agg(
        *[F.percentile(luma, p).alias(n) for n, p in (("p5", 0.05), ("p50", 0.5), ("p95", 0.95))], F.floor(F.sum(F.when(near, F.col("r") - F.col("b"))) * 1000 / F.sum(F.when(near, 255))).alias("cast_milli")
    )


def voice_measures(levels: DataFrame) -> DataFrame:
    """(source_id, speech10, floor10, snr10): p90 and p10 of levels in tenths of a dB."""
    per = levels.groupBy("source_id").agg(F.percentile("level_db10", 0.9).alias("speech10"), F.percentile("level_db10", 0.1).alias("floor10"))
    return per.withColumn("snr10", F.col("speech10") - F.col("floor10"))


def mouth_motion(tracks: DataFrame) -> DataFrame:
    """(source_id, track_id, sample_idx, motion): mean absolute change of the mouth patch (array) since the last sighting."""
    before = F.lag("patch").over(Window.partitionBy("source_id", "track_id").orderBy("sample_idx"))
    total = F.aggregate(F.zip_with("patch", before, lambda a, b: F.abs(a - b)), F.lit(0).cast("long"), lambda s, x: s + x)
    return tracks.withColumn("motion", F.floor(total / F.size("patch"))).where("motion is not null").select("source_id", "track_id", "sample_idx", "motion")


def speaker_at(samples: DataFrame, turns: DataFrame) -> DataFrame:
    """(source_id, at_us, speaker): who holds the floor, turns under 1 s ignored, the last one carried forward."""
    long_ = turns.where(F.col("end_us") - F.col("start_us") >= 1_000_000).select("source_id", F.col("start_us").alias("at_us"), F.col("label").alias("v"), F.lit(0).alias("o"))
    pts = samples.select("source_id", "at_us", F.lit(None).cast("string").alias("v"), F.lit(1).alias("o"))
    held = F.last("v", ignorenulls=True).over(Window.partitionBy("source_id").orderBy("at_us", "o", "v").rowsBetween(Window.unboundedPreceding, 0))
    return long_.unionByName(pts).withColumn("speaker", held).where("o = 1").select("source_id", "at_us", "speaker")


def qa_moments(boundaries: DataFrame, flagged: DataFrame, most: int = 40) -> DataFrame:
    """(edit_id, at_us): splices and flagged moments, rounded to 10 ms, distinct, the first `most` of an edit."""
    every = boundaries.select("edit_id", "at_us").unionByName(flagged.select("edit_id", "at_us"))
    distinct = every.select("edit_id", (F.floor((F.col("at_us") + 5_000) / 10_000) * 10_000).alias("at_us")).distinct()
    return distinct.withColumn("n", F.row_number().over(Window.partitionBy("edit_id").orderBy("at_us"))).where(F.col("n") <= most).select("edit_id", "at_us")


def moment_verdicts(moments: DataFrame, checks: DataFrame) -> DataFrame:
    """(edit_id, moment_id, verdict): the worst open finding from 0.75 s before a moment to it. checks: (edit_id, at_us, severity, passed)."""
    rank = F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    c = checks.where("not passed").select("edit_id", F.col("at_us").alias("c0"), F.col("at_us").alias("c1"), rank.alias("r"))
    m = moments.withColumn("m0", F.col("at_us") - 750_000).withColumn("m1", F.col("at_us"))
    hit = range_join(m, c, ["edit_id"], ("m0", "m1"), ("c0", "c1"), (F.col("c0") >= F.col("m0")) & (F.col("c0") <= F.col("m1"))).groupBy("edit_id", "moment_id").agg(F.max("r").alias("r"))
    word = F.when(F.col("r") == 2, "error").when(F.col("r") == 1, "warning").otherwise("ok")
    return moments.join(hit, ["edit_id", "moment_id"], "left").select("edit_id", "moment_id", word.alias("verdict"))


def description_slots(plans: DataFrame) -> DataFrame:
    """(edit_id, body): publishing copy filled from what is known (title, hook, ask), [[slots]] where nothing is."""
    slot = lambda c: F.coalesce(F.col(c), F.lit(f"[[{c}]]"))
    return plans.select("edit_id", F.concat_ws("\n", slot("title"), slot("hook"), slot("ask")).alias("body"))


def plan_migration(config: DataFrame, aliases: DataFrame, choices: DataFrame) -> DataFrame:
    """(key, finding, detail) for config rows (key, value): renamed keys, keys nobody knows, and values outside a key's choices. aliases: (key, new_key); choices: (key, value)."""
    known = choices.select("key").distinct()
    renamed = config.join(aliases, "key").select("key", F.lit("renamed").alias("finding"), F.col("new_key").alias("detail"))
    unknown = config.join(aliases, "key", "left_anti").join(known, "key", "left_anti").select("key", F.lit("unknown").alias("finding"), F.lit("").alias("detail"))
    bad = config.join(known, "key", "left_semi").join(choices.select("key", "value").distinct(), ["key", "value"], "left_anti").select("key", F.lit("bad choice").alias("finding"), F.col("value").alias("detail"))
    return renamed.unionByName(unknown).unionByName(bad).distinct()


def render_evidence(moves: DataFrame, durations: DataFrame) -> DataFrame:
    """(edit_id, n_effects, titled, late): what was drawn, and whether a title lies in the last 3 s. moves: (edit_id, kind, start_us, end_us); durations: (edit_id, duration_us)."""
    df = moves.join(durations, "edit_id")
    return df.groupBy("edit_id").agg(
        F.count_if(F.col("kind") == "effect").alias("n_effects"), F.bool_or(F.col("kind") == "title").alias("titled"),
        F.bool_or((F.col("kind") == "title") & (F.col("end_us") > F.col("duration_us") - 3_000_000)).alias("late"),
    )


def contract_gaps(evidence: DataFrame, contracts: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, wanted, found): fields in which what was rendered differs from its contract, texts compared without case."""
    long_ = lambda df, name: df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lower(F.col(f).cast("string")).alias(name)) for f in fields])).alias("s")).select(key, "s.*")
    return long_(contracts, "wanted").join(long_(evidence, "found"), [key, "field"]).where(~F.col("wanted").eqNullSafe(F.col("found")))


def posting_notes(items: DataFrame) -> DataFrame:
    """(edit_id, note): where delivered files (edit_id, variant) with a music bed or without go."""
    per = items.groupBy("edit_id").agg(F.bool_or(F.col("variant") == "bed").alias("bed"), F.bool_or(F.col("variant") == "no_music").alias("dry"))
    return per.select("edit_id", F.when(F.col("bed") & F.col("dry"), "both: add platform music to the dry one").when(F.col("bed"), "post as it is").otherwise("add music on the platform").alias("note"))


def effects_within_limits(steps: DataFrame, limits: DataFrame) -> DataFrame:
    """(source_id, ok): whether every applied step (source_id, step, applied, amount) stays at or under its ceiling (step, most)."""
    ok = ~F.col("applied") | (F.col("amount") <= F.coalesce("most", F.lit(0)))
    return steps.join(limits, "step", "left").groupBy("source_id").agg(F.bool_and(ok).alias("ok"))


def cadence(packets: DataFrame) -> DataFrame:
    """(stream_id, monotonic, median_us): whether packet times (stream_id, pos, at_us) only rise, and the median step."""
    step = F.col("at_us") - F.lag("at_us").over(Window.partitionBy("stream_id").orderBy("pos"))
    return packets.withColumn("step", step).groupBy("stream_id").agg(F.coalesce(F.bool_and(F.col("step") > 0), F.lit(True)).alias("monotonic"), F.percentile("step", 0.5).alias("median_us"))


