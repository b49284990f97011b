"""Audits: rule tables that give a row per check: (..., check, severity, passed, measured)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rule(name: str, severity: str, ok: Column, measured: Column) -> Column:
    return F.struct(F.lit(name).alias("check"), F.lit(severity).alias("severity"), F.coalesce(ok, F.lit(True)).alias("passed"), measured.cast("long").alias("measured"))


def checks(df: DataFrame, key: list[str], rules: list[Column]) -> DataFrame:
    """One row per row of df and rule."""
    return df.select(*key, F.explode(F.array(*rules)).alias("_r")).select(*key, "_r.*")


def platform_checks(deliveries: DataFrame, platforms: DataFrame) -> DataFrame:
    """Deliveries (delivery_id, seconds, width, height) against platforms (platform, min_s, max_s, advised_s, ratio_w, ratio_h): a handful of specifications for each row."""
    each = deliveries.join(F.broadcast(platforms))  # a fixed table of a few platforms
    fits = F.abs(F.col("width") * F.col("ratio_h") - F.col("height") * F.col("ratio_w")) * 100 < F.col("height") * F.col("ratio_h")
    return checks(
        each,
        ["delivery_id", "platform"],
        [
            rule("duration limit", "error", F.col("seconds").between(F.col("min_s"), F.col("max_s")), F.col("seconds")),
            rule("advised length", "warning", F.col("seconds") <= F.col("advised_s"), F.col("seconds")),
            rule("aspect ratio", "warning", fits, F.col("width") * 1000 / F.col("height")),
        ],
    )


def reel_check(words: DataFrame, recordings: DataFrame, cues: DataFrame) -> DataFrame:
    """First word within 1 s, no dead air over 0.7 s, 0.6 s of tail at most, phrase cues of 2.5 s at most, a question or share word at the end is not asked for here."""
    gap = F.col("start_us") - F.lag("end_us").over(Window.partitionBy("source_id").orderBy("idx"))
    spoken = words.withColumn("gap", gap).groupBy("source_id").agg(F.min("start_us").alias("first"), F.max("end_us").alias("last"), F.max("gap").alias("dead"))
    shown = cues.groupBy(F.col("edit_id").alias("source_id")).agg(F.max(F.col("end_us") - F.col("start_us")).alias("longest"), F.sum(F.col("end_us") - F.col("start_us")).alias("covered"))
    df = recordings.join(spoken, "source_id", "left").join(shown, "source_id", "left")
    tail = F.col("duration_us") - F.col("last")
    return checks(
        df,
        ["source_id"],
        [
            rule("first word", "warning", F.coalesce(F.col("first") <= 1_000_000, F.lit(False)), F.col("first")),
            rule("dead air", "warning", F.col("dead") <= 700_000, F.col("dead")),
            rule("tail", "warning", tail <= 600_000, tail),
            rule("longest cue", "warning", F.col("longest") <= 2_500_000, F.col("longest")),
            rule("caption coverage", "warning", F.col("covered") * 20 >= F.col("duration_us") * 19, F.col("covered") * 1000 / F.col("duration_us")),
        ],
    )


def lexicon_hits(texts: DataFrame, key: str, lexicon: DataFrame) -> DataFrame:
    """(key, category, hits): entries of a lexicon (category, phrase) found in a text: phrases by their words in a row, words of four letters or more by their start, shorter ones whole.

    Phrases and words meet through the words of the text, exploded: equi-joins on the first word, or on its prefix.
    """
    tokens = texts.select(key, F.expr(r"filter(split(lower(text), '[^\\p{L}\\p{N}_]+'), x -> x <> '')").alias("ts"))
    at = tokens.select(key, "ts", F.posexplode("ts").alias("pos", "tok"))
    entries = lexicon.select("category", "phrase", F.split("phrase", " ").alias("parts"))
    many = entries.where(F.size("parts") > 1).withColumn("head", F.col("parts")[0])
    phrase = at.join(many, at["tok"] == many["head"]).where(F.slice("ts", F.col("pos") + 1, F.size("parts")) == F.col("parts")).select(key, "category", "phrase")
    single = entries.where(F.size("parts") == 1)
    long_, short = single.where(F.length("phrase") >= 4), single.where(F.length("phrase") < 4)
    starts = at.select(key, F.explode(F.transform(F.sequence(F.lit(4), F.greatest(F.lit(4), F.length("tok"))), lambda n: F.substring(F.col("tok"), F.lit(1), n))).alias("start")).distinct()
    stem = starts.join(long_, starts["start"] == long_["phrase"]).select(key, "category", "phrase")
    whole = at.select(key, "tok").distinct().join(short, F.col("tok") == F.col("phrase")).select(key, "category", "phrase")
    return phrase.unionByName(stem).unionByName(whole).distinct().groupBy(key, "category").agg(F.count("*").alias("hits"))


def hook_check(first_cues: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The first caption (edit_id, text, first_word_us): 8 words at most, first word within 0.3 s, no promotion, no greeting, an address or tension."""
    hits = lexicon_hits(first_cues, "edit_id", lexicon).groupBy("edit_id").pivot("category", ["address", "greeting", "promo", "tension"]).agg(F.first("hits"))
    df = first_cues.join(hits, "edit_id", "left").fillna(0, ["address", "greeting", "promo", "tension"])
    n = F.size(F.expr(r"filter(split(text, '[^\\p{L}\\p{N}_]+'), x -> x <> '')"))
    pull = F.col("address") + F.col("tension") + F.col("text").contains("?").cast("int")
    return checks(
        df,
        ["edit_id"],
        [
            rule("words", "warning", n <= 8, n), rule("first word", "warning", F.col("first_word_us") <= 300_000, F.col("first_word_us")),
            rule("promotion", "warning", F.col("promo") == 0, F.col("promo")), rule("address or tension", "warning", pull > 0, pull),
            rule("greeting", "warning", F.col("greeting") == 0, F.col("greeting")),
        ],
    )


def effect_budget(moves: DataFrame, durations: DataFrame, limits: DataFrame) -> DataFrame:
    """(edit_id, n_effects, allowed): edits with more effects than their energy allows per 30 s. moves: (edit_id, kind); durations: (edit_id, energy, duration_us)."""
    n = moves.where("kind = 'effect'").groupBy("edit_id").agg(F.count("*").alias("n_effects"))
    allowed = F.floor(F.col("per_30s") * F.greatest(F.col("duration_us"), F.lit(1_000_000)) / 30_000_000)
    return n.join(durations, "edit_id").join(F.broadcast(limits), "energy").withColumn("allowed", allowed).where("n_effects > allowed").select("edit_id", "n_effects", "allowed")


def plan_conflicts(moves: DataFrame) -> DataFrame:
    """(edit_id, conflict, n): overlapping neighbours among punch-ins and effects, and edits with more than one title. moves: (edit_id, kind, start_us, end_us, move_id)."""
    order = Window.partitionBy("edit_id", "kind").orderBy("start_us", "move_id")
    before = F.max("end_us").over(order.rowsBetween(Window.unboundedPreceding, -1))
    hit = moves.where("kind in ('punch_in', 'effect')").withColumn("b", before).where("start_us < b").groupBy("edit_id", F.concat(F.lit("overlap "), "kind").alias("conflict")).agg(F.count("*").alias("n"))
    titles = moves.where("kind = 'title'").groupBy("edit_id").agg(F.count("*").alias("n")).where("n > 1").select("edit_id", F.lit("titles").alias("conflict"), "n")
    return hit.unionByName(titles)


def framing_between_ranges(faces: DataFrame) -> DataFrame:
    """(edit_id, range_idx, size_permille, eye_gap): neighbouring ranges whose face sizes differ by over 1.35, or eye lines by over 8 %. faces: (edit_id, range_idx, face_h, eye_permille)."""
    order = Window.partitionBy("edit_id").orderBy("range_idx")
    h, e = F.lag("face_h").over(order), F.lag("eye_permille").over(order)
    ratio = F.floor(F.greatest("face_h", h) * 1000 / F.least(F.col("face_h"), h))
    return faces.withColumns({"size_permille": ratio, "eye_gap": F.abs(F.col("eye_permille") - e), "prev": h}).where("prev is not null and (size_permille > 1350 or eye_gap > 80)").select(
        "edit_id", "range_idx", "size_permille", "eye_gap"
    )


def publish_limits(publish: DataFrame, platforms: DataFrame) -> DataFrame:
    """(item_id, platform, problem): slots left, and titles, descriptions or hashtags over a platform's limits."""
    each = publish.join(F.broadcast(platforms))  # a fixed table of a few platforms
    problems = F.array_compact(
        F.array(
            F.when(F.concat_ws(" ", "title", "description").rlike(r"\[\[[^\]]+\]\]"), "placeholders"), F.when(F.length("title") > F.col("title_max"), "title"),
            F.when(F.length("description") > F.col("description_max"), "description"), F.when(F.col("n_hashtags") > F.col("hashtag_max"), "hashtags"),
        )
    )
    return each.select("item_id", "platform", F.explode(problems).alias("problem"))


def verify_delivery(items: DataFrame, files: DataFrame) -> DataFrame:
    """(path, problem): delivered files that are gone, or whose hash differs. items: (path, sha256); files: (path, sha256)."""
    now = files.select("path", F.col("sha256").alias("_now"))
    problem = F.when(F.col("_now").isNull(), "missing").when(F.col("_now") != F.col("sha256"), "changed")
    return items.join(now, "path", "left").withColumn("problem", problem).where("problem is not null").select("path", "problem")


def check_analysis(observations: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """(kind, ref): observation ids that repeat, and observations that hypotheses (hyp_id, based_on) cite but don't exist."""
    twice = observations.groupBy("obs_id").count().where("count > 1").select(F.lit("repeated id").alias("kind"), F.col("obs_id").alias("ref"))
    cited = hypotheses.select(F.explode("based_on").alias("ref")).distinct()
    lost = cited.join(observations.select(F.col("obs_id").alias("ref")).distinct(), "ref", "left_anti").select(F.lit("unknown observation").alias("kind"), "ref")
    return twice.unionByName(lost)


def qa_rollup(qa: DataFrame, accepted: DataFrame) -> DataFrame:
    """(edit_id, errors, warnings, status) of qa (edit_id, check, severity, passed); accepted: (edit_id, check) warnings an edit takes as they are."""
    ok = accepted.select("edit_id", "check").distinct().withColumn("_ok", F.lit(True))
    df = qa.join(ok, ["edit_id", "check"], "left")
    per = df.groupBy("edit_id").agg(
        F.count_if(~F.col("passed") & (F.col("severity") == "error")).alias("errors"),
        F.count_if(~F.col("passed") & (F.col("severity") == "warning") & F.col("_ok").isNull()).alias("warnings"),
    )
    return per.withColumn("status", F.when(F.col("errors") > 0, "failed").when(F.col("warnings") > 0, "passed_with_warnings").otherwise("passed"))


def qa_dashboard(qa: DataFrame) -> DataFrame:
    """(check, severity, n, failed): counts with subtotals by check and in all; null stands for "all"."""
    return qa.rollup("check", "severity").agg(F.count("*").alias("n"), F.count_if(~F.col("passed")).alias("failed"))


def technical_qa(renders: DataFrame) -> DataFrame:
    """Renders (edit_id, streams, fps_num, fps_den, width, height, planned_us, measured_us, audio_us, peak_db10, black_us, first_cue_us) by rule: a picture stream, a standard frame rate, even size,
    duration within 45 ms, sound as long as picture, peak and level, opening black under 0.25 s, first cue within 1 s."""
    standard = (F.col("fps_den") == 1) & F.col("fps_num").isin(24, 25, 30, 50, 60) | (F.col("fps_den") == 1001) & F.col("fps_num").isin(24000, 30000, 60000)
    drift, apart = F.abs(F.col("measured_us") - F.col("planned_us")), F.abs(F.col("audio_us") - F.col("measured_us"))
    return checks(
        renders,
        ["edit_id"],
        [
            rule("picture stream", "error", F.col("streams") > 0, F.col("streams")), rule("frame rate", "warning", standard, F.col("fps_num")),
            rule("even size", "error", (F.col("width") % 2 == 0) & (F.col("height") % 2 == 0), F.col("width")), rule("duration", "error", drift <= 45_000, drift),
            rule("sound length", "error", apart <= 100_000, apart), rule("peak", "warning", F.col("peak_db10") <= -5, F.col("peak_db10")),
            rule("audible", "error", F.col("peak_db10") > -600, F.col("peak_db10")), rule("opening black", "error", F.col("black_us") < 250_000, F.col("black_us")),
            rule("first cue", "warning", F.col("first_cue_us") <= 1_000_000, F.col("first_cue_us")),
        ],
    )


def silence_at_cuts(boundaries: DataFrame, quiet: DataFrame, reach_us: int = 150_000) -> DataFrame:
    """(edit_id, at_us, silent): whether a measured silence lies within 0.15 s of a cut. boundaries: (edit_id, at_us); quiet: (edit_id, q_start, q_end)."""
    from .intervals import range_join

    b = boundaries.withColumns({"b0": F.col("at_us") - reach_us, "b1": F.col("at_us") + reach_us})
    near = range_join(b, quiet, ["edit_id"], ("b0", "b1"), ("q_start", "q_end"), (F.col("q_start") <= F.col("b1")) & (F.col("q_end") >= F.col("b0"))).select("edit_id", "at_us").distinct()
    return boundaries.join(near.withColumn("silent", F.lit(True)), ["edit_id", "at_us"], "left").select("edit_id", "at_us", F.coalesce("silent", F.lit(False)).alias("silent"))


def motion_qa(elements: DataFrame, cues: DataFrame, durations: DataFrame) -> DataFrame:
    """Graphics (edit_id, element_id, kind, start_us, end_us, chars, x0, y0, x1, y1) by rule: reading time of 0.6 s and 15 characters a second, inside the frame (per mille), clear of caption boxes
    shown at the same time (cues: edit_id, c_start, c_end, c_y0, c_y1), and at most 16 a minute of an edit (durations: edit_id, duration_us)."""
    from .intervals import overlap_join

    hit = overlap_join(elements.select("edit_id", "element_id", "start_us", "end_us", "y0", "y1"), cues, ["edit_id"], ("start_us", "end_us"), ("c_start", "c_end"))
    covered = hit.where((F.col("y0") < F.col("c_y1")) & (F.col("c_y0") < F.col("y1"))).groupBy("edit_id", "element_id").agg(F.count("*").alias("n_covered"))
    per = elements.groupBy("edit_id").agg(F.count("*").alias("n_elements"))
    df = elements.join(covered, ["edit_id", "element_id"], "left").join(per, "edit_id").join(durations, "edit_id")
    shown, need = F.col("end_us") - F.col("start_us"), 600_000 + F.floor(F.col("chars") * 1_000_000 / 15)
    inside = (F.col("x0") >= 0) & (F.col("y0") >= 0) & (F.col("x1") <= 1000) & (F.col("y1") <= 1000)
    over = F.coalesce("n_covered", F.lit(0))
    rate = F.floor(F.col("n_elements") * 60_000_000 / F.greatest(F.col("duration_us"), F.lit(1_000_000)))
    return checks(
        df, ["edit_id", "element_id"],
        [rule("reading time", "warning", shown >= need, shown), rule("inside the frame", "error", inside, F.col("x1")), rule("clear of captions", "error", over == 0, over), rule("per minute", "warning", rate <= 16, rate)],
    )


def opening_qa(moves: DataFrame, cues: DataFrame) -> DataFrame:
    """(edit_id, check, ...): no card or still before 0.5 s, a title by 3 s, the first cue within 40 ms. moves: (edit_id, kind, start_us, end_us); cues: (edit_id, start_us)."""
    m = moves.groupBy("edit_id").agg(
        F.min(F.when(F.col("kind").isin("card", "still", "effect"), F.col("start_us"))).alias("card"), F.min(F.when(F.col("kind") == "title", F.col("start_us"))).alias("title")
    )
    df = m.join(cues.groupBy("edit_id").agg(F.min("start_us").alias("cue")), "edit_id", "left")
    return checks(
        df, ["edit_id"],
        [rule("no early card", "error", F.col("card") >= 500_000, F.col("card")), rule("title in time", "warning", F.col("title") <= 3_000_000, F.col("title")), rule("first cue", "warning", F.col("cue") <= 40_000, F.col("cue"))],
    )
