"""Faces over sampled frames: tracks, speakers and panes; and library clips and effects placed by ordered rules."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold
from .intervals import range_join

REACH = 1.2
LIVES = 3
LEAST_R = 0.15
# Effects in turn and their number per 30 s, by energy.
ROTATION = {
    "calm": (), "lively": ("frame_in_frame", "tilt", "split_mirror"), "bold": ("frame_in_frame", "speed_lines", "triptych", "bw_flash", "tilt", "device_frame"),
}
PER_30S = {"calm": 0, "lively": 2, "bold": 4}


def track_faces(faces: DataFrame) -> DataFrame:
    """(source_id, sample_idx, face_idx, track_id): faces (source_id, sample_idx, face_idx, x, y, w) joined to the nearest centre within 1.2 widths; a track lives for three samples.

    A join finds, for each face, the faces of the three samples before whose reach it is in. Which of these links hold is an ordered choice per recording: samples in turn,
    the most recently seen tracks first, then older ones, each with its nearest face. The choice keeps the faces of three samples, whatever the length of a recording.
    """
    old = faces.select(
        "source_id", F.explode(F.sequence(F.lit(1), F.lit(LIVES))).alias("ago"), F.col("face_idx").alias("from_face"), F.col("sample_idx").alias("from_sample"),
        *[F.col(c).alias(f"_{c}") for c in "xyw"],
    ).withColumn("sample_idx", (F.col("from_sample") + F.col("ago")).cast("long"))
    away = F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y"))
    near = faces.join(old, ["source_id", "sample_idx"]).withColumn("away", away).where(F.col("away") <= REACH * F.greatest(F.lit(1.0), F.col("_w").cast("double")))
    alone = faces.select("source_id", "sample_idx", "face_idx", F.lit(LIVES + 1).alias("ago"), F.lit(None).cast("long").alias("from_face"), F.lit(None).cast("double").alias("away"))
    asked = alone.unionByName(near.select("source_id", "sample_idx", "face_idx", "ago", F.col("from_face").cast("long").alias("from_face"), "away"))

    def choose(rows):
        tip: dict[tuple[int, int], int] = {}  # track that a face was the last of
        tracks = 0
        for sample, links in groupby(rows, key=lambda r: r.sample_idx):
            tip = {at: t for at, t in tip.items() if sample - at[0] <= LIVES}
            links, taken = list(links), {}
            known = [r for r in links if r.ago <= LIVES and (sample - r.ago, r.from_face) in tip]
            for r in sorted(known, key=lambda r: (r.ago, tip[sample - r.ago, r.from_face], r.away, r.face_idx)):
                if r.face_idx not in taken and (sample - r.ago, r.from_face) in tip:
                    taken[r.face_idx] = tip.pop((sample - r.ago, r.from_face))
            for r in links:
                if r.ago > LIVES:
                    if r.face_idx not in taken:
                        taken[r.face_idx], tracks = tracks, tracks + 1
                    tip[sample, r.face_idx] = taken[r.face_idx]
                    yield r.source_id, sample, r.face_idx, taken[r.face_idx]

    return fold(asked, ["source_id"], ["sample_idx", "face_idx"], choose, "source_id long, sample_idx long, face_idx long, track_id int")


def assign_speakers(motion: DataFrame, turns: DataFrame) -> DataFrame:
    """(source_id, label, track_id): the pairing with the strongest correlation first, then the next among what is left, none under 0.15.

    motion: (source_id, track_id, at_us, motion); turns: (source_id, start_us, end_us, label). Correlations are a join and an aggregate; the pairing runs over the few
    pairs of a recording.
    """
    m = motion.withColumn("m1", F.col("at_us"))
    t = turns.select("source_id", F.col("start_us").alias("t0"), F.col("end_us").alias("t1"), "label")
    spoken = range_join(m, t, ["source_id"], ("at_us", "m1"), ("t0", "t1"), (F.col("at_us") >= F.col("t0")) & (F.col("at_us") < F.col("t1"))).select("source_id", "track_id", "at_us", "label").distinct()
    each = motion.join(turns.select("source_id", "label").distinct(), "source_id").join(spoken.withColumn("on", F.lit(1.0)), ["source_id", "track_id", "at_us", "label"], "left")
    r = each.groupBy("source_id", "label", "track_id").agg(F.corr("motion", F.coalesce("on", F.lit(0.0))).alias("r"), F.count("motion").alias("n"))
    scored = r.where("n >= 4 and r is not null and not isnan(r)").select("source_id", "label", "track_id", F.round("r", 9).alias("r"), (-F.round("r", 9)).alias("order_"))

    def pair(rows):
        names, tracks = set(), set()
        for x in rows:
            if x.r >= LEAST_R and x.label not in names and x.track_id not in tracks:
                names.add(x.label)
                tracks.add(x.track_id)
                yield x.source_id, x.label, x.track_id, x.r

    return fold(scored, ["source_id"], ["order_", "label", "track_id"], pair, "source_id long, label string, track_id int, r double")


def split_panes(tracked: DataFrame) -> DataFrame:
    """(source_id, pane, track_id, x): the two people seen in most samples, 30 % of them at least, left first; x is the median centre. Sources with one such person give no panes."""
    n = tracked.groupBy("source_id").agg(F.count_distinct("sample_idx").alias("samples"))
    per = tracked.groupBy("source_id", "track_id").agg(F.count_distinct("sample_idx").alias("seen"), F.percentile("x", 0.5).alias("x")).join(n, "source_id").where("seen * 10 >= samples * 3")
    best = Window.partitionBy("source_id").orderBy(F.desc("seen"), "track_id")
    two = per.withColumn("nth", F.row_number().over(best)).where("nth <= 2").withColumn("k", F.count("*").over(Window.partitionBy("source_id"))).where("k = 2")
    return two.select("source_id", F.row_number().over(Window.partitionBy("source_id").orderBy("x", "track_id")).alias("pane"), "track_id", "x")


def effects(sentences: DataFrame, energies: DataFrame) -> DataFrame:
    """(source_id, at_us, effect, sure): a picture effect where a sentence after the first starts, 6 s apart or more, types in turn, within the budget of the energy.

    sentences: (source_id, sentence_idx, start_us); energies: (source_id, energy, duration_us).
    """

    def run(rows):
        rows = list(rows)  # sentences of one recording
        kinds = ROTATION[rows[0].energy]
        allowed = PER_30S[rows[0].energy] * max(rows[0].duration_us, 1_000_000) // 30_000_000
        found, last = 0, -6_000_000
        for r in rows[1:]:
            if not kinds or found >= allowed or r.start_us + 1_200_000 > r.duration_us:
                break
            if r.start_us - last >= 6_000_000:
                yield r.source_id, r.start_us, kinds[found % len(kinds)], found == 0 or r.start_us - last <= 10_000_000
                found, last = found + 1, r.start_us

    df = sentences.join(energies, "source_id").select("source_id", "sentence_idx", "start_us", "energy", "duration_us")
    return fold(df, ["source_id"], ["sentence_idx"], run, "source_id long, at_us long, effect string, sure boolean")


def find_broll(matches: DataFrame, totals: DataFrame, gap_us: int = 3_000_000, longest_us: int = 2_000_000, density_pct: int = 100) -> DataFrame:
    """(edit_id, clip_id, at_us, length_us, confidence): a clip once per edit, on the word that names it, exact matches before stems, `gap_us` apart, within the share of the edit.

    matches: (edit_id, idx, at_us, clip_id, exact, clip_us); totals: (edit_id, total_us). Blocked clips are left out before. A word takes its first free clip, so the rule runs in order.
    """

    def run(rows):
        rows = list(rows)  # matches in one edit
        used, placed, spent, k = set(), [], 0, 0
        while k < len(rows):
            word, r = [], rows[k]
            while k < len(rows) and rows[k].idx == r.idx and rows[k].at_us == r.at_us:
                if rows[k].clip_id not in used:
                    word.append(rows[k])
                k += 1
            if not word or (placed and r.at_us - placed[-1] < gap_us):
                continue
            c = word[0]
            length = min(longest_us, max(1_000_000, c.clip_us), c.total_us - c.at_us)
            if length < 1_000_000 or (spent + length) * 100 > density_pct * c.total_us:
                continue
            used.add(c.clip_id)
            placed.append(c.at_us)
            spent += length
            yield c.edit_id, c.clip_id, c.at_us, length, "high" if c.inexact == 0 else "medium"

    df = matches.join(totals, "edit_id").select("edit_id", "idx", "at_us", "clip_id", (~F.col("exact")).cast("int").alias("inexact"), "clip_us", "total_us")
    return fold(df, ["edit_id"], ["at_us", "idx", "inexact", "clip_id"], run, "edit_id long, clip_id long, at_us long, length_us long, confidence string")


def onsets(spectra: DataFrame, half: int = 8, gap: int = 4) -> DataFrame:
    """(stream_id, frame_no): peaks of the sum of positive rises of log1p magnitudes over their neighbourhood's mean by half the spread, `gap` frames apart. spectra: (stream_id, frame_no, vec)."""
    by = Window.partitionBy("stream_id").orderBy("frame_no")
    rise = F.aggregate(F.zip_with("vec", F.lag("vec").over(by), lambda a, b: F.greatest(F.lit(0.0), F.log1p(F.abs(a.cast("double"))) - F.log1p(F.abs(b.cast("double"))))), F.lit(0.0), lambda s, x: s + x)
    flux = spectra.withColumn("flux", F.round(rise, 9)).where("flux is not null")
    local = F.avg("flux").over(by.rowsBetween(-half, half))
    spread = F.stddev_pop("flux").over(Window.partitionBy("stream_id"))
    marked = flux.withColumns({"local": local, "spread": spread, "b": F.lag("flux").over(by), "a": F.lead("flux").over(by)})
    peaks = marked.where("flux >= a and flux >= b and flux > local + 0.5 * spread").select("stream_id", "frame_no")

    def apart(rows):
        last = None
        for r in rows:
            if last is None or r.frame_no - last >= gap:
                last = r.frame_no
                yield r.stream_id, last

    return fold(peaks, ["stream_id"], ["frame_no"], apart, "stream_id long, frame_no long")


def frame_offset(ref: DataFrame, cand: DataFrame, busy: DataFrame, reach: int = 3) -> DataFrame:
    """(stream_id, shift, diff): the shift of -3 to 3 frames with the least mean difference of thumbnails away from busy frames, ties to the smallest move. ref, cand: (stream_id, frame_no, vec); busy: (stream_id, frame_no)."""
    calm = ref.join(busy, ["stream_id", "frame_no"], "left_anti")
    moved = cand.select("stream_id", F.col("vec").alias("other"), "frame_no", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("shift")).withColumn("frame_no", F.col("frame_no") - F.col("shift"))
    total = F.aggregate(F.zip_with("vec", "other", lambda a, b: F.abs(a - b)), F.lit(0).cast("long"), lambda s, x: s + x)
    mean = calm.join(moved, ["stream_id", "frame_no"]).groupBy("stream_id", "shift").agg(F.floor(F.sum(total) * 1000 / F.sum(F.size("vec"))).alias("diff"))
    order = Window.partitionBy("stream_id").orderBy("diff", F.abs("shift"), "shift")
    return mean.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("stream_id", "shift", "diff")
