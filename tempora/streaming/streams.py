"""The speech operators on arriving rows: Structured Streaming with watermarks.

Word streams carry (source_id, idx, word, speaker, start_us, end_us, ts); ts is event time. Rows later than the watermark are dropped, as in
any watermarked query.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

WORD = "source_id long, idx long, word string, speaker string, start_us long, end_us long, ts timestamp"
PHRASE = "source_id long, phrase_idx long, speaker string, start_us long, end_us long, n_words long, text string"
PAUSE = "source_id long, start_us long, end_us long"


#: A recording's open phrase is closed once the watermark is so far past its last word; what it takes to go on (its next index, number and last end) is kept for longer.
SILENT_MS = 60_000
KEPT_MS = 24 * 3_600_000


def _arrived(batches: Iterator[pd.DataFrame], columns: list[str]) -> list[tuple]:
    """Rows of this trigger that have an index: columns, then the event time in microseconds."""
    return [(*x[:-1], x[-1].value // 1000) for pdf in batches for x in pdf.loc[pdf["idx"].notna(), [*columns, "ts"]].itertuples(index=False)]


def _in_turn(rows: list[tuple], expect: int, watermark_us: int) -> tuple[list[tuple], list[tuple], int]:
    """(rows whose turn it is, rows to hold, next index). A row waits for those before it until the watermark is past its own time: what hasn't come by then is lost."""
    taken, held = [], []
    for r in sorted(rows):
        if r[0] < expect:
            continue
        if held or r[0] > expect and r[-1] > watermark_us:
            held.append(r)
        else:
            taken.append(r)
            expect = r[0] + 1
    return taken, held, expect


def _run_out(state, latest_us: int, closed: bool) -> None:
    """Sets when a recording is looked at again: when it has been silent, then when it is forgotten. Its own latest word may be ahead of the watermark."""
    state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), latest_us // 1000, 0) + (KEPT_MS if closed else SILENT_MS))


def stream_phrases(words: DataFrame, delay: str = "10 seconds", silence_us: int = 500_000, max_words: int = 28) -> DataFrame:
    """Phrases as `group_phrases` makes them: closed by a silence, a change of speaker or the word limit; the open one is closed once a recording is silent past the watermark.

    State per recording: the words of the open phrase and those that came ahead of their turn. Words are taken in order of idx; one that hasn't come when the watermark passes the words behind it is lost,
    and the recording goes on without it. After a silence, however long within a day, phrases are numbered on.
    """
    columns = ["idx", "word", "speaker", "start_us", "end_us"]

    def run(key, batches, state):
        expect, number, latest, buffer, current = state.get if state.exists else (0, 0, 0, [], [])
        buffer, current, out = [tuple(x) for x in buffer], [tuple(x) for x in current], []

        def close():
            nonlocal current, number
            if current:
                out.append((key[0], number, current[0][2], current[0][3], current[-1][4], len(current), " ".join(w[1] for w in current)))
                number, current = number + 1, []

        idle = state.hasTimedOut and not buffer and not current
        rows = buffer + ([] if state.hasTimedOut else _arrived(batches, columns))
        taken, held, expect = _in_turn(rows, expect, state.getCurrentWatermarkMs() * 1000)
        for w in taken:
            if current and (w[3] - current[-1][4] >= silence_us or w[2] != current[0][2]):
                close()
            current.append(w)
            if len(current) >= max_words:
                close()
        latest = max([latest, *(w[-1] for w in rows)])
        if state.hasTimedOut:
            close()
        if idle:
            state.remove()
        else:
            state.update((expect, number, latest, [list(w) for w in held], [list(w) for w in current]))
            _run_out(state, latest, not held and not current)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in PHRASE.split(", ")])

    item = "array<struct<idx:long,word:string,speaker:string,start_us:long,end_us:long,at:long>>"
    return words.withWatermark("ts", delay).groupBy("source_id").applyInPandasWithState(
        run, PHRASE, f"expect long, number long, latest long, buffer {item}, current {item}", "append", GroupStateTimeout.EventTimeTimeout
    )


def stream_pauses(words: DataFrame, delay: str = "10 seconds", minimum_us: int = 500_000) -> DataFrame:
    """Gaps of `minimum_us` or more before a word, as `find_pauses` finds inside a recording. State: the last end, and words ahead of their turn; lost words and long silences as in
    `stream_phrases`."""

    def run(key, batches, state):
        expect, last, latest, buffer = state.get if state.exists else (0, -1, 0, [])
        out = []
        idle = state.hasTimedOut and not buffer
        rows = [tuple(x) for x in buffer] + ([] if state.hasTimedOut else _arrived(batches, ["idx", "start_us", "end_us"]))
        taken, held, expect = _in_turn(rows, expect, state.getCurrentWatermarkMs() * 1000)
        for w in taken:
            if last >= 0 and w[1] - last >= minimum_us:
                out.append((key[0], last, w[1]))
            last = w[2]
        latest = max([latest, *(w[-1] for w in rows)])
        if idle:
            state.remove()
        else:
            state.update((expect, last, latest, [list(w) for w in held]))
            _run_out(state, latest, not held)
        yield pd.DataFrame(out, columns=["source_id", "start_us", "end_us"])

    return words.withWatermark("ts", delay).groupBy("source_id").applyInPandasWithState(
        run, PAUSE, "expect long, last long, latest long, buffer array<struct<idx:long,start_us:long,end_us:long,at:long>>", "append", GroupStateTimeout.EventTimeTimeout
    )


def stream_utterances(words: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Words of a speaker less than 0.5 s apart as sessions: a session window merges at a gap equal to its limit, so the limit is a microsecond less."""
    gap = F.expr("make_interval(0, 0, 0, 0, 0, 0, cast((end_us - start_us + 499999) / 1000000.0 as decimal(18, 6)))")
    return (
        words.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", gap).alias("w"), "source_id", "speaker")
        .agg(F.count("*").alias("n_words"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
        .select("source_id", "speaker", "n_words", "start_us", "end_us")
    )


def stream_pace(words: DataFrame, length: str = "1 minute", slide: str | None = None, delay: str = "10 seconds") -> DataFrame:
    """(source_id, from_ts, n_words): words per tumbling or sliding window."""
    window = F.window("ts", length, slide or length)
    return words.withWatermark("ts", delay).groupBy(window.alias("w"), "source_id").agg(F.count("*").alias("n_words")).select("source_id", F.col("w.start").alias("from_ts"), "n_words")


def stream_dedup_sources(files: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Files whose fingerprint wasn't seen within the watermark's reach."""
    return files.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["fingerprint"])


def stream_qa_rollup(qa: DataFrame, length: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """(from_ts, check, n, failed) per window."""
    return (
        qa.withWatermark("ts", delay)
        .groupBy(F.window("ts", length).alias("w"), "check")
        .agg(F.count("*").alias("n"), F.count_if(~F.col("passed")).alias("failed"))
        .select(F.col("w.start").alias("from_ts"), "check", "n", "failed")
    )


def stream_join_cues_words(cues: DataFrame, words: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Words with the cue that shows them: a stream-stream join within the cue's span; a cue waits for words up to its length and the watermark.

    cues: (source_id, cue_idx, cue_ts, cue_end).
    """
    c = cues.withWatermark("cue_ts", delay).alias("c")
    w = words.withWatermark("ts", delay).alias("w")
    inside = F.expr("c.source_id = w.source_id and w.ts >= c.cue_ts and w.ts < c.cue_end and w.ts < c.cue_ts + interval 10 minutes")
    return c.join(w, inside).select("w.source_id", "w.idx", "c.cue_idx")


def stream_render_rate(log: DataFrame, rates: DataFrame) -> DataFrame:
    """Arriving renders beside the rate expected of their renderer and quality (rates: a table of one row for each): a stream-static join."""
    return log.join(rates, ["renderer", "quality"], "left").withColumn("over", F.col("elapsed_s") > F.col("rate") * F.col("output_s"))
