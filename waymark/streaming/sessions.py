"""Streams: sliding and session windows with a watermark, and the assembly of numbered session pieces as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANSWER = "session string, seq int, answer string, want int"


def sliding_counts(events: DataFrame, at: str, keys: list[str], length: str = "6 seconds", hop: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Counts per sliding window and keys, final once the watermark has passed; later rows are left out. `at` may be a timestamp without a zone."""
    rows = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return rows.groupBy(F.window("_at", length, hop).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("begin"), F.col("w.end").alias("until"), *keys, "n")


def idle_sessions(events: DataFrame, at: str, key: str, idle: str = "60 seconds", late: str = "10 seconds") -> DataFrame:
    """Sessions that end after `idle` without events."""
    rows = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return rows.groupBy(F.session_window("_at", idle).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("until"), "n")


def assemble(pieces: DataFrame, at: str = "at", idle_ms: int = 60_000, late: str = "10 seconds") -> DataFrame:
    """pieces (session, seq, at) as a stream -> an answer per piece: 'taken' if it is the next number, 'again' if it came before (it is
    acknowledged and left out), 'gap' if one is missing (`want` says which); and 'built' with the number of pieces when the watermark finds a session idle.

    The state is two numbers per session. A session that goes on after it was built begins anew.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            want, _ = state.get
            state.remove()
            yield pd.DataFrame([(key[0], -1, "built", want)], columns=["session", "seq", "answer", "want"])
            return
        want, last = state.get if state.exists else (0, 0)
        rows = []
        # those of one micro-batch by time and number: their order of arrival is not known
        for ms, seq in sorted((ms, seq) for batch in batches for ms, seq in zip(batch["ms"].tolist(), batch["seq"].tolist(), strict=True)):
            answer = "taken" if seq == want else "again" if seq < want else "gap"
            want, last = want + (answer == "taken"), max(last, ms)
            rows.append((key[0], seq, answer, want))
        state.update((want, last))
        state.setTimeoutTimestamp(max(last + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["session", "seq", "answer", "want"])

    rows = pieces.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return rows.select("session", "seq", "_at", F.unix_millis("_at").alias("ms")).groupBy("session").applyInPandasWithState(step, ANSWER, "want int, last long", "append", "EventTimeTimeout")
