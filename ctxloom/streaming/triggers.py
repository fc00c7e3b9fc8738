"""Extraction batches from a stream of messages, and windows over the audit stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SIZE, INTERVAL_MS = 5, 30_000
OUT = "conv_id long, n long, first_turn long, last_turn long, reason string"
STATE = "turns array<long>, since_ms long"


def should_flush(buffered: int, waited_ms: int, *, size: int = SIZE, interval_ms: int = INTERVAL_MS) -> str | None:
    """count, interval, or nothing to do."""
    if buffered >= size:
        return "count"
    return "interval" if buffered and waited_ms >= interval_ms else None


def extraction_batches(messages: DataFrame, *, size: int = SIZE, interval_ms: int = INTERVAL_MS) -> DataFrame:
    """A row for each batch that is due: after `size` messages, or `interval_ms` after the first that waits.

    The state of a session holds the turns that wait, fewer than `size` between
    two batches. A session that falls silent is flushed by the timer.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        turns, since = (list(state.get[0]), state.get[1]) if state.exists else ([], now)
        out = []

        def flush(reason: str) -> None:
            out.append((key[0], len(turns), turns[0], turns[-1], reason))

        if state.hasTimedOut:
            if turns:
                flush("interval")
            state.remove()
        else:
            for t in sorted(int(t) for pdf in parts for t in pdf["turn"]):
                if not turns:
                    since = now
                turns.append(t)
                if (reason := should_flush(len(turns), now - since, size=size, interval_ms=interval_ms)) is not None:
                    flush(reason)
                    turns, since = [], now
            if turns:
                state.update((turns, since))
                state.setTimeoutDuration(max(1, interval_ms - (now - since)))
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=["conv_id", "n", "first_turn", "last_turn", "reason"])

    return messages.groupBy("conv_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def audit_windows(events: DataFrame, *, ts: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, key, n: counts by tumbling window; on a stream, rows up to `late` late count."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    timed = timed.withWatermark(ts, late) if events.isStreaming else timed
    return timed.groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def sessions(events: DataFrame, *, ts: str = "ts", user: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user, session_start, session_end, n: a session ends after a gap."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    timed = timed.withWatermark(ts, late) if events.isStreaming else timed
    return timed.groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
