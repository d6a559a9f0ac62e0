"""Structured Streaming forms of the log statistics.

Counts are additive, so windows of them are ordinary watermarked aggregates.
Successions need the last event of a case, which is keyed state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def timed(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Event time as TIMESTAMP: watermarks don't take TIMESTAMP_NTZ."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def windowed_activity(events: DataFrame, window: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, activity, n) per tumbling or sliding window; later than ``late`` is dropped."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    rows = timed(events).withWatermark("ts", late).groupBy(span.alias("w"), F.col("event_type").alias("activity")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").alias("start"), "activity", "n")


def sessions(events: DataFrame, gap: str = "2 days", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n) per session of a user."""
    rows = timed(events).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def successions(events: DataFrame) -> DataFrame:
    """(user_id, a, b) as events arrive: state is a case's last activity and time.
    Rows of one batch are ordered by time and id; a row older than the state is dropped."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, last = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for ts, act in zip(rows.ts, rows.event_type):
            now = int(ts.value)
            if at is not None and now < at:
                continue
            if last is not None:
                out.append((key[0], last, act))
            at, last = now, act
        state.update((at, last))
        yield pd.DataFrame(out, columns=["user_id", "a", "b"])

    return timed(events).groupBy("user_id").applyInPandasWithState(step, "user_id bigint, a string, b string", "at bigint, last string", "append", GroupStateTimeout.NoTimeout)
