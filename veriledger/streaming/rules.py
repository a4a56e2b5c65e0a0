"""Stateful service rules over streams: an extra beside the window queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rate_limit_stream(events: DataFrame, key: str = "user_id", limit: int = 20, seconds: int = 300, lateness: str = "10 minutes") -> DataFrame:
    """Sliding-window limit whose rejected attempts are not recorded. State: the times let through, ``limit`` at most a key, dropped once the watermark has passed them by the window."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        queue = list(state.get[0]) if state.exists else []
        last = 0
        for f in frames:
            f = f.sort_values(["us", "event_id"])
            out = []
            for t in f["us"]:
                queue = [x for x in queue if x > t - seconds * 1_000_000]
                allowed = len(queue) < limit
                if allowed:
                    queue.append(int(t))
                out.append(allowed)
                last = max(last, int(t))
            yield pd.DataFrame({key: [k[0]] * len(f), "event_id": f["event_id"], "allowed": out})
        state.update((queue,))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    # The watermark runs over the times at which attempts leave the window, which is when state can go.
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select(F.col(key).cast("long").alias(key), "event_id", us.alias("us"), F.timestamp_micros(us + seconds * 1_000_000).alias("leaves")).withWatermark("leaves", lateness)
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} long, event_id long, allowed boolean", "times array<long>", "append", "EventTimeTimeout")


def windowed_counts(events: DataFrame, lateness: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Events a type and window; rows later than the watermark are left out."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    return stamped.groupBy(F.window("at", window), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
