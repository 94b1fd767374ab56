"""The ledger as a stream: windowed counts and sums of call events with late data and repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, ts: str, keys: list[str], value: str, size: str = "1 hour", slide: str | None = None, late: str | None = None) -> DataFrame:
    """window_start, keys, events, total. The same function serves a stream (with `late`) and a table."""
    rows = events.withWatermark(ts, late) if late and events.isStreaming else events
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = rows.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("events"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "events", "total")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """key, session_start, session_end, events."""
    rows = events.withWatermark(ts, late) if late and events.isStreaming else events
    out = rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("events"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def distinct_events(events: DataFrame, ts: str, key: str, late: str | None = None) -> DataFrame:
    """One event per key, kept in state no longer than `late`."""
    if events.isStreaming:
        return events.withWatermark(ts, late or "1 hour").dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what there is and stop."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
