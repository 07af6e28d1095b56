"""Event-time aggregation. Each function works on batch and on streaming tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.temporal import interval_join


def _late(df: DataFrame, ts: str, watermark: str | None) -> DataFrame:
    return df.withWatermark(ts, watermark) if watermark and df.isStreaming else df


def tumbling_counts(events: DataFrame, *, ts: str = "ts", every: str = "1 hour", by: str = "event_type", value: str = "value", watermark: str | None = "10 minutes") -> DataFrame:
    """window_start, by, n, total per window of a fixed length."""
    return _windowed(events, F.window(ts, every), ts, by, value, watermark)


def sliding_counts(events: DataFrame, *, ts: str = "ts", length: str = "2 hours", every: str = "1 hour", by: str = "event_type", value: str = "value", watermark: str | None = "10 minutes") -> DataFrame:
    return _windowed(events, F.window(ts, length, every), ts, by, value, watermark)


def _windowed(events: DataFrame, window, ts: str, by: str, value: str, watermark: str | None) -> DataFrame:
    grouped = _late(events, ts, watermark).groupBy(window.alias("w"), F.col(by))
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")


def session_counts(events: DataFrame, *, ts: str = "ts", gap: str = "6 hours", by: str = "user_id", watermark: str | None = "10 minutes") -> DataFrame:
    """by, session_start, session_end, n: runs of events without a gap of that length."""
    grouped = _late(events, ts, watermark).groupBy(F.session_window(ts, gap).alias("w"), F.col(by))
    return grouped.agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def once(events: DataFrame, key: str, *, ts: str = "ts", watermark: str = "10 minutes") -> DataFrame:
    """Events without those whose key came before, within the watermark if the table is a stream."""
    return events.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def followed(first: DataFrame, then: DataFrame, *, by: str = "user_id", ts: str = "ts", within: str = "1 hour", how: str = "inner", watermark: str = "10 minutes") -> DataFrame:
    """Events of ``first`` with those of ``then`` of the same ``by`` less than ``within`` later (columns next_...); how="left" keeps events that nothing follows.

    Of two streams, both sides are state until the watermark has passed what could meet them; an event that nothing follows comes out
    then. An event later than the watermark may meet what is still kept, and nothing that is gone.
    """
    streams = first.isStreaming or then.isStreaming
    return interval_join(first, then, key=by, ts=ts, within=within, how=how, watermark=watermark if streams else None)
