"""Counts by event time, for a stream or a table: tumbling and sliding windows, and sessions.

On a stream, rows later than the watermark are dropped, and in append mode a window or session is written once, when the watermark has passed its
end; on a table nothing is late and all are returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _measures(value: str | None) -> list[Column]:
    return [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value else [])


def window_counts(events: DataFrame, ts: str, key: str, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes", value: str | None = None) -> DataFrame:
    """(window_start, window_end, key, n) of each window of ``size``, one every ``slide`` if given; ``total`` of ``value`` if given. Rows
    without a time are in no window."""
    rows = events.withWatermark(ts, late).groupBy(F.window(ts, size, slide).alias("w"), key)
    return rows.agg(*_measures(value)).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *_names(key, value))


def session_counts(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes", value: str | None = None) -> DataFrame:
    """(session_start, session_end, key, n): runs of a key's rows that follow each other within ``gap``; the end is the last row's time and the
    gap. A row between two sessions merges them. Rows without a time are in none."""
    rows = events.where(F.col(ts).isNotNull()).withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key)
    return rows.agg(*_measures(value)).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *_names(key, value))


def _names(key: str, value: str | None) -> list[str]:
    return [key, "n"] + (["total"] if value else [])


def append_closed(counts: DataFrame, target: str, checkpoint: str):
    """What the watermark has closed appended to the table at ``target``, each window or session once. Runs what is available and stops."""
    return counts.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).start()
