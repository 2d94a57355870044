"""Counts over event time from a stream: sliding windows and sessions by gap, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, *by: str, size: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """start, end, by and n. Rows later than `late` behind the newest are dropped by the stream."""
    w = F.window(ts, size, slide or size)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def session_counts(events: DataFrame, ts: str, key: str, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    s = F.session_window(ts, gap)
    return events.withWatermark(ts, late).groupBy(s.alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
