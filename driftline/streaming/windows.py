"""Streaming forms of the weekly buckets and the sessions; batch frames give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly(events: DataFrame, time: str, keys: list[str], value: str, late: str = "1 day") -> DataFrame:
    """Count and sum in weeks from Monday, closed once the watermark has passed."""
    # 1970-01-05 was a Monday
    week = F.window(time, "7 days", "7 days", "4 days").alias("week")
    return events.withWatermark(time, late).groupBy(week, *keys).agg(F.count("*").alias("rows"), F.sum(value).alias("total")).select(F.col("week.start").alias("week"), *keys, "rows", "total")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """First and last row's time and the number of rows of each session."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), *keys).agg(F.count("*").alias("rows"), F.min(time).alias("started"), F.max(time).alias("ended")).select(*keys, "started", "ended", "rows")
