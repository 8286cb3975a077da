"""Structured Streaming forms of the log's operators, for logs that are still written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def domain_counts(events: DataFrame, ts: str, by: list[str], window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events for each window and key; what is later than `late` is left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("window"), *by).agg(F.count("*").alias("n"))


def first_wins(events: DataFrame, ts: str, key: list[str], late: str = "10 minutes") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)
