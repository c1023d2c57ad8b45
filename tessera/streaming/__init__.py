"""Structured Streaming over the same frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows and sums a window and key; on a stream, state older than the watermark is dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))
