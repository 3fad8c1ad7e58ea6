"""Running counts of incoming laboratory values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def element_stats(values: DataFrame, time_col: str = "ts", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(window, element, n, lowest, highest, mean) of a stream of (ts, element, value); values later than ``late`` are left out."""
    held = values.withWatermark(time_col, late) if values.isStreaming else values
    return held.groupBy(F.window(time_col, window), "element").agg(
        F.count("value").alias("n"), F.min("value").alias("lowest"), F.max("value").alias("highest"), F.avg("value").alias("mean")
    )
