"""An extension: item popularity over event-time windows of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_popularity(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """events: ts (timestamp), item_id; batch or stream. Counts of each item in each window; rows later than `late` are dropped on a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "item_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "item_id", "n")
