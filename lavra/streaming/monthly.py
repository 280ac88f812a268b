"""A streaming form of the monthly counts: event-time months with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def monthly_counts(stream: DataFrame, time: str, value: str, keys: list[str] = [], late: str = "31 days", window: str = "1 day") -> DataFrame:
    """Rows and sums per window of event time; rows later than ``late`` behind the newest are left out. Works on
    a stream and on a table. Months differ in length, so windows are days; ``roll_up`` makes months of them."""
    timed = stream.withColumn("_t", F.col(time).cast("timestamp"))
    if stream.isStreaming:
        timed = timed.withWatermark("_t", late)
    grouped = timed.groupBy(F.window("_t", window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.col("w.start").alias("start"), *keys, "n", "total")


def roll_up(daily: DataFrame, keys: list[str] = []) -> DataFrame:
    """Months of daily windows: counts and sums add up."""
    return daily.groupBy(F.date_format("start", "yyyy-MM").alias("period"), *keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
