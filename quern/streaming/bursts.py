"""Streaming forms of two rules; on bounded input they give what the batch queries give.

Both take a stream of (key, ts). Late rows beyond the watermark are dropped, which the batch forms don't do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bursts(stream: DataFrame, key: str, ts: str, bucket: str = "1 minute", least: int = 10, late: str = "5 minutes") -> DataFrame:
    """Epoch-aligned buckets of a key with at least so many rows (EXC003)."""
    counted = stream.withWatermark(ts, late).groupBy(key, F.window(ts, bucket)).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least).select(key, F.col("window.start").alias("start"), "n")


def sliding_rate(stream: DataFrame, key: str, ts: str, window: str = "5 minutes", slide: str = "1 minute", least: int = 2, late: str = "5 minutes") -> DataFrame:
    """Sliding windows of a key with at least so many rows: GCA001 to the resolution of the slide."""
    counted = stream.withWatermark(ts, late).groupBy(key, F.window(ts, window, slide)).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least).select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")
