"""Rank of each row within its key, without one task per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._scratch import Scratch, shuffle_partitions

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def rank_within(df: DataFrame, key: str, order: list[str], scratch: Scratch, name: str = "ranked"):
    """Add ``rank`` (long, from 0) of each row among the rows of its key, in the given order.

    Rows are dealt by range of (key, order), so a key that holds a third of all rows spreads over a
    third of the partitions. Each partition numbers its own sorted rows; the driver sees one row
    for each (partition, key) that occurs, at most partitions + distinct keys, and adds up the
    counts before each. Rows that tie in key and order get distinct ranks; a null key is a key.

    Returns the DataFrame and the rows of each key as a dict.
    """
    spark = scratch.spark
    dealt = (
        df.repartitionByRange(shuffle_partitions(spark), key, *order)
        .sortWithinPartitions(key, *order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    saved = scratch.save(dealt, name)
    part = F.shiftright("_at", _ROW_BITS)
    row = F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)
    runs = (
        saved.groupBy(F.col(key).alias("_key"), part.alias("_part"))
        .agg(F.min(row).alias("_low"), F.count(F.lit(1)).alias("_n"))
        .collect()
    )
    runs.sort(key=lambda r: r["_part"])
    totals: dict = {}
    shifts = []
    for r in runs:
        before = totals.get(r["_key"], 0)
        shifts.append((r["_key"], r["_part"], before - r["_low"]))
        totals[r["_key"]] = before + r["_n"]
    schema = T.StructType(
        [
            T.StructField("_key", df.schema[key].dataType),
            T.StructField("_part", T.LongType()),
            T.StructField("_shift", T.LongType()),
        ]
    )
    moved = F.broadcast(spark.createDataFrame(shifts, schema))
    ranked = (
        saved.withColumn("_p", part)
        .join(moved, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_p") == F.col("_part")))
        .withColumn("rank", row + F.col("_shift"))
        .drop("_at", "_p", "_key", "_part", "_shift")
    )
    return ranked, totals
