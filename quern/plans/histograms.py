"""Heap histograms: class rows and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import extracted

ROW = "^\\s*(\\d+)\\s*:\\s*(\\d+)\\s+(\\d+)\\s+(\\S.*?)\\s*$"
TOTAL = "(?i)^\\s*total\\s+(\\d+)\\s+(\\d+)\\s*$"
LIVE = "(?i):live|live dump|Number of objects in the heap"
MODULE = "\\s\\((?:<\\w+>|[\\w.$-]+(?:@[\\w.+\\-]+)?)\\)\\s*$"


def parse(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(histos, histo_rows). Without a Total line the rows are summed, and ``note`` says so."""
    key = ["snapshot_id", "file"]
    t = F.col("text")
    rows = lines.where(t.rlike(ROW)).select(
        *key,
        F.regexp_replace(F.regexp_extract(t, ROW, 4), MODULE, "").alias("class_name"),
        extracted(t, ROW, 2).try_cast("long").alias("instances"),
        extracted(t, ROW, 3).try_cast("long").alias("bytes"),
        "line_no",
    )
    heads = lines.groupBy(*key).agg(
        F.bool_or(t.rlike(LIVE)).alias("live"),
        F.max_by(extracted(t, TOTAL, 1).try_cast("long"), F.when(t.rlike(TOTAL), F.col("line_no"))).alias("total_instances"),
        F.max_by(extracted(t, TOTAL, 2).try_cast("long"), F.when(t.rlike(TOTAL), F.col("line_no"))).alias("total_bytes"),
    )
    sums = rows.groupBy(*key).agg(F.sum("instances").alias("sum_instances"), F.sum("bytes").alias("sum_bytes"))
    histos = heads.join(sums, key, "left").select(
        *key,
        "live",
        F.coalesce("total_bytes", "sum_bytes", F.lit(0)).cast("long").alias("total_bytes"),
        F.coalesce("total_instances", "sum_instances", F.lit(0)).cast("long").alias("total_instances"),
        F.when(F.col("total_bytes").isNull(), "no total line: rows were summed").alias("note"),
    )
    return histos, rows
