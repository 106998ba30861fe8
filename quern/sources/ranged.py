"""Lines of files of any size, read by byte ranges.

Spark's text reader cuts files into splits and reads them in many tasks, but its rows don't tell which line of
the file they are. Here each row is written once with its split and its place there; lines of a split are counted,
a scan of the counts (a row for each split) gives what lies before each, and with it every line its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.exprs import strip_escapes
from .artifacts import DEEPEST, NOISE, gbk_decodes, not_utf8
from .workspace import Workspace

#: Splits that are few enough to be sent to every task; with more of them lines are shuffled to meet their splits.
FEW_SPLITS = 100_000


def _placed(found: DataFrame, root: str, snapshot_depth: int) -> DataFrame:
    """found with snapshot_id, file and name by the path under the root, without what is no artifact."""
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    inner = F.regexp_replace(F.regexp_replace(path, "^[a-z]+:/*", "/"), f"^/*\\Q{base.lstrip('/')}\\E/?", "")
    inner = F.coalesce(F.nullif(inner, F.lit("")), F.substring_index(path, "/", -1))  # the root may be a file
    parts = F.split(inner, "/")
    snapshot = F.array_join(F.slice(parts, 1, snapshot_depth), "/") if snapshot_depth else F.lit(base.rsplit("/", 1)[-1])
    local = F.array_join(F.slice(parts, snapshot_depth + 1, 100), "/") if snapshot_depth else inner
    kept = found.where(~F.lower(F.element_at(parts, -1)).rlike(NOISE) & (F.size(parts) <= DEEPEST + snapshot_depth))
    return kept.withColumns({"snapshot_id": snapshot, "file": local})


def read_lines(spark: SparkSession, root: str, space: Workspace, snapshot_depth: int = 0, most_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lines, left_out): lines as ``artifacts.lines_of`` gives them, of files of any size; (snapshot_id, file, reason).

    A file is cut where the session cuts files (spark.sql.files.maxPartitionBytes); only lines have to fit in a task. Line ends are
    CR, LF or both; empty lines at the end are dropped, and a file without any other has one empty line. A file
    that isn't UTF-8 as a whole is GBK as a whole, else Latin-1. With most_bytes, larger files are left out.
    """
    key = ["snapshot_id", "file"]
    listed = _placed(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root), root, snapshot_depth)
    listed = space.written(listed.select(*key, F.col("_metadata.file_size").alias("bytes")), "files")
    fits = F.lit(True) if most_bytes is None else F.col("_metadata.file_size") <= most_bytes
    read = _placed(spark.read.option("recursiveFileLookup", True).text(root).where(fits), root, snapshot_depth)
    # numbers of one task grow as it reads, and a split is read in one piece by one task
    rows = space.written(read.select(*key, F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("raw")), "rows")
    full = F.when(F.octet_length("raw") > 0, F.col("at"))
    counted = rows.groupBy(*key, "split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), F.max(full).alias("last"), F.bool_and(F.is_valid_utf8(F.col("raw").cast("string"))).alias("valid"))
    of_file = Window.partitionBy(*key)
    upto = of_file.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    scanned = counted.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    last = F.col("before") + F.col("last") - F.col("first") + 1
    scanned = scanned.withColumns({"keep": F.coalesce(F.max(last).over(of_file), F.lit(0)), "utf8": F.min("valid").over(of_file)})
    splits = space.written(scanned.select(*key, "split", "first", "before", "keep", "utf8"), "splits")
    n_splits, other = splits.agg(F.count(F.lit(1)), F.count_if(~F.col("utf8"))).first()
    sent = F.broadcast(splits) if n_splits <= FEW_SPLITS else splits
    numbered = rows.join(sent, [*key, "split"]).withColumn("line_no", (F.col("before") + F.col("at") - F.col("first") + 1).cast("int")).where(F.col("line_no") <= F.col("keep"))
    text = F.col("raw").cast("string")
    if other:
        gbk = numbered.where(~F.col("utf8")).groupBy(*key).agg(F.bool_and(gbk_decodes(F.col("raw"))).alias("gbk"))
        gbk = space.written(gbk, "charsets")
        numbered = numbered.join(F.broadcast(gbk) if n_splits <= FEW_SPLITS else gbk, key, "left")
        text = F.when(F.col("utf8"), text).when(F.col("gbk"), not_utf8(F.when(F.col("gbk"), F.col("raw")))).otherwise(F.decode("raw", "ISO-8859-1"))
    lines = numbered.select(*key, F.col("file").alias("ord"), "line_no", strip_escapes(text).alias("text"))
    over = F.lit(False) if most_bytes is None else F.col("bytes") > most_bytes
    nothing = listed.where(~over).join(splits.where("keep > 0").select(*key).distinct(), key, "left_anti")
    empty = nothing.select(*key, F.col("file").alias("ord"), F.lit(1).alias("line_no"), F.lit("").alias("text"))
    left_out = listed.where(over).select(*key, F.format_string("larger than %d bytes", F.lit(most_bytes or 0)).alias("reason"))
    plain = T.StructType([T.StructField(f.name, f.dataType) for f in lines.schema])
    return lines.unionByName(empty).to(plain), left_out
