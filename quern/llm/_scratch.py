"""Written intermediate tables in the folder that all machines of a cluster share.

A written table cuts lineage and survives the loss of any executor. The folder is the one the
session names in ``spark.checkpoint.dir``; only where that is unset (tests, a laptop) does a
temporary folder of this process stand in.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="quern-"))
    return "file://" + _own_folder[0]


class Scratch:
    """Tables written by one run of one operator, under a folder name of its own."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/quern-{label}-{uuid.uuid4().hex}"

    def inner(self, name: str) -> Scratch:
        """Tables of a step, in a folder of this run."""
        made = Scratch(self.spark, name)
        made.root = self.path(name)
        return made

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and return a reader of what was written."""
        df.write.parquet(self.path(name))
        gc.collect()  # lets Spark delete shuffle files of plans that nothing refers to any more
        self.spark._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def named(column: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def unused(df: DataFrame, name: str) -> str:
    """A column name like that one which df doesn't have (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
