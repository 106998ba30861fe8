"""Artifacts of many snapshots as one relation of lines.

A snapshot is a folder of text artifacts of one JVM. ``files`` rows are (snapshot_id, file, ord,
content); ``lines`` rows are (snapshot_id, file, ord, line_no, text). Everything downstream is keyed by
(snapshot_id, file), so any number of snapshots is read in one go.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import strip_escapes

MOST_BYTES = 128 * 1024 * 1024
DEEPEST = 3
#: Files that are never artifacts, by name (lower case).
NOISE = "^\\.|\\.(?:hprof|zip|gz|tar|jfr)$|^report\\.(?:md|json)$"

THREAD_DUMP, GC_LOG, HEAP_HISTO, APP_LOG, UNKNOWN = "THREAD_DUMP", "GC_LOG", "HEAP_HISTO", "APP_LOG", "UNKNOWN"


def decode(content: F.Column) -> F.Column:
    """UTF-8 with or without mark, else GBK, else Latin-1. Only what isn't UTF-8 goes to a Python worker."""
    marked = F.hex(F.substring(content, 1, 3)) == "EFBBBF"
    bare = F.when(marked, F.substring(content, F.lit(4), F.octet_length(content))).otherwise(content)
    utf8 = bare.cast("string")
    valid = F.is_valid_utf8(utf8)
    return F.when(valid, utf8).otherwise(not_utf8(F.when(~valid, bare)))


def _gbk_or_latin(content: bytes | None) -> str | None:
    if content is None:
        return None
    try:
        return bytes(content).decode("gbk")
    except UnicodeDecodeError:
        return bytes(content).decode("latin-1")


def gbk_decodes(content: F.Column) -> F.Column:
    def each(parts: pd.Series) -> pd.Series:
        def told(x: bytes) -> bool:
            try:
                return bytes(x).decode("gbk") is not None
            except UnicodeDecodeError:
                return False

        return parts.map(told, na_action="ignore")

    return F.pandas_udf(each, "boolean")(content)


def not_utf8(content: F.Column) -> F.Column:
    def each(parts: pd.Series) -> pd.Series:
        return parts.map(_gbk_or_latin, na_action="ignore")

    return F.pandas_udf(each, "string")(content)


def scan(spark: SparkSession, root: str, snapshot_depth: int | None = 0, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Files under a root, and (file, reason) of those left out.

    snapshot_depth: how many folders below the root name a snapshot (0: the root is one snapshot).
    Content is read only of files within most_bytes; order is by path.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    inner = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^/*\\Q{base.lstrip('/')}\\E/?", "")
    inner = F.coalesce(F.nullif(inner, F.lit("")), F.substring_index("path", "/", -1))  # the root may be a file
    parts = F.split(inner, "/")
    named = found.select("path", "length", "content", inner.alias("file"), F.element_at(parts, -1).alias("name"), F.size(parts).alias("depth"))
    snapshot = F.array_join(F.slice(F.split("file", "/"), 1, snapshot_depth), "/") if snapshot_depth else F.lit(base.rsplit("/", 1)[-1])
    local = F.array_join(F.slice(F.split("file", "/"), snapshot_depth + 1, 100), "/") if snapshot_depth else F.col("file")
    kept = named.where(~F.lower("name").rlike(NOISE) & (F.col("depth") <= DEEPEST + snapshot_depth))
    kept = kept.select(snapshot.alias("snapshot_id"), local.alias("file"), "length", "content")
    large = kept.where(F.col("length") > most_bytes).select("snapshot_id", "file", F.format_string("larger than %d bytes", F.lit(most_bytes)).alias("reason"))
    small = kept.where(F.col("length") <= most_bytes)
    return small.select("snapshot_id", "file", F.col("file").alias("ord"), decode(F.col("content")).alias("content")), large


def from_texts(spark: SparkSession, texts: list[tuple[str, str, str]]) -> DataFrame:
    """Files from (snapshot_id, file, content) in memory."""
    rows = [(s, f, f"{k:06d}", c) for k, (s, f, c) in enumerate(texts)]
    return spark.createDataFrame(rows, "snapshot_id string, file string, ord string, content string")


def lines_of(files: DataFrame) -> DataFrame:
    """Lines numbered from 1: any line end, empty lines at the end dropped, terminal escapes stripped."""
    text = F.regexp_replace(F.coalesce("content", F.lit("")), "(?:\r\n|\r|\n)+\\z", "")
    split = files.select("snapshot_id", "file", "ord", F.posexplode(F.split(text, "\r\n|\r|\n")).alias("pos", "text"))
    return split.select("snapshot_id", "file", "ord", (F.col("pos") + 1).alias("line_no"), strip_escapes(F.col("text")).alias("text"))


# What a line of each kind of artifact looks like.
THREAD_HEADER_LINE = '^"[^"]+"\\s+(?:#\\d+\\b|(?:daemon\\s+)?(?:prio|os_prio|tid)=).*$'
GC_LINE = "^(?:\\[[^\\]]*\\])*\\[\\d+(?:\\.\\d+)?s\\]\\[[^\\]]*\\]\\[[^\\]]*gc|^(?:\\S+:\\s+)?\\d+(?:\\.\\d+)?:\\s+\\[(?:Full GC|GC)\\b"
HISTO_LINE = "^\\s*\\d+\\s*:\\s*\\d+\\s+\\d+\\s+\\S"
STACK_HEAD = "\\b(?:[A-Za-z_$][\\w$]*\\.)+(?:[A-Z][\\w$]*(?:Exception|Error|Throwable|Fault))\\b"


def sniff(lines: DataFrame, first_lines: int = 4000) -> DataFrame:
    """(snapshot_id, file, ord, kind) of each file, by its first non-blank lines, else by its name."""
    near = Window.partitionBy("snapshot_id", "file").orderBy("line_no")
    s = F.trim("text")
    seen = lines.where(s != "").withColumn("nth", F.row_number().over(near)).where(F.col("nth") <= first_lines)
    hits = seen.groupBy("snapshot_id", "file").agg(
        F.bool_or(s.startswith("Full thread dump")).alias("marker"),
        F.count_if(s.rlike(THREAD_HEADER_LINE)).alias("headers"),
        F.count_if(s.startswith("java.lang.Thread.State:") | s.contains(" java.lang.Thread.State:")).alias("states"),
        F.count_if(s.rlike(GC_LINE)).alias("gc"),
        F.count_if(F.col("text").rlike(HISTO_LINE)).alias("histo"),
        F.count_if(s.rlike(STACK_HEAD) & ~s.startswith("at ")).alias("stacks"),
    )
    files = lines.select("snapshot_id", "file", "ord").distinct()
    name = F.lower("file")
    by_name = (
        F.when(name.endswith(".dump") | name.contains("jstack") | name.contains("thread"), THREAD_DUMP)
        .when(name.contains("gc"), GC_LOG)
        .when(name.contains("histo"), HEAP_HISTO)
        .when(name.endswith(".log") | name.endswith(".txt") | name.contains("app"), APP_LOG)
        .otherwise(UNKNOWN)
    )
    kind = (
        F.when(F.col("marker") | (F.col("headers") >= 2) & (F.col("states") >= 1), THREAD_DUMP)
        .when(F.col("gc") >= 2, GC_LOG)
        .when(F.col("histo") >= 3, HEAP_HISTO)
        .when(F.col("stacks") >= 1, APP_LOG)
        .otherwise(by_name)
    )
    return files.join(hits, ["snapshot_id", "file"], "left").select("snapshot_id", "file", "ord", kind.alias("kind"))


def first_of_kind(kinds: DataFrame, multi_log: bool = False) -> tuple[DataFrame, DataFrame]:
    """Artifacts to analyse, and (snapshot_id, kind, kept, dropped, advice) of those a snapshot has too many of.

    A snapshot has one collection log and one histogram, the first by path; with multi_log all stay.
    """
    order = Window.partitionBy("snapshot_id", "kind").orderBy("ord", "file")
    ranked = kinds.withColumn("nth", F.row_number().over(order))
    single = F.col("kind").isin(GC_LOG, HEAP_HISTO) & F.lit(not multi_log)
    kept = ranked.where(~single | (F.col("nth") == 1)).drop("nth")
    skipped = (
        ranked.where(single)
        .groupBy("snapshot_id", "kind")
        .agg(F.min_by("file", "nth").alias("kept"), F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") > 1, F.struct("nth", "file")))), lambda x: x["file"]).alias("dropped"))
        .where(F.size("dropped") > 0)
        .withColumn("advice", F.format_string("%s was analysed; put %s into snapshots of their own", "kept", F.array_join("dropped", ", ")))
    )
    return kept, skipped


def merged(parts: list[DataFrame]) -> DataFrame:
    """Files of several paths as one snapshot's; the first path comes first."""
    out = None
    for k, part in enumerate(parts):
        moved = part.withColumn("ord", F.concat(F.lit(f"{k:04d}/"), F.col("ord")))
        out = moved if out is None else out.unionByName(moved)
    return out
