"""Application logs: exception stacks with their chains of causes, as islands of lines."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import epoch_millis, extracted, stamp_in
from ..functions.fixed import LEVELS
from ..operators.ranges import beside, running

# What lines of a stack look like.
ENDS = ["Exception", "Error", "Throwable", "Fault"]
#: A qualified name of which the last part ends so and is longer. No part of it is matched in two ways, so a search takes time in proportion to the line.
THROWABLE = "([A-Za-z_$][\\w$]*+(?:\\.[A-Za-z_$][\\w$]*+)*+(?<=" + "|".join(f"[\\w$]{end}" for end in ENDS) + "))"
HEAD = f"^\\s*(?:(Caused by|Suppressed)\\s*:\\s*)?{THROWABLE}(?::\\s?(.*))?$"
AFTER_LEVEL = "^[^\\n]*?\\b(?:ERROR|SEVERE|FATAL|WARN|WARNING)\\b([^\\n]*)$"
#: In what follows a level: a name after white space, with or without a sign between.
HEAD_AFTER_LEVEL = f"(?:(?<=\\s)|(?<=\\s[:\\-])){THROWABLE}(?::\\s?(.*))?$"
MORE = "^\\s*\\.\\.\\.\\s*\\d+\\s*(?:more|common frames omitted|filtered)"
FRAME = "^\\s*at\\s+(\\S+)\\((.*?)\\)\\s*(?:~\\[.*\\])?\\s*$"
MODULE = "^[\\w.$-]+@[\\w.+\\-]+/|^[\\w.$-]+//?"
LEVEL = "\\b(" + "|".join(LEVELS) + ")\\b"


def frame(text: F.Column, line_no: F.Column) -> F.Column:
    """Struct of a frame line, null for any other line."""
    place = F.regexp_replace(F.regexp_extract(text, FRAME, 2), MODULE, "")
    named = F.regexp_replace(F.regexp_extract(text, FRAME, 1), MODULE, "")
    method = F.substring_index(named, ".", -1)
    cls = F.when(F.contains(named, F.lit(".")), F.left(named, F.length(named) - F.length(method) - 1)).otherwise("<unknown>")
    native = (place == "") | (F.lower(place) == "native method")
    known = ~native & (F.lower(place) != "unknown source")
    file = F.when(known, F.regexp_replace(place, ":\\d+$", ""))
    line = F.when(known, extracted(place, ":(\\d+)$").try_cast("int"))
    made = F.struct(cls.alias("cls"), method.alias("method"), file.alias("src_file"), line.alias("src_line"), native.alias("native"), line_no.alias("line_no"))
    return F.when(text.rlike(FRAME), made)


def classified(lines: DataFrame) -> DataFrame:
    """snapshot_id, file, line_no, text and what each line is by itself: head, cause, frame, more, blank (which goes on with a stack if a frame follows) or end; with class, message, frame and stamp."""
    t = F.col("text")
    named = reduce(or_, [F.contains(t, F.lit(end)) for end in ENDS])
    is_head, rest = named & t.rlike(HEAD), F.when(named, F.regexp_extract(t, AFTER_LEVEL, 1))
    after_prefix = F.coalesce(rest.rlike(HEAD_AFTER_LEVEL), F.lit(False))
    link = F.regexp_extract(t, HEAD, 1)
    at_line = F.ltrim(t).startswith("at ")
    return lines.select(
        "snapshot_id",
        "file",
        "line_no",
        "text",
        at_line.alias("at_line"),
        F.when(is_head & (link == "Caused by"), "cause")
        .when(is_head & (link == "Suppressed"), "end")
        .when(is_head | after_prefix & ~at_line, "head")
        .when(t.rlike(FRAME), "frame")
        .when(t.rlike(MORE), "more")
        .when(F.trim(t) == "", "blank")
        .otherwise("end")
        .alias("what"),
        F.when(is_head, F.regexp_extract(t, HEAD, 2)).when(after_prefix, F.regexp_extract(rest, HEAD_AFTER_LEVEL, 1)).alias("cls"),
        F.when(is_head, F.regexp_extract(t, HEAD, 3)).when(after_prefix, F.regexp_extract(rest, HEAD_AFTER_LEVEL, 2)).alias("message"),
        F.when(~at_line, stamp_in(t)).alias("stamp"),
    )


def told(stacks: DataFrame) -> DataFrame:
    """The exceptions table of stacks with the text of their first line and its stamp."""
    return stacks.select("snapshot_id", "file", "occ", extracted(F.col("first_text"), LEVEL).alias("level"), "ts_raw", epoch_millis(F.col("ts_raw")).alias("epoch_ms"), "chain", "start_line", "end_line")


def parse(lines: DataFrame, range_rows: int | None = None) -> DataFrame:
    """exceptions: one row per stack, with level, stamp and chain (outermost first).

    range_rows: lines that a task numbers, where a file has more of them than one task may hold.

    A root head always begins a stack. Frames, causes, "... more" lines and a blank line before a
    frame continue it; anything else ends it, and a cause after an end begins a stack of its own.
    A stack without frames is none. Time stamps stand on the head's line or up to three above it.
    """
    key, t = ["snapshot_id", "file"], F.col("text")
    looks = {"next_at": ("at_line", 1)} | {f"stamp{k}": ("stamp", -k) for k in (1, 2, 3)}
    near = beside(classified(lines), key, "line_no", looks, range_rows)
    what = F.when((F.col("what") == "blank") & ~F.coalesce("next_at", F.lit(False)), "end").otherwise(F.col("what"))
    marked = near.withColumns({"what": what, "seen_stamp": F.coalesce("stamp", "stamp1", "stamp2", "stamp3")})
    islands = running(marked, key, "line_no", sums={"island": F.col("what").isin("head", "end").cast("int")}, length=range_rows)
    inside = Window.partitionBy(*key, "island").orderBy("line_no")
    first_cause = F.min(F.when(F.col("what") == "cause", F.col("line_no"))).over(Window.partitionBy(*key, "island"))
    has_head = F.max((F.col("what") == "head").cast("int")).over(Window.partitionBy(*key, "island")) == 1
    members = islands.withColumn("first_cause", first_cause).withColumn("has_head", has_head)
    members = members.where((F.col("what") != "end") & (F.col("has_head") | (F.col("line_no") >= F.col("first_cause"))))
    members = members.withColumn("link", F.sum((F.col("what") == "cause").cast("int")).over(inside))
    part = [*key, "island", "link"]
    links = members.groupBy(*part).agg(
        F.min_by("cls", F.when(F.col("what").isin("head", "cause"), F.col("line_no"))).alias("cls"),
        F.min_by("message", F.when(F.col("what").isin("head", "cause"), F.col("line_no"))).alias("message"),
        F.array_sort(F.collect_list(F.when(F.col("what") == "frame", F.struct("line_no", frame(t, F.col("line_no")).alias("f"))))).alias("numbered"),
        F.min("line_no").alias("start_line"),
        F.max(F.when(F.col("what") != "blank", F.col("line_no"))).alias("end_line"),
        F.min_by("text", "line_no").alias("first_text"),
        F.min_by("seen_stamp", "line_no").alias("stamp"),
    )
    node = F.struct("link", F.struct("cls", F.nullif("message", F.lit("")).alias("message"), F.transform("numbered", lambda x: x["f"]).alias("frames")).alias("node"))
    stacks = links.groupBy(*key, "island").agg(
        F.transform(F.array_sort(F.collect_list(node)), lambda x: x["node"]).alias("chain"),
        F.min("start_line").alias("start_line"),
        F.max("end_line").alias("end_line"),
        F.min_by("first_text", "start_line").alias("first_text"),
        F.min_by("stamp", "start_line").alias("ts_raw"),
    )
    real = stacks.where(F.exists("chain", lambda c: F.size(c["frames"]) > 0))
    return told(running(real, key, "start_line", sums={"occ": F.lit(1)}, length=range_rows).withColumn("occ", F.col("occ").cast("int")))
