"""Thread dumps: captures, threads, stacks and locks, by window functions over lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import epoch_millis, extracted
from ..operators.ranges import running
from ..sources.workspace import Workspace
from .exceptions import FRAME, frame

# What lines of thread dumps look like.
DATE = "^\\d{4}[-/]\\d{2}[-/]\\d{2}[ T]\\d{2}:\\d{2}:\\d{2}"
MARKER = "^Full thread dump (.+?)?:\\s*$"
HEADER = '^"(.*?)"\\s*(.*)$'
STATE = "^\\s*java\\.lang\\.Thread\\.State:\\s*(\\w+)\\s*(?:\\(([^)]*)\\))?\\s*$"
LOCK = "^\\s*-\\s*(locked|waiting to lock|waiting on|waiting to re-lock in wait\\(\\)|parking to wait for)\\s+<(0x[0-9a-fA-F]+)>\\s*(?:\\(a\\s+(.*?)\\))?\\s*$"
OWNED = "^\\s*-\\s+<(0x[0-9a-fA-F]+)>\\s*(?:\\(a\\s+(.*?)\\))?\\s*$"
OWNED_HEAD = "^\\s*Locked ownable synchronizers:\\s*$"
TRAILER = "(?i)^Found (?:one|another) Java-level deadlock"
TRAILER_END = "(?i)^Found (\\d+) deadlocks?\\."
STATES = ["NEW", "RUNNABLE", "BLOCKED", "WAITING", "TIMED_WAITING", "TERMINATED"]
#: Lines that may lie between two of a thread's.
GAP = 4


def _state(explicit: F.Column, status: F.Column) -> F.Column:
    s = F.lower(F.coalesce(status, F.lit("")))
    said = (
        F.when(s.startswith("runnable"), "RUNNABLE")
        .when(s.startswith("waiting for monitor entry"), "BLOCKED")
        .when(s.startswith("in object.wait"), "WAITING")
        .when(s.startswith("waiting on condition") | s.startswith("parking"), "WAITING")
        .when(s.startswith("sleeping"), "TIMED_WAITING")
        .otherwise("UNKNOWN")
    )
    return F.coalesce(F.when(explicit.isin(*STATES), explicit), said)


def parse(lines: DataFrame, range_rows: int | None = None, space: Workspace | None = None, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(dumps, threads). range_rows: lines that a task numbers, where a file has more of them than one task may hold. space: where to
    write what is read more than once; without one it is computed again each time. columns: those of threads that are asked for beside
    its place, all unless told; Spark computes no others.

    A capture begins at a date line, or at a marker line unless a date line opened it just before. The
    deadlock report after the threads repeats their headers and is kept out of them. Lines of a
    thread lie within GAP lines of the one before; what comes later is not its own.
    """
    key = ["snapshot_id", "file"]
    s, t = F.trim("text"), F.col("text")
    # what a line begins with tells most lines apart, before any pattern is tried
    says_found = F.lower(F.substring(s, 1, 6)) == "found "
    is_date, is_marker, is_end = F.substring(s, 1, 1).between("0", "9") & s.rlike(DATE), s.startswith("Full thread dump ") & s.rlike(MARKER), says_found & s.rlike(TRAILER_END)
    is_trailer = F.coalesce(F.col("trailer") == 1, F.lit(False))
    flags = lines.withColumns(
        {
            "date": is_date,
            "marker": is_marker,
            "trailer": F.when(says_found & s.rlike(TRAILER), 1).when(is_end | is_marker | is_date, 0),
            "header": t.startswith('"') & t.rlike(HEADER) & ~s.endswith(":"),
            "report_end": is_end,
            "vm": F.when(is_marker, F.regexp_extract(s, MARKER, 1)),
            "raw": F.when(is_date, s),
            "stated": F.when(is_end, extracted(s, TRAILER_END).try_cast("int")),
        }
    )
    if space is not None:
        flags = space.written(flags, "lines")
    # the last line that opened or filled a capture tells whether a marker continues a date line
    opened = F.when(F.col("date"), "date").when(F.col("marker") | F.col("header"), "other")
    seen = running(flags, key, "line_no", lasts={"within": F.col("trailer")}, before={"opened": opened}, length=range_rows).withColumn("in_trailer", F.coalesce(F.col("within") == 1, F.lit(False)))
    starts = F.col("date") | F.col("marker") & (F.coalesce("opened", F.lit("other")) == "other")
    inside = ~F.col("in_trailer") & ~F.col("report_end")
    # stanzas are numbered through the file, so one pass numbers captures and stanzas
    cut = running(seen, key, "line_no", sums={"dump": starts.cast("int"), "stanza": (F.col("header") & inside).cast("int")}, length=range_rows)
    within = [*key, "dump"]
    heads = cut.groupBy(*within).agg(
        F.min_by("vm", F.when(F.col("marker"), F.col("line_no"))).alias("vm"),
        F.min_by("raw", F.when(F.col("date"), F.col("line_no"))).alias("captured_at_raw"),
        F.bool_or(is_trailer).alias("vm_reported_deadlock"),
        F.max("stated").alias("stated"),
        F.count_if(is_trailer).alias("found"),
        F.bool_or("marker").alias("has_marker"),
    )
    body = cut.where(inside)
    kind = (
        F.when(F.col("header"), "header")
        .when(F.contains(s, F.lit("java.lang.Thread.State:")) & s.rlike(STATE), "state")
        .when(t.rlike(FRAME), "frame")
        .when(t.rlike(LOCK), "lock")
        .when(t.rlike(OWNED), "owned")
        .when(s.rlike(OWNED_HEAD), "owned head")
    )
    told = body.where("stanza > 0").withColumn("what", kind).where("what is not null")
    own = Window.partitionBy(*within, "stanza").orderBy("line_no")
    content = F.col("what").isin("header", "frame", "lock", "owned")
    last = F.last(F.when(content, F.col("line_no")), True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.when(content, F.col("line_no") - F.coalesce(last, F.col("line_no")))
    kept = told.withColumn("gap", gap).withColumn("far", F.max(F.coalesce(F.col("gap") > GAP, F.lit(False))).over(own)).where("not far or what = 'state'")
    verb = F.regexp_extract(t, LOCK, 1)
    lock_kind = (
        F.when(F.col("what") == "owned", "OWNABLE_HELD")
        .when(verb == "locked", "HELD")
        .when(verb == "waiting to lock", "WAITING_TO_LOCK")
        .when(verb == "waiting on", "WAITING_ON")
        .when(verb == "parking to wait for", "PARKING")
        .otherwise("RE_LOCK_AFTER_WAIT")
    )
    is_owned = F.col("what") == "owned"
    lock = F.struct(
        F.when(is_owned, 1).otherwise(0).alias("later"),
        "line_no",
        F.struct(
            lock_kind.alias("kind"),
            F.lower(F.when(is_owned, F.regexp_extract(t, OWNED, 1)).otherwise(F.regexp_extract(t, LOCK, 2))).alias("addr"),
            F.nullif(F.when(is_owned, F.regexp_extract(t, OWNED, 2)).otherwise(F.regexp_extract(t, LOCK, 3)), F.lit("")).alias("cls"),
            F.col("line_no"),
        ).alias("lock"),
    )
    threads = kept.groupBy(*within, "stanza").agg(
        F.min_by("text", F.when(F.col("what") == "header", F.col("line_no"))).alias("head"),
        F.min_by(F.when(F.col("what") == "state", F.regexp_extract(t, STATE, 1)), F.when(F.col("what") == "state", F.col("line_no"))).alias("explicit"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("what") == "frame", F.struct("line_no", frame(t, F.col("line_no")).alias("f"))))), lambda x: x["f"]).alias("stack"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("what").isin("lock", "owned"), lock))), lambda x: x["lock"]).alias("locks"),
        F.min("line_no").alias("start_line"),
        F.max("line_no").alias("end_line"),
    ).where("head is not null")  # lines of a capture before its first header are no thread's
    attrs = F.regexp_extract("head", HEADER, 2)
    status = F.trim(
        F.regexp_replace(
            F.regexp_replace(attrs, "#\\d+|\\[\\d+\\]|\\bdaemon\\b|\\bos_prio=-?\\d+|\\bprio=\\d+|\\bcpu=[0-9.]+ms|\\belapsed=[0-9.]+s|\\btid=0x[0-9a-fA-F]+|\\bnid=\\S+", " "),
            "\\[0x[0-9a-fA-F.]+[^\\]]*\\]",
            " ",
        )
    )
    threads = threads.select(
        *within,
        "stanza",
        F.regexp_extract("head", HEADER, 1).alias("name"),
        extracted(attrs, "#(\\d+)").try_cast("int").alias("idx"),
        extracted(attrs, "\\bprio=(\\d+)").try_cast("int").alias("prio"),
        extracted(attrs, "\\bos_prio=(\\d+)").try_cast("long").alias("os_prio"),
        extracted(attrs, "\\btid=(0x[0-9a-fA-F]+)").alias("tid"),
        extracted(attrs, "\\bnid=(0x[0-9a-fA-Fx]+|\\d+)").alias("nid"),
        extracted(attrs, "\\bcpu=([0-9.]+)ms").try_cast("double").alias("cpu_ms"),
        extracted(attrs, "\\belapsed=([0-9.]+)s").try_cast("double").alias("elapsed_s"),
        _state(F.col("explicit"), status).alias("state"),
        status.alias("wait_status"),
        "stack",
        "locks",
        "start_line",
        "end_line",
    )
    if columns is not None:
        threads = threads.select(*within, "stanza", *columns)
    if space is not None:
        heads, threads = space.written(heads, "heads"), space.written(threads, "stanzas")
    full = heads.join(threads.groupBy(*within).agg(F.count(F.lit(1)).alias("n_threads")), within, "left").where("has_marker or vm_reported_deadlock or n_threads > 0")
    order = Window.partitionBy("snapshot_id").orderBy("file", "dump")
    dumps = full.select(
        *within,
        F.row_number().over(order).alias("dump_ord"),
        F.nullif("vm", F.lit("")).alias("vm"),
        "captured_at_raw",
        epoch_millis(F.col("captured_at_raw")).alias("captured_at_ms"),
        "vm_reported_deadlock",
        F.coalesce("stated", "found").cast("int").alias("vm_deadlock_count"),
        F.coalesce("n_threads", F.lit(0)).alias("n_threads"),
    )
    if space is not None:
        dumps = space.written(dumps, "captures")
    return dumps, threads.join(dumps.select(*within, "dump_ord"), within)
