"""Garbage-collection logs: events of unified logs by aggregation of records, of older ones by blocks."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import epoch_millis, extracted, parse_bytes
from ..functions.fixed import COLLECTOR_WORDS
from ..operators.ranges import running

# What lines of collection logs look like.
_SIZE = "\\d+(?:\\.\\d+)?\\s*[KMGT]?B?"
TRANSITION = f"({_SIZE})\\s*->\\s*({_SIZE})\\s*\\(\\s*({_SIZE})\\s*\\)"
HEAP = f"Heap:\\s*({_SIZE})\\s*->\\s*({_SIZE})\\s*\\(\\s*({_SIZE})\\s*\\)"
SHARES = f"({_SIZE})\\(\\s*\\d+(?:\\.\\d+)?%\\s*\\)\\s*->\\s*({_SIZE})\\(\\s*\\d+(?:\\.\\d+)?%\\s*\\)"
NOT_HEAP = "\\[?\\s*(?:Metaspace|CMS Perm|PSPermGen|Perm)\\s*:.*?\\](?:,|\\s|$)"
METASPACE = f"Metaspace:\\s*({_SIZE})(?:\\([^)]*\\))?\\s*->\\s*({_SIZE})"
OLD_REGIONS = "Old regions:\\s*(\\d+)\\s*->\\s*(\\d+)"
REGION_SIZE = f"Region Size:\\s*({_SIZE})"
MAX_HEAP = f"Max Heap Size:\\s*({_SIZE})"
MAX_CAPACITY = f"\\bMax Capacity(?: \\((?:small|medium|large)\\))?:\\s*({_SIZE})"
OLD_GENERATION = f"\\[(?:ParOldGen|PSOldGen|Tenured Generation|CMS Old Gen|CMS):\\s*{_SIZE}\\s*->\\s*({_SIZE})"
STATISTICS = "^[A-Za-z][A-Za-z ]{2,48}:.*\\d+(?:\\.\\d+)?\\s*/\\s*\\d+(?:\\.\\d+)?"
TRADITIONAL = "^(?:(\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(?:\\.\\d+)?[+-]\\d{4}):\\s+)?(\\d+(?:\\.\\d+)?):\\s+\\[(Full GC|GC)\\b(.*)$"
LABELS = ["normal", "mixed", "concurrent start", "prepare mixed"]
#: The inside of a parenthesis, which may hold others, as in (System.gc()).
PARENTHESIS = "\\(((?:[^()]|\\([^()]*\\))*)\\)"

KEY = ["snapshot_id", "file"]
COLUMNS = (
    "snapshot_id file seq kind cause at_ms pause_ms heap_before heap_after capacity old_after metaspace_after to_space_exhausted humongous wall_raw line_no".split()
)


def formats(lines: DataFrame, first_lines: int = 400) -> DataFrame:
    """(snapshot_id, file, unified): the first line that is of either format decides; neither is traditional."""
    s = F.trim("text")
    seen = lines.where(s != "").withColumn("nth", F.row_number().over(Window.partitionBy(*KEY).orderBy("line_no"))).where(F.col("nth") <= first_lines)
    unified = s.startswith("[") & (s.contains("][gc") | s.contains("][info][") | s.contains("][warning][gc"))
    told = F.when(unified, True).when(s.rlike(TRADITIONAL), False)
    return seen.groupBy(*KEY).agg(F.coalesce(F.min_by(told, F.when(told.isNotNull(), F.col("line_no"))), F.lit(False)).alias("unified"))


def guess_collector(text: F.Column) -> F.Column:
    lower = F.lower(text)
    told = F.lit("UNKNOWN")
    for name, words in reversed(COLLECTOR_WORDS):
        told = F.when(reduce(or_, [F.contains(lower, F.lit(w)) for w in words]), name).otherwise(told)
    return told


def _last(value: F.Column) -> F.Column:
    return F.max_by(value, F.when(value.isNotNull(), F.col("line_no")))


def _first(value: F.Column) -> F.Column:
    return F.min_by(value, F.when(value.isNotNull(), F.col("line_no")))


def _bytes(text: F.Column, pattern: str, group: int, word: str = "->") -> F.Column:
    """Size in a group of a pattern that no text without the word has; others are not searched."""
    return F.when(F.contains(text, F.lit(word)), parse_bytes(extracted(text, pattern, group)))


def _unified(lines: DataFrame, range_rows: int | None) -> tuple[DataFrame, DataFrame]:
    w = Window.partitionBy(*KEY).orderBy("line_no")
    s = F.trim("text")
    prefix = F.regexp_extract(s, "^((?:\\[[^\\]]*\\]\\s*)*)", 1)
    tokens = F.regexp_extract_all(prefix, F.lit("\\[([^\\]]*)\\]"), F.lit(1))
    pick = lambda pattern: F.get(F.filter("tokens", lambda x: x.rlike(pattern)), 0)
    base = lines.where(s != "").select(*KEY, "line_no", tokens.alias("tokens"), F.ltrim(F.substr(s, F.length(prefix) + 1)).alias("msg"))
    timed = base.select(
        *KEY,
        "line_no",
        "msg",
        extracted(pick("^\\d+(?:\\.\\d+)?s$"), "^([0-9.]+)s$").try_cast("double").alias("own"),
        pick("^\\d{4}[-/]\\d{2}[-/]\\d{2}[T ]\\d{2}:\\d{2}:\\d{2}").alias("wall"),
        F.exists("tokens", lambda x: F.lower(x).startswith("gc")).alias("tagged"),
    )
    m, lower = F.col("msg"), F.lower("msg")
    told = {"uptime": F.col("own"), "region": _bytes(m, REGION_SIZE, 1, "Region Size:")}
    timed = running(timed, KEY, "line_no", lasts=told, length=range_rows).withColumn("uptime", F.coalesce("uptime", F.lit(0.0)))
    has = lambda text, word: F.contains(text, F.lit(word))
    banner = F.when(lower.startswith("using "), F.col("msg"))
    max_heap = _bytes(m, MAX_HEAP, 1, "Max Heap Size:")
    chatter = lower.startswith("using ") | lower.startswith("version:") | lower.startswith("cpus:") | lower.startswith("memory limits") | has(m, "Max Heap Size:") & m.rlike(MAX_HEAP)
    number = F.when(m.startswith("GC("), extracted(m, "^GC\\((\\d+)\\)").try_cast("int"))
    rows = timed.withColumn("gc_id", F.coalesce(number, F.when(F.col("tagged"), F.col("line_no") - 1 + 100_000)))
    rows = rows.withColumn("chatter", chatter).withColumn("inner", F.when(m.startswith("GC("), F.trim(F.regexp_replace("msg", "^GC\\(\\d+\\)\\s*", ""))).otherwise(F.trim("msg")))
    records = rows.where("gc_id is not null and not chatter")
    i, il = F.col("inner"), F.col("il")
    kind = (
        F.when(il.startswith("allocation stall"), "ALLOCATION_STALL")
        .when(il.startswith("pause full"), "FULL")
        .when(has(il, "pause young (mixed)") | il.startswith("pause mixed"), "MIXED")
        .when(il.startswith("pause young"), "YOUNG")
        .when(has(il, "pause remark"), "REMARK")
        .when(has(il, "pause cleanup"), "CLEANUP")
        .when(has(il, "concurrent mark cycle") | has(il, "conc-mark") | il.startswith("garbage collection (") | il.rlike("^(?:major|minor) collection"), "CYCLE")
    )
    # each fact of a line is a column of its own before the records are gathered, so that none is searched for twice
    told = records.withColumn("il", F.lower("inner")).withColumn("told", ~(has(i, "/") & i.rlike(STATISTICS)))
    told = told.withColumn("metaspace", has(i, "Metaspace:")).withColumn("plain", F.when(has(i, "->") & ~F.col("metaspace"), F.regexp_replace(i, NOT_HEAP, " ")))
    heap = lambda g: F.coalesce(F.when(has(i, "Heap:"), _bytes(i, HEAP, g)), _bytes(F.col("plain"), TRANSITION, g))
    share = lambda g: F.when(has(i, "%") & ~F.col("metaspace"), _bytes(i, SHARES, g))
    parens = F.regexp_extract_all(i, F.lit(PARENTHESIS), F.lit(1))
    facts = told.select(
        *KEY, "line_no", "gc_id", "uptime", "region", "told", "il", "inner", "wall", kind.alias("kind"), F.coalesce(heap(1), share(1)).alias("before"), F.coalesce(heap(2), share(2)).alias("after"), heap(3).alias("size"),
        _bytes(i, MAX_CAPACITY, 1, "Max Capacity").alias("most"), F.when(has(i, "Old regions:"), extracted(i, OLD_REGIONS, 2).try_cast("long")).alias("old_regions"), F.when(F.col("metaspace"), _bytes(i, METASPACE, 2)).alias("meta"),
        F.when(has(i, "ms"), extracted(i, "([0-9]+(?:\\.[0-9]+)?)\\s*ms\\b").try_cast("double")).alias("ms"), F.when(has(i, "("), F.filter(parens, lambda x: ~x.rlike(f"(?i)^(?:{_SIZE}%?)$"))).alias("said"),
    )
    facts = facts.withColumn("cause", F.try_element_at(F.filter("said", lambda x: ~F.lower(x).isin(*LABELS)), F.lit(-1))).withColumn("label", F.get(F.filter("said", lambda x: F.lower(x).isin(*LABELS)), 0))
    pause = il.startswith("pause ")
    only = lambda c: F.when(F.col("told"), F.col(c) if isinstance(c, str) else c)
    ms = F.col("ms")
    found = facts.groupBy(*KEY, "gc_id").agg(
        F.min("line_no").alias("line_no"),
        F.max("uptime").alias("at"),
        F.coalesce(_last(only("kind")), F.lit("OTHER")).alias("kind"),
        _last(only(F.when(pause & has(i, "->"), ms))).alias("summary"),
        F.sum(only(F.when(pause & ~has(i, "->"), ms))).alias("phases"),
        _last(only(F.when(il.startswith("allocation stall"), ms))).alias("stall"),
        _last(only("before")).alias("heap_before"),
        _last(only("after")).alias("heap_after"),
        F.coalesce(_last(only("size")), _first(only("most"))).alias("capacity"),
        (_last(only("old_regions")) * _last(F.col("region"))).alias("old_after"),
        _last(only("meta")).alias("metaspace_after"),
        F.coalesce(_last(only("cause")), _first(only("label"))).alias("cause"),
        F.bool_or(F.col("told") & il.rlike("to-space exhausted|evacuation failure|promotion failed")).alias("to_space_exhausted"),
        F.bool_or(F.col("told") & has(il, "humongous allocation")).alias("humongous"),
        _last(F.col("wall")).alias("wall_raw"),
    )
    stw = F.when(F.col("kind") == "ALLOCATION_STALL", F.coalesce("summary", "phases", "stall")).otherwise(F.coalesce("summary", "phases"))
    events = found.withColumn("pause_ms", stw).where("pause_ms is not null or heap_after is not null")
    vocabulary = records.withColumn("nth", F.row_number().over(w)).where("nth <= 300").groupBy(*KEY).agg(F.array_join(F.collect_list("inner"), "\n").alias("words"))
    boot = epoch_millis(F.col("wall")) - (F.col("uptime") * 1000).cast("long")
    logs = rows.groupBy(*KEY).agg(
        _last(banner).alias("banner"), _first(boot).alias("boot_epoch_ms"), _last(max_heap).alias("max_heap_bytes")
    )
    logs = logs.join(vocabulary, KEY, "left").select(
        *KEY, F.coalesce(F.nullif(guess_collector(F.coalesce("banner", F.lit(""))), F.lit("UNKNOWN")), guess_collector(F.coalesce("words", F.lit("")))).alias("collector"), F.lit(True).alias("unified"), "boot_epoch_ms", "max_heap_bytes"
    )
    return events, logs


def _traditional(lines: DataFrame, range_rows: int | None) -> tuple[DataFrame, DataFrame]:
    s = F.trim("text")
    rows = lines.where(s != "").select(*KEY, "line_no", s.alias("s"), s.rlike(TRADITIONAL).alias("start"))
    rows = running(rows, KEY, "line_no", sums={"block": F.col("start").cast("int")}, length=range_rows).where("block > 0")
    inside = Window.partitionBy(*KEY, "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    closed = F.coalesce(F.max((~F.col("start") & F.col("s").contains("[Times:")).cast("int")).over(inside), F.lit(0))
    blocks = rows.withColumn("closed", closed).where("closed = 0").groupBy(*KEY, "block").agg(
        F.min("line_no").alias("line_no"),
        F.min_by("s", "line_no").alias("head"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "s"))), lambda x: x["s"]), "\n").alias("all"),
    )
    head, whole = F.col("head"), F.col("all")
    lower = F.lower("all")
    tail = F.regexp_extract(head, TRADITIONAL, 4)
    measured = F.substring_index(head, "[Times:", 1)
    pauses = F.regexp_extract_all(measured, F.lit("([0-9]+(?:\\.[0-9]+)?)\\s+secs"), F.lit(1))
    plain = F.regexp_replace(head, NOT_HEAP, " ")
    moved = lambda g: parse_bytes(F.try_element_at(F.regexp_extract_all(plain, F.lit(TRANSITION), F.lit(g)), F.lit(-1)))
    heap = lambda g: F.coalesce(_bytes(whole, HEAP, g), moved(g))
    kind = (
        F.when(F.regexp_extract(head, TRADITIONAL, 3) == "Full GC", "FULL")
        .when(lower.contains("(mixed)"), "MIXED")
        .when(lower.contains("initial mark") | lower.contains("remark"), "REMARK")
        .when(lower.contains("concurrent reset") | lower.contains("concurrent-mark"), "CYCLE")
        .otherwise("YOUNG")
    )
    events = blocks.select(
        *KEY,
        "line_no",
        extracted(head, TRADITIONAL, 2).try_cast("double").alias("at"),
        kind.alias("kind"),
        (F.try_element_at(pauses, F.lit(-1)).try_cast("double") * 1000).alias("pause_ms"),
        heap(1).alias("heap_before"),
        heap(2).alias("heap_after"),
        heap(3).alias("capacity"),
        _bytes(whole, OLD_GENERATION, 1).alias("old_after"),
        _bytes(whole, METASPACE, 2, "Metaspace:").alias("metaspace_after"),
        extracted(tail, PARENTHESIS).alias("cause"),
        lower.rlike("to-space exhausted|evacuation failure|promotion failed").alias("to_space_exhausted"),
        lower.contains("humongous allocation").alias("humongous"),
        extracted(head, TRADITIONAL, 1).alias("wall_raw"),
    )
    named = F.lower("head")
    collector = F.when(named.rlike("psyounggen|paroldgen"), "PARALLEL").when(named.contains("g1"), "G1").when(named.contains("cms"), "CMS").when(named.contains("defnew"), "SERIAL")
    logs = blocks.groupBy(*KEY).agg(
        F.coalesce(_first(collector), F.lit("UNKNOWN")).alias("collector"),
        F.lit(False).alias("unified"),
        _first(epoch_millis(extracted(head, TRADITIONAL, 1)) - (extracted(head, TRADITIONAL, 2).try_cast("double") * 1000).cast("long")).alias("boot_epoch_ms"),
        F.lit(None).cast("long").alias("max_heap_bytes"),
    )
    return events, logs


def parse(lines: DataFrame, range_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(gc_logs, gc_events) of any number of logs in either format.

    range_rows: lines that a task numbers, where a log has more of them than one task may hold.
    """
    told = formats(lines)
    parts = []
    for reader, unified in ((_unified, True), (_traditional, False)):
        parts.append(reader(lines.join(told.where(F.col("unified") == unified).select(*KEY), KEY, "left_semi"), range_rows))
    columns = [*KEY, "line_no", "at", "kind", "pause_ms", "heap_before", "heap_after", "capacity", "old_after", "metaspace_after", "cause", "to_space_exhausted", "humongous", "wall_raw"]
    events = parts[0][0].select(*columns).unionByName(parts[1][0].select(*columns))
    numbered = running(events, KEY, "line_no", sums={"nth": F.lit(1)}, length=range_rows).withColumn("seq", (F.col("nth") - 1).cast("int")).withColumn("at_ms", F.round(F.col("at") * 1000).cast("long"))
    return parts[0][1].unionByName(parts[1][1]), numbered.select(*COLUMNS)
