"""Scalar functions as Column -> Column. None of them is a UDF, and none fails on odd input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def _starts_with_any(column: Column, prefixes: list[str]) -> Column:
    return column.rlike("^(?:" + "|".join(p.replace(".", "\\.").replace("$", "\\$") for p in prefixes) + ")")


def extracted(column: Column, pattern: str, group: int = 1) -> Column:
    """regexp_extract with null for no match or an empty one."""
    return F.nullif(F.regexp_extract(column, pattern, group), F.lit(""))


def parse_bytes(column: Column) -> Column:
    """'12.5M', '1,024K', '3 GB', '17' -> bytes by powers of 1024, truncated; null for anything else."""
    text = F.upper(F.translate(column, ", \t\n\r\f\x0b", ""))
    number = F.when(text.rlike("^\\d+(?:\\.\\d+)?[KMGT]?B?$"), F.rtrim(text, F.lit("KMGTB")).try_cast("double"))
    unit = F.right(F.rtrim(text, F.lit("B")), F.lit(1))
    scale = F.when(unit == "K", 2.0**10).when(unit == "M", 2.0**20).when(unit == "G", 2.0**30).when(unit == "T", 2.0**40).otherwise(1.0)
    return (number * scale).try_cast("long")


def mebibytes(column: Column) -> Column:
    return F.format_string("%.0fM", column / 1048576.0)


def human_bytes(column: Column) -> Column:
    return (
        F.when(column < 1024, F.format_string("%d B", column))
        .when(column < 1024**2, F.format_string("%.1f KB", column / 1024.0))
        .when(column < 1024**3, F.format_string("%.1f MB", column / 1048576.0))
        .otherwise(F.format_string("%.2f GB", column / 1073741824.0))
    )


def stamp_in(column: Column) -> Column:
    """First time stamp within a text, as written."""
    return extracted(column, f"({fixed.STAMP_IN_TEXT})")


def epoch_millis(column: Column) -> Column:
    """Milliseconds of a stamp in any known format, session time zone if it has none; null if none fits."""
    text = F.trim(F.regexp_replace(F.translate(column, "[]", "  "), " +", " "))
    text = F.regexp_replace(text, "^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) (?=[A-Z][a-z]{2} \\d{2} )", "")
    return F.unix_millis(F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in fixed.STAMP_FORMATS]))


def frame_id(cls: Column, method: Column) -> Column:
    return F.concat(cls, F.lit("#"), method)


def frame_display(cls: Column, method: Column, file: Column, line: Column, native: Column) -> Column:
    at = F.concat(F.lit("at "), cls, F.lit("."), method)
    place = F.when(native, " (Native Method)").when(file.isNull(), " (Source File Unknown)").otherwise(
        F.concat(F.lit("("), file, F.coalesce(F.concat(F.lit(":"), line.cast("string")), F.lit("")), F.lit(")"))
    )
    return F.concat(at, place)


def is_jdk(cls: Column) -> Column:
    return _starts_with_any(F.lower(cls), fixed.JDK_PREFIXES)


def is_framework(cls: Column) -> Column:
    return _starts_with_any(F.lower(cls), fixed.FRAMEWORK_PREFIXES)


def is_business(cls: Column) -> Column:
    return ~is_jdk(cls) & ~is_framework(cls)


def base_class(name: Column) -> Column:
    """Element class of a JVM array descriptor, other names as they are: [[Lp.C; -> p.C, [B -> B."""
    bare = F.regexp_replace(name, "^\\[+", "")
    return F.when(name.startswith("[") & bare.rlike("^L.*;$"), F.regexp_replace(bare, "^L|;$", "")).otherwise(bare)


def is_primitive_array(name: Column) -> Column:
    return name.rlike("^\\[+[BCDFIJSZ]$")


def is_object_array(name: Column) -> Column:
    return name.rlike("^\\[+L")


def quotient(a: Column, b: Column) -> Column:
    """a / b by the rules of IEEE 754: over zero an infinity, or NaN of zero by zero, instead of an error."""
    a, b = a.cast("double"), b.cast("double")
    sign = F.signum(a) * F.when(b.cast("string").startswith("-"), -1.0).otherwise(1.0)  # -0.0 has one
    over_zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).otherwise(sign * F.lit(float("inf")))
    return F.when(b == 0, over_zero).otherwise(a / b)


def name_family(name: Column) -> Column:
    """Thread name without its numbers: inner ones become N, a trailing one goes; a blank rest keeps the name."""
    inner = F.regexp_replace(name, "(?<=\\D)[-_]\\d+(?=\\D)", "-N")
    family = F.regexp_replace(inner, "[-_#]?\\d+$", "")
    return F.when(F.trim(family) == "", name).otherwise(family)


def _ids(stack: Column, depth: int) -> Column:
    return F.transform(F.slice(stack, 1, depth), lambda f: frame_id(f["cls"], f["method"]))


def stack_fingerprint(state: Column, stack: Column, depth: int = 5) -> Column:
    """STATE|id;id;… of the top frames; lines of code don't matter."""
    return F.concat(state, F.lit("|"), F.array_join(F.transform(_ids(stack, depth), lambda i: F.concat(i, F.lit(";"))), ""))


def exception_fingerprint(chain: Column, depth: int = 5) -> Column:
    root = root_cause(chain)
    return F.concat(root["cls"], F.lit("|"), F.array_join(F.transform(_ids(root["frames"], depth), lambda i: F.concat(i, F.lit(";"))), ""))


def root_cause(chain: Column) -> Column:
    return F.try_element_at(chain, F.lit(-1))


def outermost(chain: Column) -> Column:
    return F.try_element_at(chain, F.lit(1))


def first_business_frame(frames: Column) -> Column:
    return F.get(F.filter(frames, lambda f: is_business(f["cls"])), 0)


def simple_name(cls: Column) -> Column:
    return F.substring_index(cls, ".", -1)


def waiting_monitor(locks: Column) -> Column:
    """The lock a thread waits for: the last it waits to lock, else to lock again, else parks for. Waiting on one is not."""
    last = lambda kind: F.try_element_at(F.filter(locks, lambda k: k["kind"] == kind), F.lit(-1))
    return F.coalesce(last("WAITING_TO_LOCK"), last("RE_LOCK_AFTER_WAIT"), last("PARKING"))


def held_monitors(locks: Column) -> Column:
    return F.filter(locks, lambda k: k["kind"] == "HELD")


def held_synchronizers(locks: Column) -> Column:
    """Owned synchronisers first, then monitors."""
    return F.concat(F.filter(locks, lambda k: k["kind"] == "OWNABLE_HELD"), held_monitors(locks))


def jvm_internal_name(name: Column) -> Column:
    return F.coalesce(F.trim(name).rlike("(?i)" + fixed.JVM_THREAD_NAME), F.lit(False))


def vm_worker(stack: Column, locks: Column) -> Column:
    return (F.size(stack) == 0) & (F.size(locks) == 0)


def _among_top(stack: Column, ids: list[str], depth: int = 6) -> Column:
    ends = "(?i)(?:" + "|".join(i.replace(".", "\\.").replace("$", "\\$") for i in ids) + ")$"
    return F.exists(_ids(stack, depth), lambda i: i.rlike(ends))


def idle_worker(state: Column, stack: Column, wait_status: Column) -> Column:
    quiet = F.coalesce(~state.isin("RUNNABLE", "BLOCKED"), F.lit(True))
    none = (F.size(stack) == 0) & F.coalesce(F.lower(wait_status).contains("object.wait"), F.lit(False))
    return quiet & (_among_top(stack, fixed.IDLE_FRAMES) | none)


def sleeping(state: Column, stack: Column) -> Column:
    top = F.get(stack, 0)
    return F.coalesce((state == "TIMED_WAITING") & (frame_id(top["cls"], top["method"]) == "java.lang.Thread#sleep"), F.lit(False))


def socket_blocked(state: Column, stack: Column) -> Column:
    return F.coalesce(state == "RUNNABLE", F.lit(False)) & _among_top(stack, fixed.SOCKET_FRAMES)


def server_pool(family: Column) -> Column:
    return family.rlike(fixed.SERVER_POOLS)


def tool_induced(cause: Column) -> Column:
    return F.coalesce(cause.rlike("|".join(fixed.TOOL_CAUSES)), F.lit(False))


def not_heap_pressure(cause: Column, at_ms: Column, settle_sec: float) -> Column:
    boot = F.coalesce(cause.contains(fixed.METADATA_CAUSE), F.lit(False)) & (at_ms <= settle_sec * 1000)
    return tool_induced(cause) | boot


def is_major(kind: Column, collector: Column) -> Column:
    return (kind == "FULL") | (kind == "CYCLE") & collector.isin("ZGC", "SHENANDOAH")


def major_noun(collector: Column) -> Column:
    """What a report calls major collections; of ZGC the whole-heap cycles are what others have full ones for."""
    return F.when(collector == "ZGC", "whole-heap concurrent cycles").otherwise("Full GC collections")


def major_label(collector: Column) -> Column:
    return F.when(collector == "ZGC", "cycle").otherwise("Full GC")


def old_after_mb(old_after: Column) -> Column:
    """Whole mebibytes; the other sizes of an event are fractions (as_mb)."""
    return F.floor(old_after / 1048576).cast("long")


def as_mb(size: Column) -> Column:
    return size / 1048576.0


def fatal_error(cls: Column) -> Column:
    named = cls.rlike("OutOfMemory|StackOverflow|NoClassDef|Linkage")
    return named | cls.endswith("Error") & ~cls.contains("Exception")


def mask_files(text: Column) -> Column:
    return F.regexp_replace(text, "\\S+\\.(?:dump|log|txt|histo|out|jstack)\\b", "<file>")


def quote(line: Column, longest: int = 200) -> Column:
    text = F.rtrim(line)
    return F.when(F.length(text) > longest, F.concat(F.left(text, F.lit(longest - 1)), F.lit("…"))).otherwise(text)


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, fixed.SEVERITIES)), severity).cast("int") - 1


def strip_escapes(line: Column) -> Column:
    """Terminal escape sequences go; lines without ESC are untouched but for the bell."""
    esc = "\\u001B"
    for pattern in (f"{esc}\\[[0-9;?]*[ -/]*[@-~]", f"{esc}\\][^\\u0007{esc}]*(?:\\u0007|{esc}\\\\)?", f"{esc}[@-Z\\\\-_=>]?"):
        line = F.when(F.contains(line, F.lit("\x1b")), F.regexp_replace(line, pattern, "")).otherwise(line)
    return F.translate(line, "\x07", "")
