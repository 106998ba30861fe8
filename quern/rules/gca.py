"""Rules over collection logs."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Thresholds
from ..functions import fixed
from ..functions.exprs import is_major, not_heap_pressure
from ..operators.series import densest_window, evenly_spaced, percentiles, top_k
from .base import Rule, Tables, findings, first_few, ordered, span, with_evidence

KEY = ["snapshot_id", "file"]


def events(t: Tables) -> DataFrame:
    return t.gc_events.join(t.gc_logs.select(*KEY, "collector"), KEY).withColumn("major", is_major(F.col("kind"), F.col("collector")))


def pressure_majors(t: Tables, c: Thresholds) -> DataFrame:
    return events(t).where(F.col("major") & ~not_heap_pressure(F.col("cause"), F.col("at_ms"), c.gc_settle_sec))


def full_gc_rate(t: Tables, c: Thresholds) -> DataFrame:
    """Densest window of majors: the rate over the time to the last major, at most the window."""
    majors = pressure_majors(t, c)
    window = c.gc_window * 1000
    best = densest_window(majors, KEY, "at_ms", "seq", window).where("n >= 2")
    last = majors.groupBy(*KEY).agg(F.max("at_ms").alias("last_ms"))
    span_ms = F.least(F.lit(window), F.col("last_ms") - F.col("start_ms"))
    minutes = F.greatest(span_ms / 60000.0, F.lit(min(1.0, c.gc_window / 60.0)))
    rated = best.join(last, KEY).withColumn("rate", F.col("n") / minutes).where(F.col("rate") >= c.full_gc_per_min)
    own = majors.join(rated.select(*KEY, "start_ms"), KEY).where((F.col("at_ms") >= F.col("start_ms")) & (F.col("at_ms") <= F.col("start_ms") + window))
    shown = first_few(own, KEY, [F.col("seq")], span("file", "line_no", note=F.col("cause")), c.max_evidence)
    rows = rated.join(shown, KEY)
    return findings(
        rows, "GCA001", "Full GC storm", "GC_LOG", F.when(F.col("rate") >= 3 * c.full_gc_per_min, "CRITICAL").otherwise("HIGH"), F.least(F.lit(0.95), 0.7 + 0.02 * F.col("n")),
        F.format_string("%d major collections at %.2f per minute", "n", "rate"), F.col("evidence"), {"count": F.col("n"), "perMinute": F.round("rate", 3)},
        ["Compare heap after each major collection before enlarging the heap.", "Look for the allocation that fills the old generation."],
    )


def few_majors(t: Tables, c: Thresholds) -> DataFrame:
    counted = t.gc_logs.select(*KEY).join(pressure_majors(t, c).groupBy(*KEY).count(), KEY, "left")
    return counted.where(F.coalesce("count", F.lit(0)) < 2).select("snapshot_id", F.lit("fewer than two major collections").alias("why"))


def _longest(events: DataFrame, note: F.Column, c: Thresholds) -> DataFrame:
    return first_few(events, KEY, [-F.coalesce("pause_ms", F.lit(0.0)), F.col("seq")], span("file", "line_no", note=note), c.max_evidence)


def long_pauses(t: Tables, c: Thresholds) -> DataFrame:
    """Nearest-rank percentiles of stop-the-world pauses; allocation stalls are not pauses."""
    pauses = t.gc_events.where("pause_ms > 0 and kind <> 'ALLOCATION_STALL'")
    over = F.col("pause_ms") > c.sla_ms
    rows = pauses.groupBy(*KEY).agg(
        *percentiles("pause_ms", [50, 95, 99]),
        F.max("pause_ms").alias("worst"), F.count_if(over).alias("n_over"),
    ).where("n_over > 0")
    rows = with_evidence(rows, _longest(pauses.where(over), F.format_string("%.0f ms", "pause_ms"), c), KEY)
    severity = (
        F.when(F.col("n_over") < 3, "MEDIUM").when((F.col("p99") > 5 * c.sla_ms) | (F.col("worst") > 2000), "CRITICAL").when(F.col("p99") > 2 * c.sla_ms, "HIGH").otherwise("MEDIUM")
    )
    return findings(
        rows, "GCA002", "Pauses over the objective", "GC_LOG", severity, F.least(F.lit(0.95), 0.6 + 0.03 * F.col("n_over")),
        F.format_string("%d pauses over %d ms; p50 %.1f, p95 %.1f, p99 %.1f, longest %.1f ms", "n_over", F.lit(c.sla_ms), "p50", "p95", "p99", "worst"), F.col("evidence"),
        {"over": F.col("n_over"), "p50": F.round("p50", 3), "p95": F.round("p95", 3), "p99": F.round("p99", 3), "max": F.round("worst", 3)}, ["Tune the pause goal only after ruling out a leak."],
    )


def live_samples(t: Tables, c: Thresholds) -> DataFrame:
    return (
        events(t)
        .where((F.col("major") | (F.col("kind") == "MIXED")) & ~not_heap_pressure(F.col("cause"), F.col("at_ms"), c.gc_settle_sec))
        .withColumn("live", F.coalesce("old_after", "heap_after"))
        .where("live > 0")
    )


def leak_fingerprint(t: Tables, c: Thresholds) -> DataFrame:
    """The live set after majors climbs, stays pinned near capacity, or collections reclaim nothing."""
    need = max(3, c.heap_leak_min_collections)
    w = Window.partitionBy(*KEY).orderBy("seq")
    s = live_samples(t, c).withColumn("dip", F.coalesce(F.col("live") < F.lag("live").over(w), F.lit(False)))
    stagnant = F.coalesce((F.col("heap_before") - F.col("heap_after")) / F.col("heap_before") < c.leak_stagnant_share, F.lit(False))
    s = s.withColumn("cap", F.last("capacity", True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = s.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("dip").alias("dips"), F.min_by("live", "seq").alias("first"), F.max_by("live", "seq").alias("last"), F.max("live").alias("top"), F.max("cap").alias("cap"),
        F.count_if(F.col("live") >= F.col("cap") * c.leak_pinned_share).alias("pinned"), F.count_if(stagnant).alias("stagnant"),
    ).where(F.col("n") >= need)
    rows = rows.withColumn("rise", F.when(F.col("first") > 0, (F.col("last") - F.col("first")) / F.col("first")).otherwise(0.0)).where(F.col("dips") <= F.greatest(F.lit(1.0), 0.25 * F.col("n")))
    climbing = F.col("rise") >= c.heap_leak_rise
    saturated = F.coalesce(F.col("pinned") >= need, F.lit(False))
    stalled = F.coalesce((F.col("dips") == 0) & F.col("cap").isNotNull() & (F.col("stagnant") >= need) & (F.col("last") >= F.col("cap") * c.leak_stalled_floor), F.lit(False))
    rows = rows.withColumn("shape", F.when(climbing, "climbing").when(saturated, "saturated").when(stalled, "stalled")).where("shape is not null")
    shown = evenly_spaced(s, KEY, "seq", c.max_evidence).groupBy(*KEY).agg(ordered(F.col("seq"), span("file", "line_no", note=F.format_string("%.0fM live", F.col("live") / 1048576.0))).alias("evidence"))
    leader = t.histo_rows.groupBy("snapshot_id").agg(F.max_by("class_name", F.struct("bytes", -F.col("line_no"))).alias("leader"))
    rows = rows.join(shown, KEY).join(leader, "snapshot_id", "left")
    share = F.col("top") / F.col("cap")
    plateau = F.col("shape") != "climbing"
    return findings(
        rows, "GCA003", "Heap leak fingerprint", "GC_LOG", F.when(share > 0.85, "CRITICAL").when(share > 0.6, "HIGH").otherwise("MEDIUM"), F.when(plateau, 0.9).otherwise(F.least(F.lit(0.95), 0.6 + 0.6 * F.col("rise"))),
        F.concat(F.format_string("live set %s over %d major collections, %.0f%% up", "shape", "n", F.col("rise") * 100), F.coalesce(F.concat(F.lit("; largest class "), "leader"), F.lit(""))),
        F.col("evidence"), {"shape": F.col("shape"), "collections": F.col("n"), "dips": F.col("dips"), "rise": F.round("rise", 3)}, ["Take two heap dumps apart and compare what grew.", "Find who keeps the largest class reachable."],
    )


def few_samples(t: Tables, c: Thresholds) -> DataFrame:
    need = max(3, c.heap_leak_min_collections)
    n = t.gc_logs.select(*KEY).join(live_samples(t, c).groupBy(*KEY).count(), KEY, "left")
    why = F.format_string("%d usable major collections, %d needed (--heap-leak-min-collections)", F.coalesce("count", F.lit(0)), F.lit(need))
    return n.where(F.coalesce("count", F.lit(0)) < need).select("snapshot_id", why.alias("why"))


def premature_promotion(t: Tables, c: Thresholds) -> DataFrame:
    low = (F.col("kind") == "YOUNG") & (F.col("heap_before") >= F.col("capacity") / 2) & (F.col("heap_before") - F.col("heap_after") < 0.15 * F.col("heap_before"))
    flagged = F.col("to_space_exhausted") | F.col("humongous") | F.coalesce(low, F.lit(False))
    rows = t.gc_events.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("to_space_exhausted").alias("exhausted"), F.count_if("humongous").alias("humongous"), F.count_if(low).alias("low"),
    ).where("n >= 3 and (exhausted >= 1 or humongous >= 8 or low >= 8)")
    rows = with_evidence(rows, first_few(t.gc_events.where(flagged), KEY, [F.col("seq")], span("file", "line_no", note="cause"), c.max_evidence), KEY)
    confidence = F.when(F.col("exhausted") >= 1, 0.8).when(F.col("humongous") >= 8, 0.7).when(F.col("low") >= 16, 0.6).otherwise(0.55)
    return findings(
        rows, "GCA004", "Premature promotion", "GC_LOG", F.when(F.col("exhausted") >= 1, "HIGH").otherwise("MEDIUM"), confidence,
        F.format_string("%d to-space exhaustions, %d humongous allocations, %d young collections that reclaimed under 15%%", "exhausted", "humongous", "low"), F.col("evidence"),
        {"toSpaceExhausted": F.col("exhausted"), "humongous": F.col("humongous"), "lowYield": F.col("low")}, ["Split large short-lived buffers.", "Give survivors room or start marking earlier."],
    )


def config_smells(t: Tables, c: Thresholds) -> DataFrame:
    """Metaspace-driven and explicit collections, and telling phrases in the raw log."""
    metadata = F.coalesce(F.col("cause").contains(fixed.METADATA_CAUSE), F.lit(False))
    explicit = F.coalesce(F.col("cause").rlike("System\\.gc\\(\\)|Full GC \\(System"), F.lit(False))
    counts = t.gc_events.groupBy(*KEY).agg(
        F.count_if(metadata).alias("metadata"), F.count_if(metadata & (F.col("at_ms") > c.gc_settle_sec * 1000)).alias("late"), F.count_if(explicit).alias("explicit"), F.coalesce(F.max("metaspace_after"), F.lit(0)).alias("metaspace"),
    )
    for which, name in ((metadata, "metadata_at"), (explicit, "explicit_at")):
        counts = with_evidence(counts, first_few(t.gc_events.where(which), KEY, [F.col("seq")], span("file", "line_no", note="cause"), c.max_evidence, name), KEY, name)
    a = findings(
        counts.where("metadata >= 3 and late >= 1"), "GCA005", "JVM configuration smell", "GC_LOG", F.when(F.col("metadata") >= 5, "HIGH").otherwise("MEDIUM"), F.lit(0.8),
        F.format_string("metaspace forced %d collections", "metadata"), F.col("metadata_at"), {"metadataCollections": F.col("metadata"), "maxMetaspace": F.col("metaspace")}, ["Raise -XX:MetaspaceSize or find the class loader that leaks."], "metaspace",
    )
    b = findings(
        counts.where("explicit >= 1"), "GCA005", "JVM configuration smell", "GC_LOG", F.when(F.col("explicit") >= 5, "MEDIUM").otherwise("LOW"), F.lit(0.9),
        F.format_string("System.gc() ran %d times", "explicit"), F.col("explicit_at"), {"explicitCollections": F.col("explicit")}, ["Find the caller, or use -XX:+ExplicitGCInvokesConcurrent."], "explicit",
    )
    # one pass over the lines: a line is searched once for each needle, and each needle's first line is a column of one aggregate
    lower = F.lower("text")
    has = [F.contains(lower, F.lit(needle.lower())) for needle, _, _ in fixed.CONFIG_NEEDLES]
    met = t.lines.join(t.gc_logs.select(*KEY), KEY, "left_semi").where(reduce(or_, has)).groupBy(*KEY).agg(*[F.min(F.when(h, F.col("line_no"))).alias(f"at{k}") for k, h in enumerate(has)])
    told = F.array(*[F.struct(F.col(f"at{k}").alias("line_no"), F.lit(severity).alias("severity"), F.lit(meaning).alias("meaning")) for k, (_, severity, meaning) in enumerate(fixed.CONFIG_NEEDLES)])
    rows = met.select(*KEY, F.inline(told)).where("line_no is not null")
    n = findings(rows, "GCA005", "JVM configuration smell", "GC_LOG", F.col("severity"), F.lit(0.85), F.col("meaning"), F.array(span("file", "line_no", note="meaning")), {"line": F.col("line_no")}, ["Follow the hint in the log line."], "phrase")
    return a.unionByName(b).unionByName(n)


def low_throughput(t: Tables, c: Thresholds) -> DataFrame:
    pause = F.when((F.col("pause_ms") > 0) & (F.col("kind") != "ALLOCATION_STALL"), F.col("pause_ms"))
    rows = t.gc_events.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"), ((F.max("at_ms") - F.min("at_ms")) / 1000.0).alias("seconds"), F.coalesce(F.sum(pause), F.lit(0.0)).alias("stopped")
    )
    rows = rows.where("n >= 10 and seconds >= 10").withColumn("share", F.greatest(F.lit(0.0), 1 - F.col("stopped") / (F.col("seconds") * 1000))).where(F.col("share") < c.throughput)
    rows = with_evidence(rows, _longest(t.gc_events.where(pause.isNotNull()), F.format_string("%.0f ms", "pause_ms"), c), KEY)
    lost = 1 - F.col("share")
    return findings(
        rows, "GCA006", "Low throughput", "GC_LOG", F.when(lost > 0.2, "CRITICAL").when(lost > 0.1, "HIGH").otherwise("MEDIUM"), F.lit(0.8),
        F.format_string("%.1f%% of %.0f s went to pauses", lost * 100, "seconds"), F.col("evidence"), {"throughput": F.round("share", 3), "pauseMs": F.round("stopped", 3)}, ["Lower the allocation rate or give the collector room."],
    )


def allocation_stalls(t: Tables, c: Thresholds) -> DataFrame:
    stalls = t.gc_events.where("kind = 'ALLOCATION_STALL'")
    rows = stalls.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("pause_ms").alias("longest"), F.sum("pause_ms").alias("total"))
    rows = rows.where((F.col("n") >= c.stall_min) | (F.col("longest") >= c.sla_ms))
    first = top_k(stalls.groupBy(*KEY, "cause").agg(F.min("seq").alias("seq")), KEY, [F.col("seq")], 3)
    victims = first.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "cause"))), lambda x: x["cause"]), ", ").alias("victims"))
    rows = with_evidence(rows.join(victims, KEY), _longest(stalls, F.col("cause"), c), KEY)
    return findings(
        rows, "GCA007", "Allocation stalls", "GC_LOG", F.when((F.col("n") >= 20) | (F.col("longest") >= 1000), "CRITICAL").otherwise("HIGH"), F.when(F.col("n") >= 2 * c.stall_min, 0.92).otherwise(0.8),
        F.format_string("%d stalls, longest %.1f ms, first victims %s", "n", "longest", "victims"), F.col("evidence"), {"stalls": F.col("n"), "longestMs": F.round("longest", 3), "totalMs": F.round("total", 3)}, ["Give the concurrent collector headroom or more threads."],
    )


RULES = [
    Rule("GCA001", "Full GC storm", "GC_LOG", "Needs two major collections that heap pressure caused.", full_gc_rate, few_majors),
    Rule("GCA002", "Pauses over the objective", "GC_LOG", "Stalls are not pauses.", long_pauses),
    Rule("GCA003", "Heap leak fingerprint", "GC_LOG", "Needs three major collections with a size after.", leak_fingerprint, few_samples),
    Rule("GCA004", "Premature promotion", "GC_LOG", "Under 8 humongous or low-yield events are noise.", premature_promotion),
    Rule("GCA005", "JVM configuration smell", "GC_LOG", "Start-up metaspace collections alone don't count.", config_smells),
    Rule("GCA006", "Low throughput", "GC_LOG", "Needs ten events over ten seconds.", low_throughput),
    Rule("GCA007", "Allocation stalls", "GC_LOG", "Only collectors that log stalls.", allocation_stalls),
]
