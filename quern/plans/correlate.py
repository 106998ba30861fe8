"""From findings to root causes: merge, rank, hypotheses, rule status, timeline. All joins are with small fixed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Thresholds
from ..functions import exprs as X
from ..functions import fixed
from ..rules.base import EVIDENCE, Tables

MERGED_EVIDENCE, HYPOTHESIS_EVIDENCE, HYPOTHESIS_ACTIONS = 8, 12, 4


def rank_of(severity) -> F.Column:
    return X.severity_rank(F.col(severity) if isinstance(severity, str) else severity)


def dedupe(findings: DataFrame) -> DataFrame:
    """Findings that differ in the file alone become one: worst severity, best confidence, all evidence (the first 8), files seen."""
    masked = findings.withColumn("masked", X.mask_files(F.col("summary"))).withColumn("rank", rank_of("severity"))
    order = F.struct("first_line", F.coalesce(F.get("evidence", 0)["file"], F.lit("")), "summary")
    first = lambda c: F.min_by(c, order)
    grouped = masked.groupBy("snapshot_id", "rule_id", "title", "masked", F.coalesce("variant", F.lit("")).alias("v")).agg(
        F.min("rank").alias("rank"), F.max("confidence").alias("confidence"), first("artifact").alias("artifact"), first("variant").alias("variant"), first("summary").alias("summary"), first("recommendations").alias("recommendations"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first_line", "evidence"))), lambda x: x["evidence"]))).alias("all_evidence"), first("metrics").alias("metrics"), F.count(F.lit(1)).alias("merged"), F.min("first_line").alias("first_line"),
    )
    files = F.array_sort(F.array_distinct(F.transform("all_evidence", lambda e: e["file"])))
    extra = F.when(F.col("merged") > 1, F.create_map(F.lit("seenIn"), F.array_join(files, ", "))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    cut = F.when(F.size("all_evidence") > MERGED_EVIDENCE, F.create_map(F.lit("evidenceTruncated"), F.lit("true"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    severity = F.element_at(F.array(*map(F.lit, fixed.SEVERITIES)), F.col("rank") + 1)
    return grouped.select(
        "snapshot_id", "rule_id", "title", severity.alias("severity"), "confidence", "artifact", "variant", "summary", "recommendations", F.slice("all_evidence", 1, MERGED_EVIDENCE).alias("evidence"),
        F.map_concat("metrics", extra, cut).alias("metrics"), "first_line",
    )


#: Places that are few enough to be sent to every task that reads lines.
FEW_PLACES = 100_000


def quoted(findings: DataFrame, lines: DataFrame, few: int = FEW_PLACES) -> DataFrame:
    """Evidence with the text of its first line.

    Where the named places are few (they are counted), each task that reads lines keeps these alone before anything is
    shuffled; else lines are joined by place. findings are read more than once: give a written table.
    """
    each = findings.withColumn("of", F.struct("snapshot_id", "rule_id", F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("variant", F.lit("")).alias("variant")))
    spread = each.select("of", "snapshot_id", F.posexplode("evidence").alias("nth", "e")).withColumns({"e_file": F.col("e.file"), "e_line": F.col("e.start_line")})
    place = ["snapshot_id", "e_file", "e_line"]
    text = lines.select("snapshot_id", F.col("file").alias("e_file"), F.col("line_no").alias("e_line"), "text")
    wanted = spread.select(*place).distinct()
    if wanted.limit(few + 1).count() <= few:
        text = text.join(F.broadcast(wanted), place, "left_semi")
    met = spread.join(text.select(*place, X.quote(F.col("text")).alias("q")), place, "left")
    back = met.groupBy("of").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.struct("e.file", "e.start_line", "e.end_line", F.col("q").alias("quote"), "e.note").alias("e")))), lambda x: x["e"]).cast(f"array<{EVIDENCE}>").alias("quoted"))
    return each.join(back, "of", "left").withColumn("evidence", F.coalesce("quoted", "evidence")).drop("of", "quoted")


def ordered(findings: DataFrame) -> DataFrame:
    """Within a snapshot: severity, confidence (high first), rule, first line."""
    return findings.orderBy("snapshot_id", rank_of("severity"), F.desc("confidence"), "rule_id", "first_line")


def hypotheses(findings: DataFrame) -> DataFrame:
    """Fixed claims whose rules fired, scored and ranked; a leak weighs down what follows from it."""
    spark = findings.sparkSession
    table = [(h, k, w, r, v, claim) for k, (h, w, rules, v, claim) in enumerate(fixed.HYPOTHESES) for r in rules]
    known = F.broadcast(spark.createDataFrame(table, "hypothesis string, decl int, weight double, rule_id string, wants string, claim string"))
    met = findings.join(known, "rule_id").where("wants is null or wants = variant").withColumn("rank", rank_of("severity"))
    place = F.struct("rank", -F.col("confidence"), "rule_id", "first_line", "summary")
    listed = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), F.col(c).alias("x")))), lambda y: y["x"]))
    grouped = met.groupBy("snapshot_id", "hypothesis", "decl", "weight", "claim").agg(
        F.min("rank").alias("rank"), F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("rule_id")).alias("rules"),
        F.slice(F.array_distinct(listed("recommendations")), 1, HYPOTHESIS_ACTIONS).alias("actions"), F.slice(F.array_distinct(listed("evidence")), 1, HYPOTHESIS_EVIDENCE).alias("evidence"),
    )
    leaking = findings.groupBy("snapshot_id").agg(F.bool_or(F.col("rule_id") == "GCA003").alias("leak"))
    # the worst severity and best confidence are those of all findings of the hypothesis's rules
    anchors = findings.join(F.broadcast(known.select("hypothesis", "rule_id").distinct()), "rule_id").groupBy("snapshot_id", "hypothesis").agg(F.min(rank_of("severity")).alias("a_rank"), F.max("confidence").alias("a_confidence"))
    rows = grouped.join(anchors, ["snapshot_id", "hypothesis"]).join(leaking, "snapshot_id")
    score_of = F.element_at(F.array(*[F.lit(fixed.SEVERITY_SCORE[s]) for s in fixed.SEVERITIES]), F.col("a_rank") + 1)
    more = F.least(F.lit(3.0), F.size("rules") - 1.0) * 0.05
    penalty = F.when(F.col("leak") & F.col("hypothesis").isin(fixed.PENALISED_BY_LEAK), fixed.LEAK_PENALTY).otherwise(1.0)
    score = (score_of * 0.40 + F.col("weight") * 0.40 + more + F.col("a_confidence") * 0.12 + F.col("confidence") * 0.08) * penalty
    severity = F.element_at(F.array(*map(F.lit, fixed.SEVERITIES)), F.col("rank") + 1)
    claim = F.concat("claim", F.lit(" Corroborated by "), F.array_join("rules", ", "), F.lit("."))
    by = Window.partitionBy("snapshot_id").orderBy(F.desc(F.round("score", 9)), "decl")  # scores that differ by rounding alone tie
    scored = rows.withColumn("score", score).withColumn("place", F.row_number().over(by))
    return scored.select("snapshot_id", "place", "hypothesis", claim.alias("claim"), severity.alias("severity"), "confidence", F.round("score", 6).alias("score"), penalty.alias("penalty"), "rules", "actions", "evidence")


def severity_census(findings: DataFrame) -> DataFrame:
    """snapshot_id, severity, n with zeros for levels that don't occur."""
    spark = findings.sparkSession
    levels = F.broadcast(spark.createDataFrame([(s, k) for k, s in enumerate(fixed.SEVERITIES)], "severity string, rank int"))
    counted = findings.groupBy("snapshot_id", "severity").agg(F.count(F.lit(1)).alias("n"))
    return findings.select("snapshot_id").distinct().join(levels).join(counted, ["snapshot_id", "severity"], "left").select("snapshot_id", "severity", "rank", F.coalesce("n", F.lit(0)).alias("n"))


def rule_status(snapshots: DataFrame, artifacts: DataFrame, findings: DataFrame, declined: DataFrame, rules: list, failed: list[str] = ()) -> DataFrame:
    """snapshot_id, rule_id, status: not-applicable, error (the rule failed), N finding(s), declined: why, or clean."""
    spark = snapshots.sparkSession
    known = F.broadcast(spark.createDataFrame([(r.id, r.artifact) for r in rules], "rule_id string, artifact string"))
    every = snapshots.join(known)
    present = artifacts.select("snapshot_id", F.col("kind").alias("artifact")).distinct().withColumn("here", F.lit(True))
    fired = findings.groupBy("snapshot_id", "rule_id").agg(F.count(F.lit(1)).alias("n"))
    why = declined.groupBy("snapshot_id", "rule_id").agg(F.min("why").alias("why"))
    rows = every.join(present, ["snapshot_id", "artifact"], "left").join(fired, ["snapshot_id", "rule_id"], "left").join(why, ["snapshot_id", "rule_id"], "left")
    status = (
        F.when(F.col("here").isNotNull() & F.col("rule_id").isin(list(failed)) if failed else F.lit(False), "error").when(F.col("n") == 1, "1 finding").when(F.col("n") > 1, F.format_string("%d findings", "n")).when(F.col("here").isNull(), "not-applicable").when(F.col("why").isNotNull(), F.concat(F.lit("declined: "), "why")).otherwise("clean")
    )
    return rows.select("snapshot_id", "rule_id", status.alias("status"))


def timeline(t: Tables, c: Thresholds) -> DataFrame:
    """Full collections and long pauses, captures, the first exception and repeated ones on one axis of seconds."""
    boot = t.gc_logs.groupBy("snapshot_id").agg(F.min("boot_epoch_ms").alias("boot"))
    p99 = t.gc_events.where("pause_ms > 0 and kind <> 'ALLOCATION_STALL'").groupBy("snapshot_id").agg(F.expr("percentile_disc(0.99) within group (order by pause_ms)").alias("p99"))
    full = F.col("kind") == "FULL"
    label = F.concat(
        F.when(full, "Full GC").otherwise(F.concat("kind", F.lit(" pause"))), F.coalesce(F.format_string(" %.0f ms", F.when(F.col("pause_ms").isNotNull(), F.col("pause_ms"))), F.lit("")),
        F.when(F.col("heap_after").isNotNull(), F.format_string(", heap after %.0fM", F.col("heap_after") / 1048576.0)).otherwise(""),
    )
    gc = t.gc_events.where(full | (F.col("pause_ms") > c.sla_ms)).join(boot, "snapshot_id", "left").join(p99, "snapshot_id", "left").select(
        "snapshot_id", (F.col("boot") + F.col("at_ms")).alias("epoch_ms"), (F.col("at_ms") / 1000.0).alias("uptime_sec"), label.alias("label"), F.coalesce(F.concat(F.lit("cause: "), "cause"), F.lit("")).alias("detail"),
        F.lit("GC_LOG").alias("source"), "file", "line_no", (full | F.coalesce(F.col("pause_ms") >= F.col("p99"), F.lit(False))).alias("major"),
    )
    none = F.lit(None).cast("double")
    dumps = t.dumps.select(
        "snapshot_id", F.col("captured_at_ms").alias("epoch_ms"), none.alias("uptime_sec"), F.format_string("Thread dump %s (%d threads)", "file", "n_threads").alias("label"),
        F.when(F.col("vm_reported_deadlock"), "the capture reports a deadlock").otherwise("").alias("detail"), F.lit("THREAD_DUMP").alias("source"), "file", F.lit(1).alias("line_no"), F.col("vm_reported_deadlock").alias("major"),
    )
    x = t.exceptions.withColumn("root", X.root_cause(F.col("chain"))).withColumn("outer", X.outermost(F.col("chain")))
    entry = F.struct("epoch_ms", "file", "start_line", F.col("outer.cls").alias("outer_cls"), F.col("root.cls").alias("root_cls"))
    first = x.groupBy("snapshot_id").agg(F.min_by(entry, F.struct(F.col("epoch_ms").isNull(), "epoch_ms", "file", "start_line")).alias("e")).select(
        "snapshot_id", "e.epoch_ms", none.alias("uptime_sec"), F.concat(F.lit("First exception: "), "e.outer_cls").alias("label"), F.format_string("%s at line %d", "e.root_cls", "e.start_line").alias("detail"),
        F.lit("APP_LOG").alias("source"), "e.file", F.col("e.start_line").alias("line_no"), F.lit(True).alias("major"),
    )
    many = x.groupBy("snapshot_id", X.exception_fingerprint(F.col("chain"), 5).alias("print")).agg(F.count(F.lit(1)).alias("n"), F.min_by(entry, F.struct("file", "start_line")).alias("e"))
    many = many.where(F.col("n") >= max(5, c.exception_threshold)).select(
        "snapshot_id", "e.epoch_ms", none.alias("uptime_sec"), F.format_string("%d × %s", "n", "e.root_cls").alias("label"), F.lit("first occurrence of this stack").alias("detail"),
        F.lit("APP_LOG").alias("source"), "e.file", F.col("e.start_line").alias("line_no"), (F.col("n") >= 20).alias("major"),
    )
    rows = gc.unionByName(dumps).unionByName(first).unionByName(many).join(boot, "snapshot_id", "left")
    key = F.coalesce("uptime_sec", F.when(F.col("epoch_ms").isNotNull(), F.when(F.col("boot").isNull(), 1e300).otherwise((F.col("epoch_ms") - F.col("boot")) / 1000.0)), F.lit(0.0))
    return rows.withColumn("sort_key", key).drop("boot")


def single_axis(entries: DataFrame, gc_logs: DataFrame) -> DataFrame:
    """Per snapshot whether all entries lie on one axis: some uptime and some wall-clock entries without a boot time don't."""
    boot = gc_logs.groupBy("snapshot_id").agg(F.min("boot_epoch_ms").alias("boot"))
    seen = entries.join(boot, "snapshot_id", "left").groupBy("snapshot_id").agg(
        F.bool_or(F.col("uptime_sec").isNotNull()).alias("up"), F.bool_or(F.col("epoch_ms").isNotNull() & F.col("uptime_sec").isNull() & F.col("boot").isNull()).alias("wall")
    )
    return seen.select("snapshot_id", (~F.col("up") | ~F.col("wall")).alias("single_axis"))
