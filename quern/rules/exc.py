"""Rules over exceptions in application logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions import exprs as X
from ..operators.series import densest_bucket, top_k
from .base import Rule, Tables, findings, first_few, span, with_evidence


def printed(t: Tables) -> DataFrame:
    return t.exceptions.withColumn("print", X.exception_fingerprint(F.col("chain"), 5)).withColumn("root", X.root_cause(F.col("chain")))


def _places(stacks: DataFrame, keys: list[str], c: Thresholds) -> DataFrame:
    return first_few(stacks, keys, [F.col("file"), F.col("start_line")], span("file", "start_line", "end_line", F.col("root.cls")), c.max_evidence)


def clusters(t: Tables, c: Thresholds) -> DataFrame:
    """Stacks that repeat; the fullest of them represents the others."""
    fullness = F.size("chain") + F.size("root.frames")
    rows = printed(t).groupBy("snapshot_id", "print").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("file", "start_line")).alias("first"), F.max_by(F.col("root.cls"), F.struct(fullness, -F.col("start_line"))).alias("cls"),
        ((F.max("epoch_ms") - F.min("epoch_ms")) / 1000.0).alias("seconds"), F.count("epoch_ms").alias("timed"),
    ).where(F.col("n") >= c.exception_threshold)
    rows = top_k(rows, ["snapshot_id"], [F.desc("n"), F.col("first")], 3)
    rows = with_evidence(rows, _places(printed(t), ["snapshot_id", "print"], c), ["snapshot_id", "print"])
    return findings(
        rows, "EXC001", "Repeated exception", "APP_LOG", F.when(X.fatal_error(F.col("cls")), "HIGH").otherwise("MEDIUM"), F.least(F.lit(0.9), 0.55 + 0.02 * F.col("n")), F.format_string("%s %d times from one place", "cls", "n"), F.col("evidence"),
        {"class": F.col("cls"), "count": F.col("n"), "spanSec": F.coalesce(F.when(F.col("timed") >= 2, F.round("seconds", 3)).cast("string"), F.lit("unknown"))}, ["Fix or handle this failure first."],
    )


def causal_sites(t: Tables, c: Thresholds) -> DataFrame:
    """Chained exceptions by root class and the first own frame of the root; three sites, later ones first among equals."""
    own = X.first_business_frame(F.col("root.frames"))
    chained = printed(t).where(F.size("chain") > 1).withColumn("site", X.frame_id(own["cls"], own["method"])).where("site is not null")
    rows = chained.groupBy("snapshot_id", F.col("root.cls").alias("cls"), "site").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("file", "start_line")).alias("first"), F.max_by(X.outermost(F.col("chain"))["cls"], -F.col("start_line")).alias("outer"),
    )
    rows = top_k(rows, ["snapshot_id"], [F.desc("n"), F.desc("first")], 3).where(F.col("n") >= max(2, c.exception_threshold // 2))
    of = ["snapshot_id", "cls", "site"]
    rows = with_evidence(rows, _places(chained.withColumn("cls", F.col("root.cls")), of, c), of)
    return findings(
        rows, "EXC002", "Causal chain", "APP_LOG", F.when(F.col("n") >= c.exception_threshold, "HIGH").otherwise("MEDIUM"), F.lit(0.82), F.format_string("%s hides %s thrown at %s, %d times", "outer", "cls", "site", "n"), F.col("evidence"),
        {"class": F.col("cls"), "site": F.col("site"), "count": F.col("n")}, ["Start at the root cause's own frame."],
    )


def bursts(t: Tables, c: Thresholds) -> DataFrame:
    """Stacks with many occurrences in one epoch-aligned bucket; two of a snapshot, in order of appearance."""
    timed = printed(t).where("epoch_ms is not null")
    enough = timed.groupBy("snapshot_id").count().where(F.col("count") >= c.burst_min).select("snapshot_id")
    dense = densest_bucket(timed.join(enough, "snapshot_id", "left_semi"), ["snapshot_id", "print"], "epoch_ms", c.burst_bucket_sec * 1000, c.burst_min)
    first = printed(t).groupBy("snapshot_id", "print").agg(
        F.min(F.struct("file", "start_line")).alias("first"), F.min_by(F.col("root.cls"), F.struct("file", "start_line")).alias("cls"), F.min_by(span("file", "start_line", "end_line"), F.struct("file", "start_line")).alias("e")
    )
    rows = top_k(dense.join(first, ["snapshot_id", "print"]), ["snapshot_id"], [F.col("first")], 2)
    return findings(
        rows, "EXC003", "Exception burst", "APP_LOG", F.when(F.col("n") >= 100, "HIGH").otherwise("MEDIUM"), F.lit(0.75), F.format_string("%s %d times within %d s", "cls", "n", F.lit(c.burst_bucket_sec)), F.array("e"),
        {"class": F.col("cls"), "count": F.col("n"), "bucketStartMs": F.col("bucket") * c.burst_bucket_sec * 1000}, ["Look at what changed when the burst began."],
    )


def few_stamps(t: Tables, c: Thresholds) -> DataFrame:
    counted = t.exceptions.groupBy("snapshot_id").agg(F.count("epoch_ms").alias("timed"), F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("timed") < c.burst_min).select("snapshot_id", F.format_string("%d of %d exceptions have a time stamp", "timed", "n").alias("why"))


RULES = [
    Rule("EXC001", "Repeated exception", "APP_LOG", "Counts what the log holds.", clusters),
    Rule("EXC002", "Causal chain", "APP_LOG", "Needs a chain and an own frame.", causal_sites),
    Rule("EXC003", "Exception burst", "APP_LOG", "Needs dated time stamps.", bursts, few_stamps),
]
