"""Rules over heap histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import MIB, Thresholds
from ..functions import fixed
from ..functions.exprs import base_class, human_bytes, is_jdk
from .base import Rule, Tables, findings, ordered, span

KEY = ["snapshot_id", "file"]


def classes(t: Tables) -> DataFrame:
    return t.histo_rows.join(t.histos.select(*KEY, "total_bytes", "total_instances"), KEY)


def dominance(t: Tables, c: Thresholds) -> DataFrame:
    """One class holds much of the heap, or bytes, chars and strings do together."""
    by_size = Window.partitionBy(*KEY).orderBy(F.desc("bytes"), "line_no")
    bag_names = ["String"] if c.compat_bag else ["java.lang.String", "[B", "[C"]
    in_bag = base_class(F.col("class_name")).isin("java.lang.String") if c.compat_bag else F.col("class_name").isin(bag_names)
    rows = classes(t).withColumn("nth", F.row_number().over(by_size))
    shown = F.slice(ordered(F.col("nth"), span("file", "line_no", note=human_bytes(F.col("bytes")))), 1, c.max_evidence)
    heads = rows.groupBy(*KEY).agg(
        F.max_by("class_name", F.when(F.col("nth") == 1, 1)).alias("leader"), F.max(F.when(F.col("nth") == 1, F.col("bytes"))).alias("bytes"), F.max("total_bytes").alias("total"),
        F.coalesce(F.sum(F.when(in_bag, F.col("bytes"))), F.lit(0)).alias("bag"), shown.alias("evidence"),
    ).where("total > 0")
    heads = heads.withColumn("share", F.col("bytes") / F.col("total")).withColumn("bag_share", F.col("bag") / F.col("total"))
    one = findings(
        heads.where((F.col("share") >= c.histo_share) & (F.col("bytes") >= c.histo_top_min_leader_mb * MIB)), "HIS001", "A class dominates the heap", "HEAP_HISTO",
        F.when(F.col("share") >= 0.6, "HIGH").otherwise("MEDIUM"), F.least(F.lit(0.9), 0.5 + F.col("share")), F.format_string("%s holds %.1f%% of the heap", "leader", F.col("share") * 100), F.col("evidence"),
        {"class": F.col("leader"), "share": F.round("share", 3), "bytes": F.col("bytes")}, ["Ask a heap dump who refers to these objects."], "leader",
    )
    bag = findings(
        heads.where((F.col("share") < c.histo_share) & (F.col("bag_share") >= 0.6) & (F.col("bag") >= c.histo_top_min_bag_mb * MIB)), "HIS001", "A class dominates the heap", "HEAP_HISTO",
        F.lit("MEDIUM"), F.lit(0.6), F.format_string("text and byte arrays hold %.1f%% of the heap", F.col("bag_share") * 100), F.col("evidence"), {"share": F.round("bag_share", 3), "bytes": F.col("bag")}, ["Look for caches of text or bytes."], "bag",
    )
    return one.unionByName(bag)


def app_class(t: Tables, c: Thresholds) -> DataFrame:
    own = classes(t).where(~is_jdk(base_class(F.col("class_name"))) & ~F.col("class_name").rlike("^\\[+[BCDFIJSZ]$|^<"))
    by_size = Window.partitionBy(*KEY).orderBy(F.desc("bytes"), "line_no")
    ranked = own.withColumn("nth", F.row_number().over(by_size))
    shown = F.filter(ordered(F.col("nth"), F.when(F.col("bytes") >= c.mat_min_mb * MIB / 4, span("file", "line_no", note=human_bytes(F.col("bytes"))))), lambda e: e.isNotNull())
    rows = ranked.groupBy(*KEY).agg(F.max_by("class_name", -F.col("nth")).alias("leader"), F.max("bytes").alias("bytes"), F.max("total_bytes").alias("total"), F.slice(shown, 1, c.max_evidence).alias("evidence"))
    rows = rows.withColumn("share", F.col("bytes") / F.col("total")).where((F.col("total") > 0) & (F.col("bytes") >= c.mat_min_mb * MIB) & (F.col("share") >= c.mat_share))
    return findings(
        rows, "HIS002", "An application class is large", "HEAP_HISTO", F.when(F.col("share") >= 0.3, "HIGH").otherwise("MEDIUM"), F.least(F.lit(0.88), 0.55 + F.col("share")),
        F.format_string("%s holds %.1f%% of the heap", "leader", F.col("share") * 100), F.col("evidence"), {"class": F.col("leader"), "share": F.round("share", 3), "bytes": F.col("bytes")}, ["Take a heap dump and open this class's retained set."],
    )


def containers(t: Tables, c: Thresholds) -> DataFrame:
    name = F.col("class_name")
    held = classes(t).where(name.isin(fixed.CONTAINERS) | name.endswith("$Node") | name.endswith("$Entry"))
    many = Window.partitionBy(*KEY).orderBy(F.desc("instances"), "line_no")
    ranked = held.withColumn("nth", F.row_number().over(many))
    shown = F.slice(ordered(F.col("nth"), span("file", "line_no", note=F.format_string("%d instances", "instances"))), 1, c.max_evidence)
    rows = ranked.groupBy(*KEY).agg(
        F.max_by("class_name", -F.col("nth")).alias("worst"), F.max("instances").alias("instances"), F.max_by("bytes", -F.col("nth")).alias("bytes"), F.max("total_instances").alias("total"), shown.alias("evidence")
    )
    rows = rows.where((F.col("total") > 0) & (F.col("instances") >= F.greatest(F.lit(c.container_min_instances), F.floor(F.col("total") / 20))))
    return findings(
        rows, "HIS003", "Very many collection objects", "HEAP_HISTO", F.when(F.col("bytes") > 64 * MIB, "HIGH").otherwise("MEDIUM"), F.lit(0.7),
        F.format_string("%d instances of %s", "instances", "worst"), F.col("evidence"), {"class": F.col("worst"), "instances": F.col("instances")}, ["Look for maps or lists made per request and kept."],
    )


RULES = [
    Rule("HIS001", "A class dominates the heap", "HEAP_HISTO", "One histogram shows size, not growth.", dominance),
    Rule("HIS002", "An application class is large", "HEAP_HISTO", "Shallow sizes only.", app_class),
    Rule("HIS003", "Very many collection objects", "HEAP_HISTO", "Both 50,000 and a twentieth of all objects are needed.", containers),
]
