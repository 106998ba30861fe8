"""Shards by a k-d tree over metadata, in DataFrame functions alone.

A node of the tree is split along the dimension in which its documents spread widest, at the weighted
median of their bytes, until each leaf has its share. All nodes of a level are split together. The
median is found by refinement: quantiles of the candidates cut them into intervals, whose bytes tell
the one that holds the median; each pass leaves a small part of the candidates and moves only sums.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._rank import rank_within
from ._scratch import Scratch

#: The driver holds a few rows a leaf.
MOST_SHARDS = 1 << 16
#: Candidates of a node that are few enough to be sorted by one task, and the quantiles that narrow down more.
FEW, QUANTILES = 4096, 40
_KEY = ["v", "h", "i", "row"]  # place in the dimension, hash of the text, hash of the id, number of the row
_KINDS = "v: double, h: long, i: long, row: long"
_LOW, _HIGH = (float("-inf"), *[-(1 << 63)] * 3), (float("inf"), *[(1 << 63) - 1] * 3)


def _axis(docs: DataFrame, name: str) -> F.Column:
    """A dimension as a double: numbers and times as they are, anything else by its first six bytes; null and NaN are null."""
    column, kind = F.col(f"`{name}`"), docs.schema[name].dataType.typeName()
    if kind == "date":
        return F.unix_date(column).cast("double")
    if kind in ("byte", "short", "integer", "long", "float", "double", "decimal", "timestamp", "boolean"):
        return F.nanvl(column.cast("double"), F.lit(None).cast("double"))
    return F.conv(F.rpad(F.hex(F.substring(F.encode(column.cast("string"), "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")


def _hash(column: F.Column) -> F.Column:
    """52 bits, as quantiles are exact for numbers below 2**53 alone; what they don't tell apart the next key does."""
    return F.shiftrightunsigned(F.xxhash64(column), 12)


def _told(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A few rows of the driver as a table, without a Python worker."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _spread(name: str, low: float | None, high: float | None) -> F.Column:
    """A dimension as a part of its whole range, null a quarter below it; infinite values at its ends."""
    if low is None:
        return F.lit(0.0)
    place = (F.greatest(F.lit(low), F.least(F.lit(high), F.col(name))) - F.lit(low)) / F.lit(high - low if high > low else 1.0)
    return F.coalesce(place, F.lit(-0.25))


def _key() -> F.Column:
    return F.struct(*_KEY)


def _weighted_cuts(rows: DataFrame, wanted: dict[int, tuple[int, int, float]]) -> dict[int, tuple]:
    """For each node the key up to which its rows hold as near as can be the wanted bytes.

    rows: node, v, h, i, row, size. wanted: rows, bytes wanted, and the bytes up to which a group of equal
    texts in one place isn't cut but left to the nearer side.
    """
    spark = rows.sparkSession
    states = {k: {"of": k, "n": n, "want": want, "slack": slack, "before": 0, "part": 0, "lo": _LOW, "hi": _HIGH} for k, (n, want, slack) in wanted.items()}
    schema = f"of int, part int, want long, before long, slack double, lo struct<{_KINDS}>, hi struct<{_KINDS}>"

    def candidates(some: list[dict], *more: str) -> DataFrame:
        named = [s | {end: dict(zip(_KEY, s[end], strict=True)) for end in ("lo", "hi")} for s in some]
        met = rows.join(F.broadcast(_told(spark, named, schema)), F.col("node") == F.col("of"))
        return met.where((_key() > F.col("lo")) & (_key() <= F.col("hi"))).drop("of")

    while many := [s for s in states.values() if s["n"] > FEW]:
        found = candidates(many).withColumn("whole", F.when(F.col("part") == 1, F.col("h")).when(F.col("part") == 2, F.col("i")).when(F.col("part") == 3, F.col("row")))
        shares = [k / (QUANTILES + 1) for k in range(1, QUANTILES + 1)]
        sketch = found.groupBy("node").agg(
            F.array_distinct(F.percentile_approx(F.when(F.col("part") == 0, F.col("v")), shares, 1000)).alias("of_v"), F.array_distinct(F.percentile_approx("whole", shares, 1000)).alias("of_whole")
        )
        # a row for each node goes to the driver and comes back as a table of proven size
        sketched = {r["node"]: (r["of_v"], r["of_whole"]) for r in sketch.collect()}
        bounds = _told(spark, [{"of": k, "of_v": v, "of_whole": whole} for k, (v, whole) in sketched.items()], "of int, of_v array<double>, of_whole array<long>")
        met = found.join(F.broadcast(bounds), F.col("node") == F.col("of"))
        # an interval between two bounds has an even number, a bound itself an odd one
        place = lambda b, x: 2 * F.size(F.filter(b, lambda y: y < F.col(x))) + F.array_contains(b, F.col(x)).cast("int")
        bucket = F.when(F.col("part") == 0, place("of_v", "v")).otherwise(place("of_whole", "whole"))
        ends = [f(c).alias(f"{n}_{c}") for c in _KEY for n, f in (("min", F.min), ("max", F.max))]
        sums = met.groupBy("node", bucket.alias("bucket")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min(F.col("want") - F.col("before")).alias("need"), *ends)
        upto = F.sum("bytes").over(Window.partitionBy("node").orderBy("bucket"))
        holding = sums.withColumn("upto", upto).where("upto >= need and upto - bytes < need").collect()  # one row a node
        for r in holding:
            s, (of_v, of_whole) = states[r["node"]], sketched[r["node"]]
            part, values = s["part"], of_whole if s["part"] else of_v
            fixed, at, odd = s["hi"][:part], r["bucket"] // 2, r["bucket"] % 2
            if odd:
                s["lo"], s["hi"] = (*fixed, values[at], *_LOW[part + 1 :]), (*fixed, values[at], *_HIGH[part + 1 :])
            else:
                s["lo"] = s["lo"] if at == 0 else (*fixed, values[at - 1], *_HIGH[part + 1 :])
                s["hi"] = s["hi"] if at == len(values) else (*fixed, values[at], *_LOW[part + 1 :])
            s["before"] += r["upto"] - r["bytes"]
            s["n"] = r["n"]
            while s["part"] < 3 and r[f"min_{_KEY[s['part']]}"] == r[f"max_{_KEY[s['part']]}"]:  # what all candidates share is fixed
                k, value = s["part"], r[f"min_{_KEY[s['part']]}"]
                s["lo"] = s["lo"] if s["lo"][k] == value and s["lo"][:k] == s["hi"][:k] else (*s["hi"][:k], value, *_LOW[k + 1 :])
                s["hi"] = s["hi"] if s["hi"][k] == value else (*s["hi"][:k], value, *_HIGH[k + 1 :])
                s["part"] += 1
    down = Window.partitionBy("node").orderBy(*_KEY)
    own = Window.partitionBy("node", "v", "h")
    found = candidates(list(states.values())).withColumn("upto", F.sum("size").over(down) + F.col("before"))
    last = ~F.coalesce(F.lead(F.struct("v", "h")).over(down) == F.struct("v", "h"), F.lit(False))
    found = found.withColumn("last", last).withColumn("group", F.sum("size").over(own)).where("last or part >= 2 or group > slack")
    off = F.abs(F.col("upto") - F.col("want"))
    best = found.groupBy("node").agg(F.min(off).alias("off"), F.min_by(_key(), F.struct(off, _key())).alias("key")).collect()  # one row a node
    cuts = {k: s["lo"] for k, s in states.items()}
    for r in best:
        s = states[r["node"]]
        if r["off"] < abs(s["before"] - s["want"]):
            cuts[r["node"]] = tuple(r["key"])
    return cuts


def kd_shards(docs: DataFrame, shards: int | None = 16, target_bytes: int | None = None, id_col="doc_id", text_col="text", dimensions=("source", "lang", "doc_id"), slack: float = 0.002) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs.

    size is the UTF-8 bytes of the text (null: none) plus one. Leaves have nearly equal sizes (the law
    `bytes`): give their number, or target_bytes and shards None for the fewest leaves within that mean. A node of an
    odd number of leaves is cut at the quantile of its smaller half. Dimensions are columns of
    docs; a value's place is its part of the column's whole range, so that they compare. Text columns
    count by their first six bytes, null comes before all values.

    Rows in one place are ordered by hash of the text, then of the id, then as they were read: any hot value, group of copies or
    run of equal rows can be cut. A group of equal texts of at most `slack` of a leaf goes to one side whole. slot
    numbers the rows of a shard without gaps in the order of ids. grown_shard is null, as it is for this law.

    Texts are read once for their size and hashes. Each pass over a level reads that slim table and shuffles a few
    sums a node; the last step sorts it. The driver holds a few rows a leaf (at most MOST_SHARDS).
    """
    scratch = Scratch(docs.sparkSession, "kd")
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    doc_id = F.col(f"`{id_col}`")
    axes = [f"axis{k}" for k in range(len(dimensions))]
    slim = docs.select(
        doc_id.alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), _hash(text).alias("h"), _hash(doc_id).alias("i"),
        F.monotonically_increasing_id().alias("row"), F.lit(0).alias("node"), *[_axis(docs, d).alias(a) for d, a in zip(dimensions, axes, strict=True)],
    )
    slim = scratch.save(slim, "slim")
    finite = lambda a: F.when(F.abs(a) < float("inf"), F.col(a))
    whole = slim.agg(F.sum("size").alias("bytes"), *[f(finite(a)).alias(f"{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max))]).first()
    total = whole["bytes"] or 0
    leaves = shards if shards is not None else max(1, math.ceil(total / target_bytes))
    if leaves > MOST_SHARDS:
        raise ValueError(f"{leaves} shards; at most {MOST_SHARDS} can be made")
    spread = [_spread(a, whole[f"min_{a}"], whole[f"max_{a}"]).alias(a) for a in axes]
    # a node's number is that of its first leaf
    placed = slim.select("doc_id", "size", "text_crc32", "h", "i", "row", "node", *spread)
    open_nodes, level = {0: leaves} if total else {}, 0
    while open_nodes := {k: n for k, n in open_nodes.items() if n > 1}:
        ends = [f(a).alias(f"{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max))]
        seen = placed.where(F.col("node").isin(*open_nodes)) if len(open_nodes) <= 64 else placed
        found = {r["node"]: r for r in seen.groupBy("node").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), *ends).collect() if r["node"] in open_nodes}
        widest = {k: max(range(len(axes)), key=lambda j, r=r: r[f"max_{axes[j]}"] - r[f"min_{axes[j]}"]) if axes else 0 for k, r in found.items()}
        turned = _told(spark, [{"of": k, "axis": j} for k, j in widest.items()], "of int, axis int")
        value = F.get(F.array(*axes), F.col("axis")) if axes else F.lit(0.0)
        aimed = placed.join(F.broadcast(turned), F.col("node") == F.col("of"), "left").withColumn("v", value).drop("of", "axis")
        left = {k: open_nodes[k] // 2 for k in found}
        share = {k: r["bytes"] * left[k] // open_nodes[k] for k, r in found.items()}
        cuts = _weighted_cuts(aimed.where("v is not null"), {k: (r["n"], share[k], slack * r["bytes"] / open_nodes[k]) for k, r in found.items()})
        cut_rows = _told(spark, [{"of": k, "left": left[k], "cut": dict(zip(_KEY, key, strict=True))} for k, key in cuts.items()], f"of int, left int, cut struct<{_KINDS}>")
        met = aimed.join(F.broadcast(cut_rows), F.col("node") == F.col("of"), "left")
        moved = F.when(F.col("of").isNotNull() & (_key() > F.col("cut")), F.col("node") + F.col("left")).otherwise(F.col("node"))
        placed = met.withColumn("node", moved).select(*placed.columns)
        level += 1
        if level % 5 == 0:  # else each pass follows all cuts so far
            placed = scratch.save(placed, f"level-{level}")
        open_nodes = {child: n for k in found for child, n in ((k, left[k]), (k + left[k], open_nodes[k] - left[k]))}
    ranked, _ = rank_within(placed.select("doc_id", "size", "text_crc32", "h", "row", F.col("node").alias("shard")), "shard", ["doc_id", "h", "row"], scratch)
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
