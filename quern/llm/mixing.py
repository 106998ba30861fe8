"""Mixing of sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._rank import rank_within
from ._scratch import Scratch, named

WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text_col: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def share_out(sizes: dict[str | None, int], weights=(5, 2, 1), total_share=1.5, most_times=2) -> dict[str | None, float]:
    """Target of each source: total_share of all sizes by weight, none above most_times its own size.

    Sources take the weights in turn, in the order of their code points, null last. What a full
    source cannot take goes to the others by weight. Filled in the order of room per weight, the
    level at which the rest is shared is found in one pass.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    level, rest, parts = 0.0, total_share * sum(sizes.values()), sum(weight.values())
    for s in sorted(order, key=lambda s: most_times * sizes[s] / weight[s]):
        level = rest / parts
        if most_times * sizes[s] > level * weight[s]:
            break
        rest, parts = rest - most_times * sizes[s], parts - weight[s]
    return {s: float(min(most_times * sizes[s], level * weight[s])) for s in order}


def mixing_plan(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(5, 2, 1), total_share=1.5, most_times=2, seed="mix", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken.

    A document's expected copies are its source's target over its source's size. They are summed in
    the order of (size, doc_id) within the source, one offset drawn from (seed, source) is added,
    and a document is taken once for each whole number that the sum passes at it. With neighbours
    of like size, what a source gives stays within about one document of its target. The sums come
    from ranks (see ``rank_within``), so a source with a third of all rows isn't one task.

    carry names columns of docs to keep. size is the number of words (null text: 0). Null sources are a source; null and repeated ids
    are sampled like others. Reruns agree. The driver holds one row per source.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), *carry)
    if not carry:  # else the carried columns would be written twice
        slim = scratch.save(slim, "sizes")
    sizes = {r["source"]: r["size"] for r in slim.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    targets = share_out(sizes, weights, total_share, most_times)
    schema = T.StructType([T.StructField("_of", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    of_source = F.broadcast(docs.sparkSession.createDataFrame([(s, sizes[s], targets[s]) for s in sizes], schema))
    ranked, _ = rank_within(slim, "source", ["size", "doc_id"], scratch)
    if not carry:
        scratch.drop("sizes")
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("\0null")))), 1, 8), 16, 10).cast("double") / 2.0**32
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    passed = F.floor(each * (F.col("rank") + 1) + start) - F.floor(each * F.col("rank") + start)
    return (
        ranked.join(of_source, F.col("source").eqNullSafe(F.col("_of")))
        .withColumn("copies", F.least(passed, F.ceil(each)).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select("doc_id", "size", "source_size", "target", "copies", "taken", *carry)
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each row as often as ``mixing_plan`` takes it, with the columns of docs."""
    whole = docs.withColumn("_whole", F.struct(*[named(c) for c in docs.columns]))
    plan = mixing_plan(whole, carry=("_whole",), **options).where("copies > 0")
    return plan.select("_whole", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("_whole.*")
