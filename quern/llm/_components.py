"""Connected components by repeated contraction; no step gathers a group or an unbounded graph in one place."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch

#: A graph of at most so many edges is finished in one task; a larger one is contracted first.
FINISHED_AT_ONCE = 1 << 16


def _finished(batches):
    """(node, root) of all edges of a small graph: roots hook to smaller ones, paths are halved."""
    edges = pa.Table.from_batches(list(batches), pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    u, v = edges["u"].to_numpy(), edges["v"].to_numpy()
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(names))
    while (root[a] != root[b]).any():
        ra, rb = root[a], root[b]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root != root[root]).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(names[root], pa.int64())], names=["node", "root"])


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node that has an edge; root is the same member for all of a component.

    edges has long columns u, v; loops, both directions and repeats are allowed. In each round a node
    joins the neighbour (or itself) that comes first in a random order of that round, edges between
    joined nodes vanish, and the rest is contracted. The random order keeps long paths from taking
    one round a node; in expectation a fixed share of the nodes goes in each round. Minima are
    pre-aggregated and both sides of each join are written tables, so a node with very many edges
    is split by adaptive execution. What is left is finished in one task once it is small.
    """
    pair = [F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")]
    left = scratch.save(edges.where("u <> v").select(*pair).distinct(), "edges-0")
    roots = None
    turn = 0
    while (n := left.count()) > FINISHED_AT_ONCE:
        turn += 1
        order = F.xxhash64("v", F.lit(turn))
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = both.groupBy("u").agg(F.min(F.struct(order.alias("o"), "v")).alias("n"))
        own = F.xxhash64("u", F.lit(turn))
        joins = nearest.select(F.col("u").alias("node"), F.when(own <= F.col("n.o"), F.col("u")).otherwise(F.col("n.v")).alias("to"))
        joins = scratch.save(joins, f"joins-{turn}")
        roots = joins.withColumnRenamed("to", "root") if roots is None else scratch.save(_followed(roots, joins, "to"), f"roots-{turn}")
        u = joins.select(F.col("node").alias("u"), F.col("to").alias("tu"))
        v = joins.select(F.col("node").alias("v"), F.col("to").alias("tv"))
        moved = left.join(u, "u").join(v, "v").where("tu <> tv").select(F.least("tu", "tv").alias("u"), F.greatest("tu", "tv").alias("v"))
        left = scratch.save(moved.distinct(), f"edges-{turn}")
        scratch.drop(f"edges-{turn - 1}", f"roots-{turn - 1}", *([f"joins-{turn}"] if turn > 1 else []))
    if n:
        rest = scratch.save(left.coalesce(1).mapInArrow(_finished, "node long, root long"), "rest")
        roots = rest if roots is None else scratch.save(_followed(roots, rest.withColumnRenamed("root", "to"), "to"), "roots")
    if roots is None:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots


def _followed(roots: DataFrame, joins: DataFrame, to: str) -> DataFrame:
    return roots.join(joins.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce(to, "root").alias("root"))
