"""Groups of similar sets: candidates share a key, sketches rule pairs out, and the rest is compared exactly.

No bucket is expanded into all its pairs. Members are compared with one member of their bucket that
shares most keys; what that connects is one group, and only pairs across groups are looked at again.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._components import connected_components
from ._scratch import Scratch

#: Longs of a parity sketch: bit h % (64 * _LONGS) is the parity of the elements h that fall on it.
_LONGS = 8
#: Two sets of similarity t miss each other with a chance of (1 - t ** ROWS) ** BANDS: 2.6e-5 at 0.8, at any number of sets.
BANDS, ROWS = 20, 4
_ELEMENTS_AT_ONCE = 1 << 12
_PICKY_TURNS = 2

_rng = np.random.default_rng(20)
_FLIP, _TIMES = (_rng.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)
_FOLD = _rng.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)


def min_hash_bands(elements: np.ndarray) -> np.ndarray:
    """A long a band, equal for two sets with a chance of their Jaccard similarity to the power ROWS."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(elements), _ELEMENTS_AT_ONCE):
        some = elements[at : at + _ELEMENTS_AT_ONCE].view(np.uint64)[None, :]
        least = np.minimum(least, ((some ^ _FLIP) * _TIMES).min(axis=1))
    folded = least.reshape(BANDS, ROWS) ^ (least.reshape(BANDS, ROWS) >> np.uint64(29))
    return (folded * _FOLD).sum(axis=1, dtype=np.uint64).view(np.int64)


def parity_sketch(elements: np.ndarray) -> np.ndarray:
    """Two sets differ in at least as many elements as their sketches differ in bits."""
    odd = np.bincount(elements & (64 * _LONGS - 1), minlength=64 * _LONGS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _possible(a: str, b: str, similarity: float) -> Column:
    """False only where sizes or sketches rule the similarity out."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    differ = reduce(add, [F.bit_count(F.get(f"{a}sketch", k).bitwiseXOR(F.get(f"{b}sketch", k))) for k in range(_LONGS)])
    return (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-6) & (differ <= (1 - similarity) / (1 + similarity) * (n + m) + 1e-6)


def _named(df: DataFrame, before: str, *more: str) -> DataFrame:
    return df.select(*[F.col(c).alias(before + c) for c in ["key", *more, "n", "sketch"]])


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()


def similar_groups(sets: DataFrame, members: DataFrame, elements_of, similarity: float, scratch: Scratch, bucket_limit: int = 16) -> DataFrame:
    """(key, root) of all sets that have a partner: sets that pairs of at least that similarity link have one root.

    sets is written, one row a set: key (long), n, and the sketch (an array of longs). members has (key, bucket): sets in
    a common bucket are candidates, and all their pairs are decided. elements_of(keys) gives key and
    elements of those sets; it is asked once for each set at most.
    """
    fetched: list[DataFrame] = []

    def possible(pairs: DataFrame) -> DataFrame:
        met = pairs.join(_named(sets, "a_").withColumnRenamed("a_key", "a"), "a").join(_named(sets, "b_").withColumnRenamed("b_key", "b"), "b")
        return met.where(_possible("a_", "b_", similarity)).select("a", "b")

    def verified(near: DataFrame, name: str) -> DataFrame:
        wanted = near.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        for known in fetched:
            wanted = wanted.join(known.select("key"), "key", "left_anti")
        fetched.append(scratch.save(elements_of(wanted), f"{name}-elements"))
        elements = reduce(DataFrame.unionByName, fetched)
        met = near.join(elements.toDF("a", "x"), "a").join(elements.toDF("b", "y"), "b")
        common = F.size(F.array_intersect("x", "y"))
        union = F.size("x") + F.size("y") - common
        return scratch.save(met.where((union == 0) | (common >= similarity * union)).select(F.col("a").alias("u"), F.col("b").alias("v")), name)

    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = scratch.save(members.join(sizes, "bucket").select("bucket", "key", "size"), "members")
    # a text that many were copied from shares more keys with each of them than they do with one another
    score = shared.groupBy("key").agg(F.sum("size").alias("score"))
    centres = shared.join(score, "key").groupBy("bucket").agg(F.max(F.struct("score", "key"))["key"].alias("centre"))
    shared = scratch.save(shared.join(centres, "bucket"), "centred")
    scratch.drop("members")
    links = verified(scratch.save(possible(_ordered(shared, "key", "centre")), "near-0"), "links-0")
    roots = connected_components(links, scratch.inner("roots-0"))

    # pairs across groups that no centre decided
    grouped = shared.where("size > 2").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    grouped = scratch.save(grouped, "grouped")
    open_ = grouped.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    rest = scratch.save(grouped.join(open_, "bucket").where("key <> centre").select("bucket", "key", "size", "root"), "rest")
    scratch.drop("near-0", "centred", "grouped")
    few = rest.where(F.col("size") <= bucket_limit).groupBy("bucket").agg(F.collect_list(F.struct("key", "root")).alias("all")).select("all", F.explode("all").alias("one"))
    few = few.select("one", F.explode(F.filter("all", lambda x: (x["key"] > F.col("one.key")) & (x["root"] != F.col("one.root")))).alias("other"))
    few = few.select(F.col("one.key").alias("a"), F.col("other.key").alias("b"))
    many = rest.where(F.col("size") > bucket_limit)
    # of two members of different groups at least one isn't of the bucket's largest group
    largest = many.groupBy("bucket", "root").count().groupBy("bucket").agg(F.max(F.struct("count", "root"))["root"].alias("largest"))
    blocks = F.ceil(F.col("size") / 512).cast("int")
    outside = many.join(largest, "bucket").where("root <> largest").join(_named(sets, ""), "key").withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int"))
    inside = many.join(outside.select("bucket").distinct(), "bucket", "left_semi").join(_named(sets, ""), "key").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    across = _named(outside, "a_", "bucket", "block", "root").join(_named(inside, "b_", "bucket", "block", "root"), (F.col("a_bucket") == F.col("b_bucket")) & (F.col("a_block") == F.col("b_block")) & (F.col("a_root") != F.col("b_root")) & _possible("a_", "b_", similarity))
    across = _ordered(across, "a_key", "b_key")
    left = scratch.save(possible(few.distinct()).unionByName(across).distinct(), "left-0")
    turn = 0
    while not left.isEmpty():
        turn += 1
        chosen = left
        if turn <= _PICKY_TURNS:  # one pair of each set first: what it connects makes most others needless
            chosen = _ordered(left.groupBy("a").agg(F.min("b").alias("b")).unionByName(left.groupBy("b").agg(F.max("a").alias("a")).select("a", "b")), "a", "b")
        chosen = scratch.save(chosen, f"chosen-{turn}")
        links = links.unionByName(verified(chosen, f"links-{turn}"))
        roots = connected_components(links, scratch.inner(f"roots-{turn}"))
        root_of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        met = left.join(chosen, ["a", "b"], "left_anti").join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
        left = scratch.save(met.where("not coalesce(root_a = root_b, false)").select("a", "b"), f"left-{turn}")
    return roots.withColumnRenamed("node", "key")
