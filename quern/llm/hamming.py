"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact reranking.

Rotations are learned on a bounded sample so that the signs of rotated unit vectors are balanced bits. The
bits are cut into chunks, each chunk indexes a table, and codes that meet in a bucket of any table are
compared by Hamming distance. What is near goes on to the original vectors and their cosine in double
precision: as pairs where it is sparse, as pairs of whole blocks where it is dense.

How many bits a chunk has, how many tables there are and which distance is near is not assumed but measured, on
pairs made to lie just at the least cosine around sampled vectors. Vectors that share a mean or a family
differ little in angle, so their chunks become short; where tables would not prune at all, a label is one bucket.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import connected_components
from ._scratch import Scratch

#: Words of 64 bits of the code whose Hamming distance is tested.
CODE_WORDS = 2
#: Near pairs of two blocks from which on the blocks are compared whole.
DENSE = 64


def learn_rotation(sample: np.ndarray, seed: int, rounds: int = 40) -> np.ndarray:
    """An orthogonal projection (dimensions x bits) by iterative quantisation of centred vectors."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    basis = np.linalg.svd(sample, full_matrices=False)[2].T if len(sample) >= d else np.linalg.qr(rng.normal(size=(d, d)))[0]
    reduced = sample @ basis
    turn = np.linalg.qr(rng.normal(size=(basis.shape[1],) * 2))[0]
    for _ in range(rounds if len(sample) else 0):
        u, _, vt = np.linalg.svd(np.where(reduced @ turn >= 0, 1.0, -1.0).T @ reduced, full_matrices=False)
        turn = (u @ vt).T
    return basis @ turn


def units(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; each is scaled by its largest component first, so that no square over- or underflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True, initial=np.finfo(float).tiny)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _unit(column: pa.Array) -> np.ndarray:
    return units(np.asarray(column.values if isinstance(column, pa.ListArray) else column.flatten(), np.float64).reshape(len(column), -1))


def pairs_at(sample: np.ndarray, cosine: float, seed: int, n: int = 2000) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unit vectors at that cosine: one towards any direction, one towards another of the sample."""
    rng = np.random.default_rng(seed)
    a = sample[rng.integers(len(sample), size=n)]
    found = []
    for toward in (rng.normal(size=a.shape), sample[rng.integers(len(sample), size=n)] + 1e-9 * rng.normal(size=a.shape)):
        side = toward - (toward * a).sum(axis=1, keepdims=True) * a
        side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-30)
        found.append((a, cosine * a + math.sqrt(1 - cosine**2) * side))
    return found


@dataclass
class Index:
    """What codes are made with; bits 0: a label is one bucket."""

    centre: np.ndarray
    rotation: np.ndarray  # dimensions x all bits
    bits: int
    tables: int
    near: int  # Hamming distance of the first CODE_WORDS words

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunk of each table, and words of the code, of unit vectors."""
        on = (vectors - self.centre) @ self.rotation >= 0
        chunks = on[:, : self.bits * self.tables].reshape(len(on), self.tables, self.bits) @ (1 << np.arange(self.bits)) if self.bits else np.zeros((len(on), 1), np.int64)
        return chunks, np.packbits(on[:, : 64 * CODE_WORDS], axis=1, bitorder="little").view("<u8")


def tables_needed(differ: np.ndarray, bits: int, recall: float, most: int) -> int | None:
    """Fewest tables in which pairs whose bits differ with these chances share a chunk with the mean chance `recall`."""
    agree = (1 - differ) ** bits
    found = lambda t: (1 - (1 - agree) ** t).mean()
    if found(most) < recall:
        return None
    low, high = 1, most
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if found(mid) >= recall else (mid + 1, high)
    return low


def fit_index(sample: np.ndarray, labels: np.ndarray, largest: int, least_cosine: float, recall: float, seed: int, most_tables: int = 160, most_bits: int = 24) -> Index:
    """The cheapest index whose measured recall of pairs at least_cosine is `recall`.

    sample: unit vectors and their labels. For either centre (the mean, or none), the chance that a bit differs is measured on
    made pairs, and on sampled pairs of one label for what would be compared. The cost of bits and tables is rows shipped, buckets
    opened and codes compared for a label of the largest size; where as many pairs would be compared as there are, bits are 0.
    """
    d = sample.shape[1]
    rng = np.random.default_rng(seed)
    at = rng.integers(len(sample), size=(4 * 4000, 2))
    far = at[(labels[at[:, 0]] == labels[at[:, 1]]) & (at[:, 0] != at[:, 1])][:4000]
    made = pairs_at(sample, least_cosine, seed)
    best = None
    for centre in (sample.mean(axis=0), np.zeros(d)):
        turns = [learn_rotation(sample - centre, seed + k) for k in range(math.ceil(256 / d))]
        rotation = np.hstack(turns)
        on = lambda x, c=centre, r=rotation: (x - c) @ r >= 0
        differ = [(on(a) != on(b)).mean(axis=1) for a, b in made]
        apart = (on(sample[far[:, 0]]) != on(sample[far[:, 1]])).mean(axis=1) if len(far) else np.full(1, 0.5)
        for bits in range(2, most_bits + 1):
            needed = [tables_needed(p, bits, recall, most_tables) for p in differ]
            if None in needed:
                break
            tables = max(needed)
            compared = tables * ((1 - apart) ** bits).mean()
            # for each vector, in tests of two codes: a row shipped is worth some hundreds, a bucket some ten thousands
            cost = compared * largest + 300.0 * tables + 50_000.0 * tables * min(1.0, 2.0**bits / largest)
            if compared < 1 and (best is None or cost < best[0]):
                best = cost, centre, bits, tables, turns
    _, centre, bits, tables, turns = best or (0, sample.mean(axis=0), 0, 1, turns)
    columns = max(bits * tables, 64 * CODE_WORDS)
    turns = turns + [learn_rotation(sample - centre, seed + k) for k in range(len(turns), math.ceil(columns / d))]
    rotation = np.hstack(turns)[:, :columns]
    index = Index(centre, rotation, bits, tables, 64 * CODE_WORDS)
    distances = [_distance(index.encode(a)[1], index.encode(b)[1]) for a, b in made]
    index.near = int(max(np.quantile(x, 0.9995) for x in distances)) + 2
    return index


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1)


def near_in_bucket(ids, codes, blocks, side, near: int, rows_at_once: int = 256):
    """(pairs, dense pairs of blocks) of one bucket, or of one pair of parts of a large bucket, by Hamming distance.

    side is 0 and 1 for the two parts of a pair, all 0 for a part against itself. A pair is (u, v, block, block), the
    smaller block first.
    """
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    itself = not len(right)
    right = left if itself else right
    rows = []
    for at in range(0, len(left), rows_at_once):
        mine = left[at : at + rows_at_once]
        a, b = np.nonzero(_distance(codes[mine][:, None], codes[right][None]) <= near)
        a, b = mine[a], right[b]
        keep = ids[a] < ids[b] if itself else ids[a] != ids[b]
        a, b = a[keep], b[keep]
        swap = blocks[a] > blocks[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        rows.append(np.stack([ids[a], ids[b], blocks[a], blocks[b]]))
    found = np.concatenate(rows, axis=1) if rows else np.zeros((4, 0), np.int64)
    tiles, of, count = np.unique(found[2:], axis=1, return_inverse=True, return_counts=True)
    sparse = count[of.ravel()] < DENSE
    return found[:, sparse], tiles[:, count >= DENSE]


def compare_blocks(ids, weights, labels, vectors, side, least_cosine):
    """Links of all of one block with all of another (or of a block with itself): counts by weight, and links that span the components."""
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    itself = not len(right)
    right = left if itself else right
    linked = (vectors[left] @ vectors[right].T >= least_cosine) & (labels[left][:, None] == labels[right][None])
    if itself:
        np.fill_diagonal(linked, False)
    counts = np.zeros(len(ids), np.int64)
    counts[left] += linked @ weights[right]
    if not itself:
        counts[right] += linked.T @ weights[left]
    # each takes the least name among its own and its neighbours' until nothing changes
    name, none = np.arange(len(ids)), len(ids)
    while True:
        before = name.copy()
        name[left] = np.minimum(name[left], np.where(linked, name[right][None], none).min(axis=1, initial=none))
        name[right] = np.minimum(name[right], np.where(linked, name[left][:, None], none).min(axis=0, initial=none))
        if (name == before).all():
            break
    some, joined = np.flatnonzero(counts), np.flatnonzero((name != np.arange(len(ids))) & (counts > 0))
    return ids[some], counts[some], ids[joined], ids[name[joined]]


def near_duplicate_vectors(
    vectors: DataFrame, id_col="vec_id", vector_col="embedding", label_col="label", least_cosine=0.93, recall=0.998, sample_rows=20_000, block_rows=2048, seed=7
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Rows link if their labels are equal and not null and the cosine of their vectors, in double
    precision, is at least least_cosine. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing; finite ones of any size do. Vectors of different lengths do not link. Rows with
    equal label and vector are one class with a weight, so copies cost nothing; repeated ids count
    as rows (each is another vector). A null id stays null and takes part like any other.

    The index is fitted (see ``fit_index``) on at most about sample_rows vectors, spread evenly by hash. Every vector is
    indexed. Tables ship ids and codes, never vectors: a bucket's near pairs, or pairs of blocks that are near in DENSE places, fetch
    theirs. Blocks are cells of the first table, cut at about block_rows, and are compared whole from one copy of each vector. Buckets over
    block_rows are tested part against part in tasks of their own, which finds all their pairs and bounds each task.
    """
    scratch = Scratch(vectors.sparkSession, "hamming")
    spark = vectors.sparkSession
    x = F.col("vector")
    component = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    usable = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast(f"array<{component}>").alias("vector"))
    rows = scratch.save(rows.withColumn("alike", F.when(usable & F.col("label").isNotNull(), F.sha2(F.concat_ws(",", F.lit("v"), F.transform(x, lambda v: v.cast("string"))), 256))), "rows")
    classes = rows.where("alike is not null").groupBy("label", "alike").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("least"), F.first("vector").alias("vector"))
    # numbered once written, so that no two classes share a number
    classes = scratch.save(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    sizes = classes.groupBy(F.size("vector").alias("d"), "label").count().groupBy("d").agg(F.max("count").alias("largest"), F.sum("count").alias("n")).collect()

    counts = edges = None
    for size in sizes:
        d = size["d"]
        share = min(1.0, sample_rows / size["n"])
        mine = classes.where(F.size("vector") == d)
        some = mine.where(F.pmod(F.xxhash64("class", F.lit(seed)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).select("vector", F.xxhash64("label")).limit(2 * sample_rows).collect()
        some = some or mine.select("vector", F.xxhash64("label")).limit(1).collect()
        index = fit_index(units(np.array([r[0] for r in some], np.float64).reshape(-1, d)), np.array([r[1] for r in some]), size["largest"], least_cosine, recall, seed)
        links, spanning = _links_by_index(mine, index, scratch, d, least_cosine, block_rows, component)
        counts = links if counts is None else counts.unionByName(links)
        edges = spanning if edges is None else edges.unionByName(spanning)
    plain = rows.select(F.col("id").alias("vec_id"), "alike", "label")
    if counts is None:
        return plain.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    counts = counts.groupBy("class").agg(F.sum("n").alias("n"))
    roots = connected_components(edges, scratch).withColumnRenamed("node", "class")
    of_class = classes.drop("vector").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class")).join(counts, "class", "left")
    of_class = scratch.save(of_class.select("label", "alike", "least", "root", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "linked")
    smallest = scratch.save(of_class.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    of_class = scratch.save(of_class.join(smallest, "root").select("label", "alike", "n_links", "component_id"), "of-class")
    joined = plain.join(of_class, ["label", "alike"], "left")
    reached = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), reached.alias("component_id"), F.coalesce(F.col("vec_id") == reached, F.lit(True)).alias("kept"))


def _links_by_index(classes: DataFrame, index: Index, scratch: Scratch, d: int, least_cosine: float, block_rows: int, component: str) -> tuple[DataFrame, DataFrame]:
    """(class, n) of linked classes, a row for each place where links were found, and (u, v) of links that span the components."""
    spark = scratch.spark
    sent = spark.sparkContext.broadcast(index)
    label = classes.schema["label"].dataType.simpleString()

    def code(batches):
        index = sent.value
        for batch in batches:
            if batch.num_rows:
                chunks, words = index.encode(_unit(batch.column(2)))
                flat = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat(chunks.astype(np.int32)), flat(words.view(np.int64))], names=["label", "class", "chunks", "code"])

    coded = classes.select("label", "class", "vector").mapInArrow(code, f"label {label}, class long, chunks array<int>, code array<long>")
    coded = scratch.save(coded, f"coded-{d}")
    # blocks: cells of the first table, cut where large; the table of large cells is small, at most rows / block_rows
    cell = F.col("chunks")[0]
    large = coded.groupBy("label", cell.alias("cell")).count().where(F.col("count") > block_rows).select(F.col("label").alias("in_label"), F.col("cell").alias("in_cell"), F.ceil(F.col("count") / block_rows).alias("cuts"))
    split = F.pmod(F.xxhash64("class"), F.coalesce("cuts", F.lit(1)))
    blocked = coded.join(large, (F.col("label") == F.col("in_label")) & (cell == F.col("in_cell")), "left").withColumn("block", F.xxhash64("label", cell, split))
    blocked = scratch.save(blocked.select("label", "class", "chunks", "code", "block"), f"blocked-{d}")
    own_blocks = blocked.select("class", "block")
    if index.bits:
        keyed = blocked.select("label", "class", "code", "block", F.posexplode("chunks").alias("table", "chunk"))
        key = ["label", "table", "chunk"]
        buckets = keyed.groupBy(*key).count().where("count > 1")
        buckets = scratch.save(buckets.withColumn("parts", F.ceil(F.col("count") / block_rows).cast("int")), f"buckets-{d}")
        # a member of part p meets parts p..last as left side and 0..p-1 as right side
        met = keyed.join(buckets, key).withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
        met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        met = met.select(*key, "class", "code", "block", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), (F.col("part") > F.col("other")).cast("int").alias("side"))
        near = index.near

        def test(_, table):
            codes = np.asarray(table["code"].combine_chunks().flatten()).view(np.uint64).reshape(table.num_rows, -1)
            pairs, tiles = near_in_bucket(table["class"].to_numpy(), codes, table["block"].to_numpy(), table["side"].to_numpy(), near)
            nothing = [None] * tiles.shape[1]
            columns = [[*pairs[0].tolist(), *nothing], [*pairs[1].tolist(), *nothing], np.concatenate([pairs[2], tiles[0]]), np.concatenate([pairs[3], tiles[1]])]
            return pa.table([pa.array(c, pa.int64()) for c in columns], names=["u", "v", "a", "b"])

        found = scratch.save(met.groupBy(*key, "low", "high").applyInArrow(test, "u long, v long, a long, b long"), f"found-{d}")
        tiles = scratch.save(found.where("u is null").select("a", "b").distinct(), f"tiles-{d}")
        pairs = found.where("u is not null").distinct().join(tiles, ["a", "b"], "left_anti").select("u", "v")
    else:
        members = own_blocks.join(coded.select("class", "label"), "class").select("label", "block").distinct()
        others = members.select(F.col("label").alias("of"), F.col("block").alias("other"))
        tiles = scratch.save(members.join(others, (F.col("label") == F.col("of")) & (F.col("block") <= F.col("other"))).select(F.col("block").alias("a"), F.col("other").alias("b")).distinct(), f"tiles-{d}")
        pairs = None

    links = []
    sides = tiles.select("a", "b", F.col("a").alias("block"), F.lit(0).alias("side")).unionByName(tiles.where("a <> b").select("a", "b", F.col("b").alias("block"), F.lit(1).alias("side")))
    held = own_blocks.join(classes.select("class", F.xxhash64("label").alias("of"), "weight", "vector"), "class")

    def whole(_, table):
        some, n, u, v = compare_blocks(table["class"].to_numpy(), table["weight"].to_numpy(), table["of"].to_numpy(), _unit(table["vector"].combine_chunks()), table["side"].to_numpy(), least_cosine)
        return pa.table([pa.array([*some.tolist(), *u.tolist()], pa.int64()), pa.array([None] * len(some) + v.tolist(), pa.int64()), pa.array([*n.tolist(), *[None] * len(u)], pa.int64())], names=["u", "v", "n"])

    links.append(held.join(sides, "block").select("a", "b", "side", "class", "of", "weight", "vector").groupBy("a", "b").applyInArrow(whole, "u long, v long, n long"))
    if pairs is not None:
        of = lambda name: classes.select(F.col("class").alias(name), F.col("weight").alias(f"{name}_weight"), F.col("vector").alias(f"{name}_vector"))

        def rerank(batches):
            for batch in batches:
                if batch.num_rows:
                    cosine = (_unit(batch.column(4)) * _unit(batch.column(5))).sum(axis=1)
                    kept = batch.filter(pa.array(cosine >= least_cosine))
                    yield pa.RecordBatch.from_arrays([kept.column(k) for k in range(4)], names=["u", "v", "u_weight", "v_weight"])

        fetched = pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", "u_weight", "v_weight", "u_vector", "v_vector")
        close = scratch.save(fetched.mapInArrow(rerank, "u long, v long, u_weight long, v_weight long"), f"close-{d}")
        none = F.lit(None).cast("long")
        links += [close.select("u", none.alias("v"), F.col("v_weight").alias("n")), close.select(F.col("v").alias("u"), none.alias("v"), F.col("u_weight").alias("n")), close.select("u", "v", none.alias("n"))]
    made = links[0]
    for more in links[1:]:
        made = made.unionByName(more)
    made = scratch.save(made, f"links-{d}")
    scratch.drop(f"coded-{d}", f"blocked-{d}", f"buckets-{d}", f"found-{d}", f"tiles-{d}", f"close-{d}")
    return made.where("n is not null").select(F.col("u").alias("class"), "n"), made.where("v is not null").select("u", "v")
