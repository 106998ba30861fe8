"""SimHash near-duplicates: pigeonhole blocks find all fingerprints within a Hamming distance."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._components import connected_components
from ._scratch import Scratch, shuffle_partitions, named, unused
from .similar_sets import min_hash_bands, parity_sketch, similar_groups
from .tokens import text_runs

BITS = 64
_SHINGLES_AT_ONCE = 1 << 17


def _bit_counts(hashes: list[int] | np.ndarray) -> np.ndarray:
    bytes_ = np.asarray(hashes if isinstance(hashes, np.ndarray) else np.array(hashes, "<u8")).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(bytes_, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def simhash(text: str | None, words_per_shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash (unsigned) of the word shingles of a whole text, repeats included.

    A-Z are lowered; words are runs other than ASCII white space. A text of fewer words is one
    shingle; one without words (null, empty) has fingerprint zero.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(words_per_shingle, len(words))
    starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), _SHINGLES_AT_ONCE):
        some = slice(at, at + _SHINGLES_AT_ONCE)
        total += _bit_counts([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)])
    return int(np.packbits(2 * total > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", words_per_shingle: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row."""

    def each(batches):
        for batch in batches:
            made = [simhash(t.as_py(), words_per_shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(made, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def block_masks(blocks: int, shared: int) -> list[int]:
    """Masks (signed) of all choices of `shared` of so many nearly equal blocks of 64 bits."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    one = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [_signed(sum(some)) for some in combinations(one, shared)]


def blocks_for(n: int, distance: int, per_bucket: float = 0.25, most: int = 5) -> int:
    """Blocks such that n random fingerprints put at most per_bucket others in a bucket.

    With distance + s blocks, a close pair shares s of them at least; any choice finds all pairs.
    """
    s = 1
    while s < most and n / 2.0 ** (BITS * s / (distance + s)) > per_bucket:
        s += 1
    return distance + s


def close_links(prints: DataFrame, scratch: Scratch, distance: int = 4, bucket_limit: int = 128) -> DataFrame:
    """Edges (u, v) between distinct fingerprints that connect exactly those within the distance.

    prints has one row per distinct fp, written. Fingerprints in a bucket (equal bits in the same
    blocks) of at most bucket_limit are compared there. Those in larger buckets, a dense family,
    are linked without pairs: two are within the distance just if some value lies within half of
    it of both, so each is listed under all such values and neighbours under a value are chained.
    Edges then connect what pairs would, by a number of rows that is linear in the family.
    """
    if distance % 2:
        raise ValueError("the distance must be even")
    spark = scratch.spark
    masks = block_masks((b := blocks_for(prints.count(), distance)), b - distance)
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("block", "key"))
    counted = keyed.groupBy("block", "key").agg(F.count(F.lit(1)).alias("count"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("count > 1")
    counted = scratch.save(counted, "buckets")
    # most buckets hold two: the count has both, and only members of larger ones are fetched
    two = counted.where("count = 2").where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance).select("u", "v")
    buckets = counted.where("count > 2").select("block", "key", "count")
    shared = keyed.join(buckets, ["block", "key"])
    small = shared.where(F.col("count") <= bucket_limit).groupBy("block", "key").agg(F.collect_list("fp").alias("fps"))
    near = F.filter("fps", lambda y: (y > F.col("u")) & (F.bit_count(y.bitwiseXOR(F.col("u"))) <= distance))
    pairs = small.select("fps", F.explode("fps").alias("u")).select("u", F.explode(near).alias("v"))
    pairs = scratch.save(pairs.unionByName(two).distinct(), "pairs")
    if buckets.where(F.col("count") > bucket_limit).isEmpty():
        return pairs
    dense = shared.where(F.col("count") > bucket_limit).select("fp").distinct()
    flips = [0] + [_signed(sum(1 << b for b in some)) for k in range(1, distance // 2 + 1) for some in combinations(range(BITS), k)]
    ball = F.transform(F.array(*[F.lit(f) for f in flips]), lambda f: f.bitwiseXOR(F.col("fp")))
    listed = dense.repartition(shuffle_partitions(spark), "fp").select("fp", F.explode(ball).alias("value"))
    before = F.lag("fp").over(Window.partitionBy("value").orderBy("fp"))
    chained = listed.select("fp", before.alias("u")).where("u is not null").select("u", F.col("fp").alias("v")).distinct()
    return pairs.unionByName(scratch.save(chained, "chained"))


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", words_per_shingle=4, distance=4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row.

    Rows with equal fingerprints form a class; classes link at `distance` or fewer differing bits;
    component_id is the smallest doc_id that links reach. Texts without words have fingerprint zero
    and link like others. A null doc_id is kept and is nobody's smallest unless all ids are null.
    Repeated rows stay. Only fingerprints are shuffled, and each class counts once.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    found = scratch.save(fingerprints(docs, id_col, text_col, words_per_shingle), "found")
    prints = scratch.save(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = connected_components(close_links(prints, scratch, distance), scratch).withColumnRenamed("node", "fp")
    rooted = scratch.save(prints.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    smallest = scratch.save(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    classes = scratch.save(rooted.join(smallest, "root").select("fp", "component_id"), "classes")
    scratch.drop("prints", "buckets", "pairs", "chained", "rooted", "smallest")
    return found.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_hashes(text: str | None, words_per_shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles (A-Z lowered; of fewer words: the whole)."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    size = min(words_per_shingle, len(words))
    made = {xxh64_intdigest(b" ".join(words[k : k + size])) for k in range(len(words) - size + 1)} if words else set()
    return np.sort(np.fromiter(made, np.uint64, len(made)).view(np.int64))


def _lists(lists: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *[len(x) for x in lists]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64)))


def _majority(elements: np.ndarray) -> int:
    """SimHash (signed) of a set of hashes: each counts once."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(elements), _SHINGLES_AT_ONCE):
        total += _bit_counts(elements[at : at + _SHINGLES_AT_ONCE])
    return int(np.packbits(2 * total > len(elements), bitorder="little").view("<i8")[0])


def remove_near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", words_per_shingle=5, similarity=0.8, distance=4, bucket_limit=16) -> DataFrame:
    """docs with one row of each group of texts whose word shingles have Jaccard similarity >= `similarity`.

    Candidates are texts whose SimHashes (over distinct shingles) share pigeonhole blocks for
    `distance`; as texts of similarity 0.8 differ in 10 of 64 bits on average, min-hash bands add the
    pairs that no SimHash reaches (similar_sets.py has the chance of a miss, 2.6e-5 at 0.8). All
    candidates are decided on the shingles of both whole texts, and a group is what links connect.
    The row of smallest (doc_id, text digest) of a group stays.

    Null texts count as empty; texts without words are similar to one another. A null id comes
    after others. Of rows equal in id and text one stays. Columns are those of docs.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-duplicates")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    place, digest = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit((1 << 63) - 1)), F.unhex(F.md5(text))
    read = docs.select(place.alias("place"), digest.alias("digest"), text.alias("text"))

    def described(batches):
        from xxhash import xxh3_128_digest

        for batch in batches:
            made = []
            for t in batch.column(2):
                x = shingle_hashes(t.as_py(), words_per_shingle)
                made.append((xxh3_128_digest(x.tobytes()), len(x), _majority(x), parity_sketch(x), min_hash_bands(x)))
            sets, n, fp, sketches, bands = zip(*made, strict=True) if made else [()] * 5
            columns = [pa.array(sets, pa.binary()), pa.array(n, pa.int32()), pa.array(fp, pa.int64()), _lists(list(sketches)), _lists(list(bands))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["place", "digest", "set", "n", "fp", "sketch", "bands"])

    def shingled(batches):
        for batch in batches:
            for low, high in text_runs(batch.column(1)):
                lists = [shingle_hashes(t.as_py(), words_per_shingle) for t in batch.column(1)[low:high]]
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], _lists(lists)], names=["key", "elements"])

    found = scratch.save(read.mapInArrow(described, "place long, digest binary, set binary, n int, fp long, sketch array<long>, bands array<long>"), "found")
    texts = scratch.save(found.groupBy("set", "place", "digest").agg(F.count(F.lit(1)).alias("rows")), "texts")
    # equal sets are one class, and what follows from the set alone is equal in all its rows
    of_set = ["n", "fp", "sketch", "bands"]
    classes = found.groupBy("set").agg(F.min(F.struct("place", "digest")).alias("first"), *[F.any_value(c).alias(c) for c in of_set])
    sets = scratch.save(classes.select(F.monotonically_increasing_id().alias("key"), "set", "first", *of_set), "sets")
    scratch.drop("found")

    masks = block_masks((b := blocks_for(sets.count(), distance)), b - distance)
    blocks = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(masks)]
    members = sets.select("key", F.explode(F.concat(F.array(*blocks), "bands")).alias("bucket"))

    def elements_of(keys: DataFrame) -> DataFrame:
        firsts = sets.join(keys, "key").select("key", "first.place", "first.digest")
        wanted = read.join(firsts, ["place", "digest"]).select("key", "text").dropDuplicates(["key"])
        return wanted.mapInArrow(shingled, "key long, elements array<long>")

    roots = similar_groups(sets, members, elements_of, similarity, scratch, bucket_limit)
    rooted = sets.join(roots, "key", "left").select("first", F.coalesce("root", "key").alias("root"))
    stays = scratch.save(rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.place", "first.digest"), "stays")
    p, d = unused(docs, "place"), unused(docs, "digest")
    gone = scratch.save(texts.join(stays, ["place", "digest"], "left_anti").select(F.col("place").alias(p), F.col("digest").alias(d)), "gone")
    again = scratch.save(texts.where("rows > 1").join(stays, ["place", "digest"]).select(F.col("place").alias(p), F.col("digest").alias(d)), "again")
    scratch.drop("sets", "texts")
    columns = [named(c) for c in docs.columns]
    left = docs.select(*columns, place.alias(p), digest.alias(d)).join(gone, [p, d], "left_anti")
    if not again.isEmpty():
        left = left.join(again, [p, d], "left_anti").unionByName(left.join(again, [p, d], "left_semi").dropDuplicates([p, d]))
    return left.select(*columns)
