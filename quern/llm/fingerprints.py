"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

A term is a word, its weight the times it occurs. For each of `samples` slots and each term, two gamma
variates and a uniform, all drawn by hashing (slot, term), turn the weight into a sample; the slot
keeps the term of the smallest. Two texts keep the same sample in a slot with a chance equal to
their generalised Jaccard similarity (the sum of smaller weights over the sum of larger ones), so
the share of equal slots estimates it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._scratch import shuffle_partitions

SAMPLES = 48
WHITE_SPACE = "[\\x20\\x09-\\x0D]+"
CODE_DIGITS = 4  # hex digits of a slot in the fingerprint
_BUCKETS = 4  # of neighbouring documents, and tasks, for each shuffle partition: what a task counts stays in memory
_FINE, _COARSE = (1 << 21) - 1, 0xFFFFFFFF


def _uniform(bits: F.Column, mask: int) -> F.Column:
    """A uniform variate in (0, 1) from the low bits of a hash."""
    return (bits.bitwiseAND(F.lit(mask)) + 0.5) * (1.0 / (mask + 1))


def sample(term: F.Column, weight: F.Column, slot: int | F.Column) -> F.Column:
    """A long for a term of that weight (1 or more): its place in the slot's order above 32 bits of its identity.

    By the scheme of consistent weighted sampling: r, c ~ Gamma(2, 1), b ~ U(0, 1),
    t = floor(ln w / r + b), and the smallest ln a = ln c - r (t - b) - r wins. The five uniform
    variates behind r, b and c come from bits of two hashes that no two of them share.
    """
    h, g = F.xxhash64(term, F.lit(2 * slot)), F.xxhash64(term, F.lit(2 * slot + 1))
    b = _uniform(h, _FINE)
    r = -F.ln(_uniform(F.shiftrightunsigned(h, 21), _FINE) * _uniform(F.shiftrightunsigned(h, 42), _FINE))
    ln_c = F.ln(-F.ln(_uniform(g, _COARSE) * _uniform(F.shiftrightunsigned(g, 32), _COARSE)))
    t = F.floor(F.ln(weight) / r + b)
    ln_a = ln_c - r * (t - b + 1.0)  # within -64 and 64 for any weight below 2**31
    identity = h.bitwiseXOR(t).bitwiseAND(F.lit(_COARSE))
    return F.shiftleft(F.floor((ln_a + 64.0) * 2.0**24), 32).bitwiseOR(identity)


def _signature(samples: F.Column) -> F.Column:
    """Codes of all slots; null for a text without terms."""
    code = lambda x: x.bitwiseAND(F.lit((1 << 4 * CODE_DIGITS) - 1)).cast("int")
    return F.when(F.get(samples, 0).isNotNull(), F.transform(F.slice(samples, 1, SAMPLES), code))


def likeness(a: str, b: str) -> F.Column:
    """Share of equal slots of two signatures; 1 for two texts without terms, 0 for one."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    both = F.col(a).isNull() & F.col(b).isNull()
    return F.when(both, 1.0).otherwise(F.coalesce(equal / F.lit(float(SAMPLES)), F.lit(0.0)))


def fingerprint_text(signature: str) -> F.Column:
    code = lambda x: F.lpad(F.lower(F.hex(x.cast("long"))), CODE_DIGITS, "0")
    return F.coalesce(F.array_join(F.transform(signature, code), ""), F.lit("-" * CODE_DIGITS * SAMPLES))


def weighted_signatures(rows: DataFrame, group: str, key: str, texts: list[str], told: dict[str, F.Column] | None = None) -> DataFrame:
    """group, key, a signature column sig_<text> of each text column (null: no terms), and the longs in told.

    rows must be dealt by the column group, and key (a number) tells the rows of a group apart: then
    no step shuffles. A sample depends on term and weight alone, so each is computed once for all
    rows of a group that have it. What is told of a row rides along as the words of one more text,
    each the minimum of a slot, so that it need not be joined to the signatures.
    """
    told = told or {}
    n = len(texts) + 1
    hashes = lambda t: F.sort_array(F.transform(F.array_remove(F.split(t, WHITE_SPACE), ""), lambda w: F.xxhash64(w)))
    lists = F.array(*[F.coalesce(hashes(F.col(t)), F.array().cast("array<bigint>")) for t in texts], F.array(*[c.cast("long") for c in told.values()]).cast("array<bigint>"))
    each = rows.select(group, key, lists.alias("lists")).select(group, key, F.posexplode("lists").alias("of", "terms"))
    is_told = F.col("of") == len(texts)
    # a text's words are sorted where they are, so that runs of equal ones are its terms: one row a term, none a word
    first_of_run = lambda i: is_told | (i == 0) | (F.get("terms", i) != F.get("terms", i - 1))
    starts = F.filter(F.sequence(F.lit(0), F.size("terms") - 1), first_of_run)
    runs = each.where(F.size("terms") > 0).select(group, (F.col(key).cast("long") * n + F.col("of")).alias("at"), is_told.alias("is_told"), "terms", starts.alias("starts"))
    begun = runs.select(group, "at", "is_told", "terms", "starts", F.posexplode("starts").alias("nth", "start"))
    weight = F.coalesce(F.get("starts", F.col("nth") + 1), F.size("terms")) - F.col("start")
    counted = begun.select(group, "at", F.when(F.col("is_told"), F.col("start") + 1).otherwise(0).alias("slot"), F.get("terms", F.col("start")).alias("term"), weight.cast("long").alias("weight"))
    # the term leads: sorts compare the first key before they look at rows, and the rows of a task share a few groups
    alike = counted.groupBy("term", "weight", "slot", group).agg(F.collect_list("at").alias("rows"))
    slots = [f"s{s}" for s in range(max(SAMPLES, len(told)))]
    of_slot = lambda k: sample(F.col("term"), F.col("weight").cast("double"), k)
    told_or = lambda k: F.when(F.col("slot") == 0, of_slot(k)).when(F.col("slot") == k + 1, F.col("term")) if k < len(told) else of_slot(k)
    sampled = alike.select(group, "rows", *[told_or(k).alias(s) for k, s in enumerate(slots)])
    # one minimum a slot, and no test where nothing is told: the JVM compiles no method of over 8000 bytes
    least = sampled.select(group, F.explode("rows").alias("at"), *slots).groupBy(group, "at").agg(*[F.min(s).alias(s) for s in slots])
    signed = least.select(group, F.floor(F.col("at") / n).cast("long").alias(key), F.pmod("at", F.lit(n)).alias("of"), F.array(*slots).alias("least"))
    found = signed.groupBy(group, key).agg(*[F.max(F.when(F.col("of") == k, F.col("least"))).alias(f"of_{k}") for k in range(n)])
    return found.select(group, key, *[_signature(F.col(f"of_{k}")).alias(f"sig_{t}") for k, t in enumerate(texts)], *[F.get(f"of_{n - 1}", k).alias(c) for k, c in enumerate(told)])


def _in_pieces(hex_: F.Column, name: str, pieces: int = 8) -> dict[str, F.Column]:
    """Longs that hold eight hex digits each."""
    return {f"{name}{k}": F.conv(F.substring(hex_, 8 * k + 1, 8), 16, 10) for k in range(pieces)}


def _from_pieces(name: str, pieces: int = 8) -> F.Column:
    return F.lower(F.concat(*[F.lpad(F.hex(f"{name}{k}"), 8, "0") for k in range(pieces)]))


def fingerprint_documents(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id (a long) and fingerprint of every row of docs; null and empty texts have one of dashes.

    Repeated rows and null ids stay rows of their own.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    n = _BUCKETS * shuffle_partitions(docs.sparkSession)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(n))).repartition(n, "part").withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("row")))
    return weighted_signatures(dealt, "part", "nth", ["text"], {"doc_id": F.col("doc_id")}).select("doc_id", fingerprint_text("sig_text").alias("fingerprint"))


def _dealt_by_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, tie and a bucket of neighbours each, so that (bucket, doc_id, tie) ascend together, null ids first.

    Bounds are quantiles of all ids, a few for each shuffle partition. An id (or null) that holds
    several quantiles has as many buckets, dealt by tie, the hash of the text.
    """
    n = _BUCKETS * shuffle_partitions(docs.sparkSession)
    coarse = int(n**0.5) + 1
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.shiftrightunsigned(F.xxhash64("text"), 1))
    found, known, total = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 20 * n), F.count("doc_id"), F.count(F.lit(1))).first()
    of_null = max(1, round(n * (total - known) / max(1, total)))
    bounds = sorted(set(found or []))
    shares = [(found or []).count(b) for b in bounds] + [1]
    spread = lambda m: F.floor(F.col("tie") / 2.0**63 * m).cast("int")
    longs = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<bigint>")
    # search among every coarse-th bound, then between two of them
    head = F.size(F.filter(longs(bounds[::coarse]), lambda b: b < F.col("doc_id")))
    groups = F.array(*[longs(bounds[k + 1 : k + coarse]) for k in range(0, max(1, len(bounds)), coarse)])
    inner = F.size(F.filter(F.get(groups, head - 1), lambda b: b < F.col("doc_id")))
    at = F.when(head == 0, 0).otherwise((head - 1) * coarse + 1 + inner)
    before = [of_null + sum(shares[:k]) for k in range(len(shares))]
    placed = rows.withColumn("at", at)
    own = F.when(F.col("doc_id") == F.get(longs(bounds), F.col("at")), spread(F.get(longs(shares), F.col("at")))).otherwise(0)
    bucket = F.when(F.col("doc_id").isNull(), spread(F.lit(of_null))).otherwise(F.get(longs(before), F.col("at")).cast("int") + own)
    return placed.withColumn("bucket", bucket).drop("at")


def edited_likeness(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and the likeness of each to them.

    The edited text is the text with its last floor(n/2) code points replaced by the first as many
    (or all) of the next document's, in the order of descending id; after the last comes the first.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents are dealt once, by neighbouring ids, in the one shuffle of texts; the first of the next
    bucket comes as a guest at the end of each. Null texts are empty and null ids come last; rows that tie in id come in the
    order of a hash of the text, and rows equal in both are neighbours. A table of one row is
    its own next; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = _dealt_by_order(docs, id_col, text_col)
    # the first of a bucket, in descending order, is the guest of the bucket above it that has rows
    edge = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("tie"))
    tops = rows.groupBy("bucket").agg(F.max(edge).alias("top")).collect()  # one row a bucket
    order = sorted((r["bucket"] for r in tops), reverse=True)
    host = {order[(k + 1) % len(order)]: b for k, b in enumerate(order)}
    top_rows = [(r["bucket"], host[r["bucket"]], r["top"]["id"] if r["top"]["known"] else None, r["top"]["tie"]) for r in tops]
    hosts = spark.createDataFrame(top_rows, "bucket int, host int, top long, top_tie long")
    guests = rows.join(F.broadcast(hosts), "bucket").where(F.col("doc_id").eqNullSafe(F.col("top")) & (F.col("tie") == F.col("top_tie")))
    guests = guests.groupBy("host", "doc_id", "tie").agg(F.min("text").alias("text")).select("doc_id", "text", "tie", F.col("host").alias("bucket"), F.lit(1).alias("guest"))
    dealt = rows.withColumn("guest", F.lit(0)).unionByName(guests).repartition(_BUCKETS * shuffle_partitions(spark), "bucket")
    down = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.desc("tie"), "text")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    kept = F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int"))
    edited = F.concat(kept, F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    numbered = (
        dealt.withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("next_text", F.lead("text").over(down))
        .withColumn("nth", F.row_number().over(down).cast("long"))
        .withColumn("edited", F.when(F.col("guest") == 0, edited).otherwise(""))
    )
    sha = F.sha2(F.encode("edited", "UTF-8"), 256)
    signed = weighted_signatures(numbered, "bucket", "nth", ["text", "edited"], {"doc_id": F.col("doc_id"), "n_chars": F.col("n_chars"), "guest": F.col("guest")} | _in_pieces(sha, "sha"))
    follow = Window.partitionBy("bucket").orderBy("nth")
    likened = signed.withColumn("sig_next", F.lead("sig_text").over(follow)).where("guest = 0")
    return likened.select(
        "doc_id", "n_chars", _from_pieces("sha").alias("edited_sha256"), fingerprint_text("sig_text").alias("fingerprint"), fingerprint_text("sig_edited").alias("edited_fingerprint"),
        likeness("sig_text", "sig_edited").alias("near_edited"), likeness("sig_text", "sig_next").alias("near_next"),
    )
