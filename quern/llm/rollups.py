"""Token counts as delta-maintained rollups.

A ledger holds the count of each document under each tokenizer version; totals by source, language
and tokenizer version are kept beside it. A batch of inserts, deletes and revised counts becomes
signed changes against the ledger (minus what a document counted, plus what it counts now), and
only these are added to the totals. A batch has an identifier and is committed by one row, the
last thing written: a batch applied again is a no-op, and one that was cut off is simply redone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scratch import shuffle_partitions

_LEDGER = "bucket int, doc_id long, tokenizer string, source string, lang string, n_tokens long, kept boolean, turn long"
_TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
_COMMIT = "batch string, turn long"


class TokenRollup:
    """State in a folder: for each turn its entries of the ledger, the totals after it, and its commit.

    The commit, a row with the batch's identifier, is written last, and a turn without one never
    happened. Entries lie in buckets of document ids, so a batch reads only buckets that hold its
    documents; every compact_every turns all that is in force is written anew as a base, and
    entries before it are not read again. One writer at a time. buckets bounds the parallelism and
    must stay as it was when the state was begun.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, compact_every: int = 16):
        self.spark, self.folder, self.buckets, self.compact_every = spark, folder.rstrip("/"), buckets, compact_every

    def _whole(self, kind: str) -> list[int]:
        """Turns of which a table of that kind was written whole (Spark's _SUCCESS marker)."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = [s.getPath() for s in fs.listStatus(path)]
        marker = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(p.getName()) for p in found if fs.exists(marker(p, "_SUCCESS")))

    def _commits(self) -> DataFrame:
        turns = self._whole("commits")
        if not turns:
            return self.spark.createDataFrame([], _COMMIT)
        return self.spark.read.schema(_COMMIT).json([f"{self.folder}/commits/{t}" for t in turns])

    def _state(self) -> DataFrame:
        turns = self._whole("commits")
        if not turns:
            return self.spark.createDataFrame([], _TOTALS)
        return self.spark.read.schema(_TOTALS).parquet(f"{self.folder}/totals/{turns[-1]}")

    def batches(self) -> set[str]:
        return {r["batch"] for r in self._commits().collect()}

    def _entries(self) -> DataFrame:
        """The last base and the entries of all committed turns after it."""
        turns = self._whole("commits")
        bases = [t for t in self._whole("bases") if turns and t <= turns[-1]]
        last = bases[-1] if bases else -1
        paths = [f"{self.folder}/bases/{last}"] * bool(bases) + [f"{self.folder}/ledger/{t}" for t in turns if t > last]
        if not paths:
            return self.spark.createDataFrame([], _LEDGER)
        read = [self.spark.read.schema(_LEDGER).parquet(path) for path in paths]
        return reduce(DataFrame.unionByName, read)

    def _in_force(self, rows: DataFrame) -> DataFrame:
        of_null = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
        last = rows.groupBy("bucket", "doc_id", "tokenizer", of_null.alias("own")).agg(F.max(F.struct("turn", "kept", "n_tokens", "source", "lang")).alias("r"))
        return last.select("bucket", "doc_id", "tokenizer", "r.source", "r.lang", "r.n_tokens", "r.kept", "r.turn").where("kept")

    def ledger(self) -> DataFrame:
        """The count now in force of each (doc_id, tokenizer). Rows of null doc_id are all in force."""
        return self._in_force(self._entries())

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens of all that is in force."""
        return self._state().where("n_docs <> 0 or n_tokens <> 0")

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch of (op, doc_id, source, lang, tokenizer, n_tokens); False if it already was.

        op is insert, revise (both set the count; an insert of a known document revises it) or
        delete (needs doc_id and tokenizer only; of an unknown document it does nothing). Null counts
        are 0. If a batch names a document and tokenizer several times, a delete wins, else the
        largest (n_tokens, source, lang). A null doc_id can only be inserted, each row as a document.
        changes is evaluated once.
        """
        if batch in self.batches():
            return False
        turn = max(self._whole("commits"), default=-1) + 1
        own = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
        bucket = F.when(F.col("doc_id").isNull(), -1 - F.pmod(F.xxhash64("own"), F.lit(self.buckets))).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets))).cast("int")
        shaped = changes.select((F.col("op") == "delete").alias("gone"), F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "tokenizer", F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"))
        shaped = shaped.withColumn("own", own).withColumn("bucket", bucket).repartition(min(2 * self.buckets, shuffle_partitions(self.spark)), "bucket")
        named = shaped.groupBy("bucket", "doc_id", "tokenizer", "own").agg(F.max(F.struct("gone", "n_tokens", "source", "lang")).alias("r"))
        entries = named.where("doc_id is not null or not r.gone").select("bucket", "doc_id", "tokenizer", "r.source", "r.lang", "r.n_tokens", (~F.col("r.gone")).alias("kept"), F.lit(turn).cast("long").alias("turn"))
        entries.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/ledger/{turn}")
        entries = self.spark.read.schema(_LEDGER).parquet(f"{self.folder}/ledger/{turn}")

        touched = [r["bucket"] for r in entries.where("bucket >= 0").select("bucket").distinct().collect()]  # as many as there are buckets at most
        old = self._in_force(self._entries().where(F.col("bucket").isin(touched) if touched else F.lit(False))).select("bucket", "doc_id", "tokenizer", F.struct("source", "lang", "n_tokens").alias("old"))
        met = entries.join(old, ["bucket", "doc_id", "tokenizer"], "left")
        minus = F.when(F.col("old").isNotNull(), F.struct("old.source", "old.lang", (-F.col("old.n_tokens")).alias("n_tokens"), F.lit(-1).alias("n_docs")))
        plus = F.when(F.col("kept"), F.struct("source", "lang", "n_tokens", F.lit(1).alias("n_docs")))
        signed = met.select("tokenizer", F.explode(F.array_compact(F.array(minus, plus))).alias("c")).select("c.source", "c.lang", "tokenizer", F.col("c.n_docs").cast("long").alias("n_docs"), "c.n_tokens")
        both = self._state().unionByName(signed).groupBy("source", "lang", "tokenizer").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        both.write.mode("overwrite").parquet(f"{self.folder}/totals/{turn}")
        self.spark.createDataFrame([(batch, turn)], _COMMIT).coalesce(1).write.mode("overwrite").json(f"{self.folder}/commits/{turn}")
        if turn % self.compact_every == self.compact_every - 1:
            self.compact()
        return True

    def compact(self) -> None:
        """Write all that is in force as one base; a base that was cut off is not used."""
        turns = self._whole("commits")
        if turns:
            rows = self.ledger().repartition(min(2 * self.buckets, shuffle_partitions(self.spark)), "bucket")
            rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/bases/{turns[-1]}")


def token_changes(docs: DataFrame, op: str, tokenizers: dict[str, str | None], id_col="doc_id", text_col="text", source_col="source", lang_col="lang") -> DataFrame:
    """Changes for ``TokenRollup.apply``: a row per document and tokenizer version, counted over whole texts.

    tokenizers maps a version's name to a tokenizer file, or to None for words (runs other than
    ASCII white space). A null text counts 0.
    """
    import pyarrow as pa

    from .tokens import WordCachedTokenizer

    def count(batches):
        made = {name: path and WordCachedTokenizer(path) for name, path in tokenizers.items()}
        for batch in batches:
            names, counts = [], []
            for text in batch.column(3):
                text = text.as_py()
                names.append(list(made))
                counts.append([len(t.encode(text)) // 4 if t else len((text or "").encode().split()) for t in made.values()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(names, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "source", "lang", "names", "counts"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(count, "doc_id long, source string, lang string, names array<string>, counts array<long>")
    each = counted.select("doc_id", "source", "lang", F.explode(F.arrays_zip("names", "counts")).alias("c"))
    return each.select(F.lit(op).alias("op"), "doc_id", "source", "lang", F.col("c.names").alias("tokenizer"), F.col("c.counts").alias("n_tokens"))
