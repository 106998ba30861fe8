"""A corpus pipeline of five stages; each works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm._scratch import Scratch, named, unused
from quern.llm.langid import LanguageCodes, predict_languages
from quern.llm.mixing import mix_documents
from quern.llm.packing import pack_documents
from quern.llm.queries import tokenizer_path
from quern.llm.simhash import remove_near_duplicates
from quern.llm.substrings import remove_repeats

#: A text whose two nearest languages are closer than this in loss has no language to speak of.
UNDECIDED_BELOW = 0.02


#: Documents in a batch that a Python worker gets at once; Spark's own 10,000 would be some hundred MB of long texts.
BATCH_ROWS = 1000
_BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound what workers hold, unless the session asks for less already."""
    if int(spark.conf.get(_BATCHES)) > BATCH_ROWS:
        spark.conf.set(_BATCHES, BATCH_ROWS)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, which becomes their lang; texts without letters or decision go."""
    small_batches(spark)
    language, score, unsure = (unused(docs, name) for name in ("lang_pred", "score", "ambiguous"))
    found = predict_languages(docs, LanguageCodes.fit(docs), ambiguous_below=UNDECIDED_BELOW, names=(language, score, unsure))
    kept = found.where((F.col(language) != "und") & ~F.col(unsure))
    return kept.select(*[F.col(language).alias(c) if c == "lang" else named(c) for c in docs.columns])


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) one document."""
    small_batches(spark)
    return remove_near_duplicates(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 20 words or more that an earlier text has; texts left without words go."""
    small_batches(spark)
    columns = docs.columns
    cut = remove_repeats(docs).where("n_removed < n_words or n_words = 0")
    rest = {c: F.col("rest").getField(c) for c in columns}
    # a text that loses nothing stays as it was written
    rest["text"] = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(rest["text"])
    rest["n_chars"] = F.length(rest["text"]).cast("long")
    return cut.select(*[rest[c].alias(c) for c in columns])


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    small_batches(spark)
    return mix_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 4096 tokens."""
    small_batches(spark)
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("language ID", known_language),
    ("SimHash near-dedup", without_near_duplicates),
    ("substring dedup", without_repeated_passages),
    ("source mixing", mixed_sources),
    ("best-fit packing", packed_sequences),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
