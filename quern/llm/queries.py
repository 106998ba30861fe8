"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scratch import Scratch
from .fill_middle import fill_in_middle, restored
from .fingerprints import edited_likeness
from .hamming import near_duplicate_vectors
from .html_layout import extract_text
from .kd_shards import kd_shards
from .langid import LanguageCodes, predict_languages
from .mixing import mixing_plan
from .packing import pack_documents
from .rollups import TokenRollup, token_changes
from .simhash import near_duplicates
from .substrings import remove_repeats
from .turns import damaged, repair_digests
from .warc import round_trip


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path())


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_plan(_read(spark, sf_dir, "documents")).drop("copies")


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = round_trip(_read(spark, sf_dir, "pages"), keep_payload=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(_read(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(_read(spark, sf_dir, "embeddings"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    # a null doc_id counts as an empty text: it is learned from
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    codes = LanguageCodes.fit(docs.where(~held_out))
    found = predict_languages(docs.withColumn("held_out", held_out), codes)
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four commits over all documents: load, recounts without repeated lines, that again, no exact copies."""
    docs = _read(spark, sf_dir, "documents")
    scratch = Scratch(spark, "rollup")
    rollup = TokenRollup(spark, scratch.path("state"))
    versions = {"word_bpe_49k": tokenizer_path("word_bpe_49k.json"), "words": None}
    rollup.apply("load", token_changes(docs, "insert", versions))
    lines = F.split("text", "\n")
    fewer = docs.where(F.size(F.array_distinct(lines)) < F.size(lines)).withColumn("text", F.array_join(F.array_distinct(lines), "\n"))
    recounts = token_changes(fewer, "revise", versions)
    rollup.apply("without repeated lines", recounts)
    rollup.apply("without repeated lines", recounts)
    alike = F.sha2(F.coalesce("text", F.lit("")), 256).alias("alike")
    first = docs.groupBy(alike).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = scratch.save(first, "first")
    copies = docs.select("doc_id", alike).join(first, "alike").where("doc_id > first_id")
    nothing = F.lit(None).cast("string")
    gone = copies.select(F.lit("delete").alias("op"), "doc_id", nothing.alias("source"), nothing.alias("lang"), F.explode(F.array(*map(F.lit, versions))).alias("tokenizer"), F.lit(0).alias("n_tokens"))
    rollup.apply("without copies", gone)
    return rollup.totals()


def op7_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_read(spark, sf_dir, "pages")).select("page_id", F.length("rendered_text").alias("n_chars"), F.sha2("rendered_text", 256).alias("text_sha256"), "rendered_text")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_read(spark, sf_dir, "documents"), digest_only=True)


def op11_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(_read(spark, sf_dir, "documents"), shards=16)


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _read(spark, sf_dir, "conversations")
    return repair_digests(conversations, damaged(conversations))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(_read(spark, sf_dir, "documents"))
    sha = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_warc_round_trip": op2_warc_round_trip,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_language_id": op5_language_id,
    "op6_token_rollup": op6_token_rollup,
    "op7_html_layout": op7_html_layout,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_source_mixing": op10_source_mixing,
    "op11_kd_shards": op11_kd_shards,
    "op12_turn_repair": op12_turn_repair,
    "op13_fill_in_middle": op13_fill_in_middle,
}

#: DuckDB SQL for the queries that SQL can express: no tokenizer, fingerprint, classifier or page can be.
ORACLE_SQL: dict[str, str] = {
    "op2_warc_round_trip": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages), d AS (SELECT page_id, strlen(body) AS n, sha256(body) AS digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
        SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS problem FROM f""",
    "op4_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT * FROM v WHERE label IS NOT NULL AND list_dot_product(e, e) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
        r AS (SELECT vec_id, vec_id AS low FROM v UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.vec_id), n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1)
        SELECT vec_id, coalesce(max(n_links), 0) AS n_links, min(low) AS component_id, vec_id = min(low) AS kept FROM r LEFT JOIN n USING (vec_id) GROUP BY vec_id""",
    "op9_substring_dedup": """
        WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        s AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS pos FROM t WHERE len(words) >= 20), w AS (SELECT doc_id, pos, sha256(array_to_string(words[pos:pos + 19], ' ')) AS print FROM s),
        g AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY print ORDER BY doc_id, pos) AS nth FROM w) WHERE nth > 1),
        e AS (SELECT doc_id, words[k] AS word, k FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS k FROM t)), c AS (SELECT DISTINCT doc_id, pos + j AS k FROM g, range(0, 20) r(j)),
        k AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.k) FILTER (c.k IS NULL) AS kept, count(c.k) AS n_removed FROM e LEFT JOIN c ON c.doc_id = e.doc_id AND c.k = e.k GROUP BY 1)
        SELECT t.doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN k USING (doc_id)""",
    "op10_source_mixing": """
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1), w AS (SELECT *, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
        o AS (SELECT *, row_number() OVER (ORDER BY 2 * source_size / weight::DOUBLE) AS k FROM w),
        l AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level FROM o),
        b AS (SELECT coalesce(min_by(level, k) FILTER (2 * source_size > level * weight), max_by(level, k)) AS level FROM l),
        t AS (SELECT source, source_size, least(2 * source_size, b.level * weight)::DOUBLE AS target FROM w, b),
        x AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS each, row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id) - 1 AS rank,
            CAST('0x' || substr(md5('mix:' || coalesce(d.source, chr(0) || 'null')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, CAST(least(floor(each * (rank + 1) + start) - floor(each * rank + start), ceil(each)) AS BIGINT) * size AS taken FROM x""",
    "op13_fill_in_middle": """
        WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
        t AS (SELECT doc_id, text, regexp_extract_all(text, '(?s)[A-Za-z]+|[^A-Za-z]') AS tokens, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || s[k:k + 7] AS BIGINT)) AS h FROM h),
        c AS (SELECT doc_id, text, tokens, len(tokens) AS n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
            least(h[1] % (len(tokens) + 1), h[2] % (len(tokens) + 1)) AS a, greatest(h[1] % (len(tokens) + 1), h[2] % (len(tokens) + 1)) AS b FROM t),
        p AS (SELECT doc_id, text, n, form, coalesce(array_to_string(tokens[1:a], ''), '') AS prefix, coalesce(array_to_string(tokens[a + 1:b], ''), '') AS middle, coalesce(array_to_string(tokens[b + 1:], ''), '') AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
}
