"""All ten operators on odd tables: nulls anywhere, empty and very long texts, ties, repeated rows, clashing columns, no rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import fingerprints, hamming, html_layout, langid, mixing, packing, simhash, substrings, warc
from quern.llm._scratch import named
from quern.llm.queries import tokenizer_path
from quern.llm.rollups import token_changes

LONG = "lorem ipsum dolor sit amet " * 60_000
ROWS = [(1, "same words here", "en", "s"), (1, "same words here", "en", "s"), (1, "other words", "en", None), (None, "no id", None, "s"), (None, "no id", None, "s"), (None, None, None, None), (2, "", "de", "t"), (3, " \n\t", "de", "t"), (4, LONG, "en", "s"), (5, LONG + "end", "en", "t"), (6, "né über 中文 ﬁ", "de", "s")]
CLASHES = ["_id", "id", "key", "bucket", "row", "rank", "tie", "place", "digest", "words", "hash", "source_size", "LANG_PRED", "score", "ambiguous", "a.b", "tick`s", "kept_text", "rest", "class", "vector", "Text2", "_whole", "_first", "n_words", "a b"]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.lit(1).cast("long"))
    for name in CLASHES:
        docs = docs.withColumn(name, F.lit("x"))
    return docs.repartition(3)


@pytest.fixture(scope="module", params=["rows", "none"])
def given(request, odd):
    return (odd, len(ROWS)) if request.param == "rows" else (odd.limit(0), 0)


def test_packing(given):
    docs, n = given
    got = packing.pack_documents(docs, tokenizer_path()).collect()
    assert sum(r.piece == 0 for r in got) == n and all(r.length <= 4096 for r in got)


def test_fingerprints(given):
    docs, n = given
    got = fingerprints.edited_likeness(docs).collect()
    assert len(got) == n and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert sorted(r.n_chars for r in got) == sorted(len(t or "") for _, t, *_ in ROWS[:n])


def test_language(given):
    docs, n = given
    got = langid.predict_languages(docs, langid.LanguageCodes.fit(docs))
    assert got.columns.count("lang_pred") == 1 and got.count() == n
    assert got.where("text is null or trim(text) = ''").where("lang_pred <> 'und'").count() == 0


def test_token_changes(given):
    docs, n = given
    got = token_changes(docs, "insert", {"words": None, "bpe": tokenizer_path()}).collect()
    assert len(got) == 2 * n and (n == 0 or max(r.n_tokens for r in got if r.tokenizer == "words") == 300_001)


def test_simhash(given):
    docs, n = given
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == n
    assert n == 0 or {r.component_id for r in got if r.fingerprint == "0" * 16} == {2}


def test_near_duplicates_removed(given):
    docs, n = given
    got = simhash.remove_near_duplicates(docs)
    assert got.columns == docs.columns
    # one of the equal rows, one text without words, one long text
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in got.collect()) == sorted([(1, 15), (1, 11), (0, 5), (2, 0), (4, len(LONG)), (6, len(ROWS[-1][1]))] if n else [])


def test_substrings(given):
    docs, n = given
    got = substrings.remove_repeats(docs)
    assert got.count() == n
    assert n == 0 or got.where("doc_id = 5").first().n_removed == 300_000


def test_mixing(given):
    docs, n = given
    plan = mixing.mixing_plan(docs).collect()
    assert len(plan) == n and all(r.taken <= 2 * r.size for r in plan)
    assert mixing.mix_documents(docs).columns == docs.columns
    assert mixing.mix_documents(docs).where("score <> 'x'").count() == 0


def test_pages(given):
    docs, n = given
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"), F.col("lang").alias("url"), *[named(c) for c in CLASHES])
    got = warc.round_trip(pages, keep_payload=False).collect()
    assert len(got) == n and all(r.problem is None for r in got)
    assert html_layout.extract_text(pages).count() == n


def test_revisit_of_a_lost_record(spark):
    """A revisit whose record isn't there, or has another payload, is told."""
    schema = "page_id long, record_id string, record_type string, refers_to long, refers_id string, payload_bytes long, payload_digest string, problem string"
    rows = [(1, "<a>", "response", None, None, 5, "d", None), (2, "<b>", "revisit", 1, "<a>", 5, "d", None), (3, "<c>", "revisit", 9, "<z>", 5, "d", None), (4, "<d>", "revisit", 1, "<a>", 6, "d", None)]
    got = {r.page_id: r.problem for r in warc.resolved(spark.createDataFrame(rows, schema)).collect()}
    assert got[1] is None and got[2] is None and "no record" in got[3] and "another payload" in got[4]


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.01], 1), (2, None, 1), (3, [], 1), (4, [0.0, 0.0], 1), (5, [math.nan, 1.0], 1), (6, [1.0, None], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0, 0.0], 1), (9, [0.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit(1)).withColumn("class", F.lit("x")).withColumn("vector", F.lit(0))
    got = sorted((r.vec_id or 0, r.n_links, r.component_id) for r in hamming.near_duplicate_vectors(df).collect())
    assert got == sorted([(1, 2, 1), (1, 2, 1), (0, 2, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9)])
    assert hamming.near_duplicate_vectors(df.limit(0)).count() == 0


def test_margins_and_decoding_one_by_one():
    """Margins as a mean over n-grams taken one at a time, and decoding as the least weighted loss."""
    rng = np.random.default_rng(4)
    names = ["a", "b", "c", "d"]
    code = langid.codewords(4)
    weights = rng.normal(size=(langid._FEATURES, code.shape[1])).astype(np.float32)
    model = langid.LanguageCodes(names, code, weights, rng.uniform(0.5, 2, code.shape[1]), rng.uniform(0.1, 1, code.shape[1]))
    texts = ["Hello wide World", "x", "né 中文 12!", "ab " * 50]
    margins = langid.bit_margins(texts, weights)
    data = b"".join(b" " + t.encode().translate(langid._LETTERS_ONLY) + b"    " for t in texts)
    index = lambda at, n, k: int.from_bytes(data[at : at + n], "little") * langid._MULTIPLIERS[k] % (1 << 32) >> (32 - langid._TABLE_BITS)
    begin = 0
    for k, text in enumerate(texts):
        size = len(text.encode()) + 5
        grams = [at for at in range(begin, begin + size) if at + 4 <= len(data)]
        total = sum((weights[index(at, 3, 0)] + weights[index(at, 4, 1) + (1 << langid._TABLE_BITS)]).astype(float) for at in grams)
        assert np.allclose(margins[k], total / size, atol=1e-3)
        begin += size
    nearest, score, lead = model.decode(margins)
    for k in range(len(texts)):
        loss = [sum(model.trust[b] * math.log1p(math.exp(-word[b] * margins[k, b] * model.scale[b])) for b in range(code.shape[1])) / model.trust.sum() * code.shape[1] for word in code]
        order = np.argsort(loss)
        assert nearest[k] == order[0] and abs(lead[k] - (loss[order[1]] - loss[order[0]])) < 1e-6
        assert abs(score[k] - math.exp(-loss[order[0]]) / sum(math.exp(-x) for x in loss)) < 1e-6
