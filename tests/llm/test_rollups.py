"""Token rollups against a recount of all documents in force."""

import random
from collections import Counter

import pytest

from quern.llm.queries import op6_token_rollup, tokenizer_path
from quern.llm.rollups import TokenRollup, token_changes

SCHEMA = "op string, doc_id long, source string, lang string, tokenizer string, n_tokens long"


def counted(held):
    total = {}
    for source, lang, tokenizer, n in held:
        docs, tokens = total.get((source, lang, tokenizer), (0, 0))
        total[source, lang, tokenizer] = (docs + 1, tokens + n)
    return {k: v for k, v in total.items() if v != (0, 0)}


def found(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def test_random_batches(spark, tmp_path):
    """Inserts, revisions and deletes of few ids, null ids, ties and replays, over compactions."""
    rng = random.Random(5)
    rollup = TokenRollup(spark, f"file://{tmp_path}/state", buckets=3, compact_every=2)
    held, nameless = {}, []
    for turn in range(5):
        rows = []
        for _ in range(40):
            key = rng.choice([None, *range(12)])
            rows.append((rng.choice(["insert", "revise"]) if key is None else rng.choice(["insert", "revise", "delete"]), key, rng.choice(["a", "b", None]), rng.choice(["en", None]), rng.choice(["t", "u"]), rng.choice([None, 0, 1, 5, 9])))
        changes = spark.createDataFrame(rows, SCHEMA)
        assert rollup.apply(f"batch {turn}", changes) and not rollup.apply(f"batch {turn}", changes)
        best = {}
        none_last = lambda v: (v is not None, v or "")
        for op, key, source, lang, tokenizer, n in rows:
            if key is None:
                nameless.append((source, lang, tokenizer, n or 0))
                continue
            entry = (op == "delete", n or 0, none_last(source), none_last(lang))
            best[key, tokenizer] = max(best.get((key, tokenizer), entry), entry)
        for (key, tokenizer), (gone, n, source, lang) in best.items():
            held.pop((key, tokenizer), None)
            if not gone:
                held[key, tokenizer] = (source[1] if source[0] else None, lang[1] if lang[0] else None, tokenizer, n)
        assert found(rollup) == counted([*held.values(), *nameless])
        assert rollup.ledger().count() == len(held) + len(nameless)
    assert rollup.batches() == {f"batch {k}" for k in range(5)}
    assert rollup._whole("bases") == [1, 3]


def test_batch_that_was_cut_off(spark, tmp_path):
    """Entries and totals without a commit never happened; the batch is redone in their place."""
    rollup = TokenRollup(spark, f"file://{tmp_path}/state")
    rollup.apply("one", spark.createDataFrame([("insert", 1, "a", "en", "t", 5)], SCHEMA))
    rollup.apply("two", spark.createDataFrame([("insert", 2, "a", "en", "t", 50)], SCHEMA))
    (tmp_path / "state/commits/1").rename(tmp_path / "lost")
    assert found(rollup) == {("a", "en", "t"): (1, 5)} and rollup.ledger().count() == 1
    assert rollup.apply("two", spark.createDataFrame([("insert", 2, "a", "en", "t", 60)], SCHEMA))
    assert found(rollup) == {("a", "en", "t"): (2, 65)}


def test_empty_batch_and_table(spark, tmp_path):
    rollup = TokenRollup(spark, f"file://{tmp_path}/state")
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert rollup.apply("none", token_changes(none, "insert", {"t": None}))
    assert found(rollup) == {} and rollup.batches() == {"none"}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_recounts(spark, tmp_path, sf):
    """The query's totals are those of a count of what is left: no repeated lines, no exact copies."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).unionByName(spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "", "en", "s", 0), (-3, "one\none\ntwo", None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = found_of(op6_token_rollup(spark, str(tmp_path)).collect())
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer_path())
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    copies = Counter()
    held = []
    for r in sorted(rows, key=lambda r: r.doc_id):
        text = r.text or ""
        copies[text] += 1
        if copies[text] > 1:
            continue
        text = "\n".join(dict.fromkeys(text.split("\n")))
        held += [(r.source, r.lang, "word_bpe_49k", len(exact.encode(text, add_special_tokens=False).ids)), (r.source, r.lang, "words", len(text.encode().split()))]
    assert got == counted(held)


def found_of(rows):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rows}
