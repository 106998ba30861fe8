"""K-d shards: every split is one along a single dimension at the weighted median, whatever is hot, null, tied or repeated."""

import random
import zlib

import pytest

from quern.llm import kd_shards as K

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Shard string, size string, `a.b` string, node string"


def table(spark, seed, n=400):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        text = rng.choice([None, "", "né 中文", "the same " * 30, "word " * rng.randrange(1, 200)])
        rows.append((rng.choice([None, 5, k]), text, rng.choice(["en", "de", None]), rng.choice(["hot", "hot", f"source{k % 40}", None]), rng.choice([None, 3, k]), "x", "x", "x", "x"))
    rows += [(None, "copies " * 50, "en", "hot", 1, "x", "x", "x", "x")] * (n // 2)
    return spark.createDataFrame(rows, SCHEMA).repartition(3), rows


def size(text):
    return len((text or "").encode()) + 1


@pytest.mark.parametrize("few,quantiles", [(4096, 40), (20, 5)])
def test_balance_and_rows(spark, few, quantiles, monkeypatch):
    """Sizes are within a few documents of equal, also where no task may sort more than a few candidates."""
    monkeypatch.setattr(K, "FEW", few)
    monkeypatch.setattr(K, "QUANTILES", quantiles)
    docs, rows = table(spark, 1)
    got = K.kd_shards(docs, shards=5, dimensions=("source", "lang", "n_chars")).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted([(r.doc_id, r.size, r.text_crc32) for r in got], key=key) == sorted([(r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows], key=key)
    held = {}
    for r in got:
        held.setdefault(r.shard, []).append(r)
        assert r.law == "bytes" and r.grown_shard is None
    assert set(held) == set(range(5))
    mean = sum(r.size for r in got) / 5
    for own in held.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - mean) <= 3 * max(r.size for r in got)


def test_same_cuts_however_they_are_found(spark, monkeypatch):
    docs, _ = table(spark, 2, 200)
    written = docs.dropDuplicates()
    found = []
    for few, quantiles in ((4096, 40), (10, 5)):
        monkeypatch.setattr(K, "FEW", few)
        monkeypatch.setattr(K, "QUANTILES", quantiles)
        found.append(sorted((str(r.doc_id), r.size, r.text_crc32, r.shard) for r in K.kd_shards(written, shards=4, slack=0.0, dimensions=("source", "n_chars")).collect()))
    assert found[0] == found[1]


def test_each_split_is_along_one_dimension(spark):
    """Distinct values of two numbers: both halves of every node lie apart in one of them."""
    rng = random.Random(3)
    rows = [(k, "w" * rng.randrange(50), rng.random(), rng.random() * 1e6) for k in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x double, y double").repartition(2)
    shard = {r.doc_id: r.shard for r in K.kd_shards(docs, shards=8, dimensions=("x", "y")).collect()}

    def apart(first, leaves):
        if leaves == 1:
            return
        a = [r for r in rows if first <= shard[r[0]] < first + leaves // 2]
        b = [r for r in rows if first + leaves // 2 <= shard[r[0]] < first + leaves]
        assert any(max(r[k] for r in a) < min(r[k] for r in b) for k in (2, 3))
        assert abs(sum(size(r[1]) for r in a) - sum(size(r[1]) for r in b)) <= 2 * 51
        apart(first, leaves // 2)
        apart(first + leaves // 2, leaves // 2)

    apart(0, 8)


def test_small_groups_stay_whole(spark):
    rows = [(k, f"text number {k // 3} " * 20, "en") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    where = {}
    for r in K.kd_shards(docs, shards=4, dimensions=("lang",), slack=0.01).collect():
        where.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_odd_tables(spark):
    docs, _ = table(spark, 4, 40)
    assert K.kd_shards(docs.limit(0)).count() == 0
    one = K.kd_shards(docs.limit(1)).collect()
    assert len(one) == 1 and one[0].slot == 0
    assert {r.shard for r in K.kd_shards(docs, shards=1).collect()} == {0}
    assert {r.shard for r in K.kd_shards(docs, shards=2, dimensions=()).collect()} == {0, 1}
    total = sum(r.size for r in K.kd_shards(docs, shards=1).collect())
    assert max(r.shard for r in K.kd_shards(docs, shards=None, target_bytes=total // 3 + 1).collect()) == 2
    alike = spark.createDataFrame([(None, "same", "en", "s")] * 64, "doc_id long, text string, lang string, source string")
    assert sorted(r.shard for r in K.kd_shards(alike, shards=16, dimensions=("source", "lang")).collect()) == sorted(list(range(16)) * 4)
    with pytest.raises(ValueError):
        K.kd_shards(docs, shards=1 << 20)
