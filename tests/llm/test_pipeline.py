"""The pipeline on a small corpus: each stage against brute force on what the one before it kept, then run() as a whole."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from quern.llm.mixing import share_out
from quern.llm.queries import tokenizer_path
from quern.llm.tokens import WordCachedTokenizer
from tests.llm.test_near_duplicates import firsts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    letters = {"aa": "abcdefgh", "bb": "mnopqrst"}
    words = {k: ["".join(rng.choice(v) for _ in range(rng.randrange(3, 8))) for _ in range(400)] for k, v in letters.items()}
    prose = lambda lang, n: [rng.choice(words[lang]) for _ in range(n)]
    shared = prose("aa", 60)
    rows = []
    for k in range(90):
        lang = "aa" if k % 3 else "bb"
        text = prose(lang, rng.randrange(30, 150))
        if k % 10 == 4:
            text = text[:20] + shared + text[20:]
        rows.append((k, " ".join(text), lang, ("s1", "s2", "s3", None)[k % 4], 0))
    for k in range(90, 110):  # exact and near copies
        text = rows[k - 90][1].split()
        if k % 2:
            text[k % 25] = "changed"
        rows.append((k, " ".join(text), rows[k - 90][2], "s1", 0))
    rows += [(110, None, None, None, 0), (111, "", "aa", "s1", 0), (112, "12 34 !!", "bb", "s2", 0)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def plain(rows):
    return sorted(rows, key=lambda r: (r[0], r[1] or ""))


def without_repeats(rows):
    """Texts without words of 20-word windows that an earlier text has."""
    seen, out = set(), []
    for doc_id, text, *rest in sorted(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[k : k + 20]) for k in range(len(words) - 19)]
        gone = set()
        for k, w in enumerate(windows):
            if w in seen:
                gone |= set(range(k, k + 20))
            seen.add(w)
        kept = [w for k, w in enumerate(words) if k not in gone]
        if kept or not words:
            text = " ".join(kept) if gone else text
            out.append((doc_id, text, *rest[:2], len(text)))
    return out


def mixed(rows):
    """The exact systematic sample, one running sum a source."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += size(text)
    targets, out = share_out(dict(sizes)), Counter()
    for source in sizes:
        own = sorted((r for r in rows if r[3] == source), key=lambda r: (size(r[1]), r[0]))
        each = targets[source] / sizes[source] if sizes[source] else 0.0
        start = int(hashlib.md5(f"mix:{source if source is not None else chr(0) + 'null'}".encode()).hexdigest()[:8], 16) / 2.0**32
        for rank, r in enumerate(own):
            passed = math.floor(each * (rank + 1) + start) - math.floor(each * rank + start)
            out[r] += int(min(passed, math.ceil(each)))
    return [r for r, n in out.items() for _ in range(n)]


def test_stages_and_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = []
    for k, (_, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/out-{k}")
        docs = spark.read.parquet(f"{folder}/out-{k}")
        assert k == 4 or docs.columns == columns
        kept.append([tuple(r) for r in docs.collect()])
    given = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    language, single, cut, mix, packed = kept
    assert {r[0] for r in given} - {r[0] for r in language} == {110, 111, 112}
    wanted = {r[0]: r[2] for r in given}
    assert all(r[2] == wanted[r[0]] for r in language)
    assert sorted(r[0] for r in single) == sorted(firsts([(r[0], r[1]) for r in sorted(language)]))
    assert plain(cut) == plain(without_repeats(single))
    assert plain(mix) == plain(mixed(cut))
    tokenizer = WordCachedTokenizer(tokenizer_path())
    lengths = Counter()
    for r in packed:
        lengths[r[0]] += r[3]
    assert lengths == Counter({r[0]: 0 for r in mix}) + sum((Counter({r[0]: len(tokenizer.encode(r[1])) // 4 + 1}) for r in mix), Counter())
    places = {}
    for r in packed:
        places.setdefault(r[5], []).append((r[6], r[3]))
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    again = P.run(spark, folder).collect()
    assert Counter(r[0] for r in again) == Counter(r[0] for r in packed)


def test_columns_of_the_caller_survive(spark, folder):
    """Whatever they are called: names that stages use themselves, in another case, with dots."""
    names = ["score", "ambiguous", "LANG_PRED", "a.b", "rest", "kept_text", "_whole", "size", "n_removed", "tick`s", "rank"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = docs.withColumns({n: F.concat(F.lit(f"{n}:"), F.col("doc_id")) for n in names})
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        stage(spark, docs, folder).write.parquet(f"{folder}/named-{k}")
        docs, before = spark.read.parquet(f"{folder}/named-{k}"), docs
        assert docs.columns == before.columns
        rows = docs.collect()
        assert rows and all(r[n] == f"{n}:{r.doc_id}" for r in rows for n in names)
    assert P.STAGES[-1][1](spark, docs, folder).count() >= len(rows)
