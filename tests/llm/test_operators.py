"""The ten operators against brute force on small fixtures, with nulls, empty and odd texts, ties and repeats."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import fingerprints, hamming, html_layout, langid, mixing, packing, simhash, substrings, warc
from quern.llm._components import connected_components
from quern.llm._scratch import Scratch
from quern.llm.queries import tokenizer_path
from quern.llm.rollups import TokenRollup, token_changes
from quern.llm.tokens import WordCachedTokenizer

RNG = random.Random(1)
VOCABULARY = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randrange(2, 8))) for _ in range(300)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def corpus():
    rng = random.Random(2)
    shared = prose(60, rng)
    texts = [prose(rng.randrange(1, 200), rng) for _ in range(40)]
    texts += [texts[3], texts[3], texts[5] + " tail", "x " + texts[7], f"{prose(9, rng)} {shared} {prose(9, rng)}", f"{shared} {prose(30, rng)}", f"{prose(25, rng)} {shared}", None, "", " \n ", "a " * 90]
    return [(k, t, ("en", "de", None)[k % 3], ("s1", "s2", "s3", None)[k % 4], len(t or "")) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_tokens_equal_the_library():
    own = WordCachedTokenizer(tokenizer_path(), words=50, pieces=50)
    for text in ["", None, "Été <|endoftext|> b", "a\x1cb c", "ΣΑΣ ﬁ²3 it's 'll", "中文 don't!!! 12", "o" * 300 + " z", *[prose(80) for _ in range(5)]]:
        wanted = own._tokenizer.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == wanted


def test_packing(docs, rows):
    got = packing.pack_documents(docs, tokenizer_path(), max_tokens=64, keep_ids=True).collect()
    tokenizer = WordCachedTokenizer(tokenizer_path())
    by_doc: dict = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc_id, text, *_ in rows:
        ids = tokenizer.encode(text) + (1).to_bytes(4, "little")
        pieces = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert b"".join(bytes(p.ids) for p in pieces) == ids
        assert all(p.length == 64 for p in pieces[:-1]) and [p.start for p in pieces] == [64 * k for k in range(len(pieces))]
        assert all(zlib.crc32(bytes(p.ids)) == p.ids_crc32 for p in pieces)
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= 1.1 * sum(r.length for r in got) / 64 + 2


def test_plan_equals_best_fit_one_by_one():
    rng = random.Random(4)
    for _ in range(30):
        counts = Counter(rng.randrange(1, 33) for _ in range(rng.randrange(1, 120)))
        rooms: list[int] = []
        for length in sorted(counts.elements(), reverse=True):
            fitting = [r for r in rooms if r >= length]
            if fitting:
                rooms.remove(min(fitting))
                rooms.append(min(fitting) - length)
            else:
                rooms.append(32 - length)
        runs = packing.plan_best_fit(dict(counts), 32)
        used = set()
        for k, (length, rank, first, each, _) in enumerate(runs):
            end = next((r[1] for r in runs[k + 1 :] if r[0] == length), counts[length])
            used |= {first + n // each for n in range(end - rank)}
        assert len(used) == len(rooms)


def test_mixing(docs, rows, empty):
    got = mixing.mixing_plan(docs).collect()
    sizes: Counter = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    targets = mixing.share_out(dict(sizes))
    assert abs(sum(targets.values()) - 1.5 * sum(sizes.values())) < 1e-6
    assert all(targets[s] <= 2 * sizes[s] + 1e-9 for s in sizes)
    largest = max(r.size for r in got)
    of = {r[0]: r[3] for r in rows}
    taken: Counter = Counter()
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        taken[of[r.doc_id]] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 1.5 * largest for s in sizes)
    assert sorted(got) == sorted(mixing.mixing_plan(docs.repartition(5)).collect())
    assert mixing.mix_documents(docs).count() == sum(r.copies for r in got)
    assert mixing.mixing_plan(empty).count() == 0


def test_warc_round_trip(spark):
    big = "é" * 20_000
    pages = [(1, "u", "<p>a</p>"), (2, None, big), (3, "u\r\nx", big), (4, "v", None), (5, "v", ""), (None, "w", "hot " * 60), (6, "w", "short"), (7, "w", "short"), (9, "a", "WARC/1.1\r\n\r\n" * 30), (8, "a", "WARC/1.1\r\n\r\n" * 30)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = warc.round_trip(df, segment_bytes=700, chunk_bytes=333, records_per_file=7).collect()
    assert len(got) == len(pages) and all(r.problem is None for r in got)
    first: dict = {}
    for page_id, _, html in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)):
        body = (html or "").encode()
        if len(body) >= 100 and page_id is not None:
            first.setdefault(body, page_id)
    for page_id, _, html in pages:
        body = (html or "").encode()
        r = next(x for x in got if x.page_id == page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        other = first.get(body) if page_id is not None else None
        revisit = other is not None and other != page_id
        assert (r.record_type, r.refers_to) == (("revisit", other) if revisit else ("response", None))


def test_warc_faults(spark):
    parts = [("a", "response", "a", 1, None, None, None, None, b"xx"), ("b", "continuation", "a", 3, 4, None, None, None, b"yy"), ("c", "response", "c", 1, None, None, None, None, b"zz")]
    got = {r.origin_id: r.problem for r in warc.reassembled(spark.createDataFrame(parts, warc._RECORD_SCHEMA)).collect()}
    assert got == {"a": "segments missing or doubled", "c": "no last segment"}
    assert warc.unchunked(warc.chunked(b"q" * 1000, 7)) == b"q" * 1000
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc")


def jaccard(a, b):
    count = lambda t: Counter(w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w)
    x, y = count(a), count(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


@pytest.mark.parametrize(("a", "b"), [({1: 10, 2: 1}, {1: 1, 2: 10}), ({1: 1, 2: 1, 3: 1}, {2: 1, 3: 1, 4: 1}), ({1: 100, 2: 3, 3: 1}, {1: 90, 3: 7}), ({1: 5}, {1: 6})])
def test_samples_collide_at_the_likeness(spark, a, b):
    """Over 60,000 slots the share of equal samples is the generalised Jaccard similarity, skewed weights included."""
    slots = spark.range(60_000).withColumnRenamed("id", "slot")
    least = lambda terms: F.least(*[fingerprints.sample(F.lit(t * 1_000_003), F.lit(float(w)), F.col("slot")) for t, w in terms.items()], *([F.lit((1 << 63) - 1)] if len(terms) == 1 else []))
    share = slots.agg(F.avg((least(a) == least(b)).cast("double"))).first()[0]
    exact = sum(min(a.get(t, 0), b.get(t, 0)) for t in a | b) / sum(max(a.get(t, 0), b.get(t, 0)) for t in a | b)
    assert abs(share - exact) < 0.01


def test_fingerprints_of_hot_and_null_ids(spark, rows):
    """Ids that hold many rows are spread over buckets; every row's next is the one after it in the stated order."""
    many = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, f"{text or ''} {k}") for k, (_, text, *_) in enumerate(rows * 4)]
    df = spark.createDataFrame(many, "doc_id long, text string").withColumn("bucket", F.lit("clash")).withColumn("row", F.lit(1)).repartition(3)
    got = fingerprints.edited_likeness(df).collect()
    assert len(got) == len(many) and sum(r.doc_id is None for r in got) == sum(k is None for k, _ in many)
    tie = {r.text: r.tie for r in spark.createDataFrame([(t,) for _, t in many], "text string").select("text", F.shiftrightunsigned(F.xxhash64("text"), 1).alias("tie")).collect()}
    order = sorted(many, key=lambda m: (m[0] is not None, m[0] or 0, tie[m[1]]), reverse=True)
    edited = Counter()
    for (key, text), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        half = len(text) // 2
        edited[key, hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()] += 1
    assert edited == Counter((r.doc_id, r.edited_sha256) for r in got)
    alone = fingerprints.fingerprint_documents(df)
    assert sorted([(r.doc_id or -1, r.fingerprint) for r in alone.collect()]) == sorted([(r.doc_id or -1, r.fingerprint) for r in got])


def test_fingerprints(docs, rows):
    got = {r.doc_id: r for r in fingerprints.edited_likeness(docs).collect()}
    down = sorted(rows, key=lambda r: -r[0])
    errors = []
    for k, (doc_id, text, *_) in enumerate(down):
        text, follow = text or "", down[(k + 1) % len(down)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + follow[:half]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        if text.split() and edited.split():
            errors.append(r.near_edited - jaccard(text, edited))
        assert 0 <= r.near_next <= 1
    # all documents draw on one vocabulary, so their errors go together: the mean varies like one document's
    assert abs(np.mean(errors)) < 0.1 and np.std(errors) < 0.12
    alike: dict = {}
    for doc_id, text, *_ in rows:
        alike.setdefault(text or "", set()).add(got[doc_id].fingerprint)
    assert all(len(x) == 1 for x in alike.values())


def test_terms_are_counted_in_place(spark):
    """Words aren't made rows, only terms are; signatures are those of the counts, told longs and texts without terms included."""
    texts = ["b a  a\tc a ", "", " \n", "a", "x y x y z", None]
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "part int, nth long, text string")
    signed = fingerprints.weighted_signatures(df, "part", "nth", ["text"], {"told": F.when(F.col("nth") != 3, F.col("nth") - 9)})
    plan = signed._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(split(" not in plan and "count(1)" not in plan
    got = {r.nth: (r.sig_text, r.told) for r in signed.collect()}
    counts = [(k, w, float(c)) for k, text in enumerate(texts) for w, c in Counter((text or "").split()).items()]
    least = [F.min(fingerprints.sample(F.xxhash64("word"), F.col("weight"), s)).bitwiseAND(F.lit(0xFFFF)).cast("int") for s in range(fingerprints.SAMPLES)]
    wanted = {k: codes for k, *codes in spark.createDataFrame(counts, "nth long, word string, weight double").groupBy("nth").agg(*least).collect()}
    assert got == {k: (wanted.get(k), None if k == 3 else k - 9) for k in range(len(texts))}


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 16))
    x = [*base, *(base[:20] + 0.05 * rng.normal(size=(20, 16))), *(base[0] + 0.02 * rng.normal(size=(40, 16)))]
    rows = [(k, [float(v) for v in row], k % 2 if k % 11 else None) for k, row in enumerate(x)]
    rows += [(200, rows[0][1], rows[0][2]), (201, rows[2][1], 0), (202, None, 1), (203, [0.0] * 16, 1), (204, [float("nan")] * 16, 1), (205, [], 1), (206, [1.0, None], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in hamming.near_duplicate_vectors(df, block_rows=8).collect()}
    good = {k: np.array(v) / np.linalg.norm(v) for k, v, lab in rows if v and lab is not None and all(y is not None and np.isfinite(y) for y in v) and any(v)}
    label = {k: lab for k, _, lab in rows}
    links = {k: {j for j in good if j != k and label[j] == label[k] and len(good[j]) == len(good[k]) and good[j] @ good[k] >= 0.93} for k in good}
    found, wanted = sum(got[k].n_links for k in good), sum(map(len, links.values()))
    assert 0.9 * wanted <= found <= wanted
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert got[200].component_id == got[0].component_id if label[0] is not None else True
    assert all(got[k].n_links == 0 and got[k].component_id == k for k in (202, 203, 204, 205))


def test_language_codes(spark):
    rng = random.Random(6)
    parts = {"aa": ["tion", "ing", "th", "er"], "bb": ["eux", "que", "le", "ai"], "cc": ["sch", "ung", "ein", "pf"]}
    rows = [(k, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(40)), lang) for k in range(150) for lang in [list(parts)[k % 3]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    codes = langid.LanguageCodes.fit(df.where("doc_id % 2 = 0"))
    got = {r.doc_id: r for r in langid.predict_languages(df.unionByName(spark.createDataFrame([(900, None, None), (901, "12 34", "aa"), (902, "", None)], df.schema)), codes).collect()}
    right = [got[k].lang_pred == lang for k, _, lang in rows if k % 2]
    assert np.mean(right) > 0.95 and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[k].lang_pred == "und" and got[k].ambiguous for k in (900, 901, 902))
    for n in (2, 3, 6, 9):
        code = langid.codewords(n)
        assert min((code[a] != code[b]).sum() for a in range(n) for b in range(a)) >= max(1, min(2 ** (n - 2), 5))


def test_language_nothing_to_learn(spark, empty):
    codes = langid.LanguageCodes.fit(empty)
    got = langid.predict_languages(spark.createDataFrame([(1, "abc", "en", "s", 3)], SCHEMA), codes).first()
    assert got.lang_pred == "und"


def test_rollup(spark, tmp_path):
    roll = TokenRollup(spark, f"file://{tmp_path}/roll")
    schema = "op string, doc_id long, source string, lang string, tokenizer string, n_tokens long"
    apply = lambda name, rows: roll.apply(name, spark.createDataFrame(rows, schema))
    assert apply("one", [("insert", 1, "a", "en", "t", 5), ("insert", 2, "a", "en", "t", 7), ("insert", None, "b", None, "t", 3), ("insert", 2, "a", "en", "t", 6)])
    assert not apply("one", [("insert", 9, "a", "en", "t", 100)])
    totals = lambda: {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in roll.totals().collect()}
    assert totals() == {("a", "en"): (2, 12), ("b", None): (1, 3)}
    assert apply("two", [("revise", 1, "c", "en", "t", 50), ("delete", 2, None, None, "t", None), ("delete", 77, None, None, "t", None)])
    assert totals() == {("c", "en"): (1, 50), ("b", None): (1, 3)}
    docs = spark.createDataFrame([(5, "x y", "en", "c", 3), (6, None, "en", "c", 0)], SCHEMA)
    roll.apply("three", token_changes(docs, "insert", {"t": None}))
    assert totals()["c", "en"] == (3, 52)
    assert roll.batches() == {"one", "two", "three"}


def test_html():
    page = "<html><head><title>x</title></head><body><h1>Head  line</h1><p>One <b>two</b>\nthree<p>Four<br>five<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul><table><tr><th>Name<th>Count<tr><td>apple<td>12</table>after<div style='display: none'>no</div><p hidden>no</p><script>if(a<b)</script><pre>\n a\n  b</pre>&amp;"
    assert html_layout.render(page) == "Head line\n\nOne two three\n\nFour\nfive\n\n- a\n- b\n  3. x\n  4. y\n- c\n\nName   Count\napple  12\n\nafter\n\n a\n  b\n\n&"
    assert html_layout.render(None) == html_layout.render("") == ""
    assert html_layout.render("<table>" * 300 + "x") == "x" and html_layout.render("<div>" * 4000 + "deep") == "deep"
    assert html_layout.render("a < b <") == "a < b <"


def linked(values, distance):
    parent = list(range(len(values)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(values)):
        for b in range(a):
            if bin(values[a] ^ values[b]).count("1") <= distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(values))]


def plain_simhash(text, k=4):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, rows, empty):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = [plain_simhash(r[1]) for r in rows]
    roots = linked(prints, 4)
    for k, r in enumerate(rows):
        assert got[r[0]].fingerprint == f"{prints[k]:016x}" and got[r[0]].component_id == rows[roots[k]][0]
    assert simhash.near_duplicates(empty).count() == 0


def test_dense_families_link_without_pairs(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(3)]
    values = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (2**64 - 1) for b in base for _ in range(25)})
    scratch = Scratch(spark, "test")
    prints = scratch.save(spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long"), "prints")
    edges = simhash.close_links(prints, scratch, 4, bucket_limit=4)
    got: dict = {}
    for r in connected_components(edges, scratch).collect():
        got.setdefault(r.root, set()).add(r.node)
    wanted: dict = {}
    for k, root in enumerate(linked(values, 4)):
        wanted.setdefault(root, set()).add(simhash._signed(values[k]))
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in wanted.values() if len(x) > 1)


def test_near_duplicates_removed(docs, rows):
    kept = {r.doc_id for r in simhash.remove_near_duplicates(docs).collect()}
    sets = {r[0]: set(simhash.shingle_hashes(r[1]).tolist()) for r in rows}
    alike = lambda a, b: not (sets[a] | sets[b]) or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    for doc_id in sets.keys() - kept:
        assert any(alike(doc_id, other) for other in kept)
    assert not {41, 40} & kept and 3 in kept


def test_substrings(docs, rows, empty):
    got = {r.doc_id: r for r in substrings.remove_repeats(docs).collect()}
    seen: set = set()
    for doc_id, text, *_ in rows:
        words = (text or "").encode().split()
        gone = np.zeros(len(words), bool)
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            gone[k : k + 20] |= window in seen
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        r = got[doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) == (len(words), gone.sum(), hashlib.sha256(kept).hexdigest(), kept.decode())
    assert substrings.remove_repeats(empty).count() == 0


def test_components_of_a_path(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, 7)]
    got: dict = {}
    for r in connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test")).collect():
        got.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == [list(range(61)), [100, 101]]


def test_packing_and_substrings_of_odd_rows(spark):
    odd = spark.createDataFrame([(None, "a b", None, None, 3), (None, None, None, None, 0), (4, "c", "en", "s", 1), (4, "c", "en", "s", 1)], SCHEMA).withColumn("rank", F.lit(1)).withColumn("size", F.lit("x"))
    assert packing.pack_documents(odd, tokenizer_path()).count() == 4
    assert substrings.remove_repeats(odd).count() == 4
    assert mixing.mix_documents(odd).columns == odd.columns
    assert simhash.near_duplicates(odd).count() == 4
    assert simhash.remove_near_duplicates(odd).columns == odd.columns
