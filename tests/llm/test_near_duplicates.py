"""remove_near_duplicates against brute-force groups of Jaccard similarity 0.8."""

import random

import pytest

from quern.llm import simhash

RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randrange(3, 9))) for _ in range(5000)]
SCHEMA = "doc_id long, text string"


def prose(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def firsts(rows):
    """Smallest id of each group that pairs of similarity 0.8 or more link."""
    sets = [set(simhash.shingle_hashes(text).tolist()) for _, text in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if not (both := sets[a] | sets[b]) or len(sets[a] & sets[b]) >= 0.8 * len(both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {rows[find(k)][0] for k in range(len(rows))}


def kept(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(r.doc_id for r in simhash.remove_near_duplicates(df, **options).collect())


def numbered(texts, shuffled_by=None):
    if shuffled_by:
        shuffled_by.shuffle(texts)
    return list(enumerate(" ".join(t) for t in texts))


def test_star_shaped_family(spark):
    """Copies that are each like one text and unlike one another, in a group over any bucket limit."""
    rng = random.Random(12)
    original = prose(rng, 300)
    texts = [original]
    for _ in range(200):
        copy = list(original)
        for at in rng.sample(range(5, 295), 6):
            copy[at] = "x" + rng.choice(WORDS)
        texts.append(copy)
    rows = numbered(texts, rng)
    wanted = firsts(rows)
    assert len(wanted) < 20
    assert kept(spark, rows) == sorted(wanted)


def test_added_and_changed_words(spark):
    """Pairs just over the similarity, whose SimHashes differ by more bits than any reach."""
    rng = random.Random(13)
    texts = []
    for _ in range(60):
        text = prose(rng, 104)
        texts += [text, text + prose(rng, 24)]
    rows = numbered(texts)
    assert len(wanted := firsts(rows)) == 60
    assert kept(spark, rows) == sorted(wanted)


def test_lines_repeated_more_often(spark):
    """How often a line is repeated changes a fingerprint of counts, not the set of shingles."""
    rng = random.Random(14)
    texts = []
    for _ in range(30):
        text, line = prose(rng, 100), prose(rng, 10)
        texts += [text + line, text + line * 31]
    rows = numbered(texts)
    assert len(wanted := firsts(rows)) == 30
    assert kept(spark, rows) == sorted(wanted)


def test_near_copies_behind_an_unlike_text_of_one_fingerprint(spark):
    """One passage makes up most of every text, so that fingerprints agree; the rests differ by pairs."""
    rng = random.Random(15)
    passage = prose(rng, 7)
    texts = [passage * 200 + prose(rng, 80)]
    for _ in range(20):
        rest = prose(rng, 80)
        texts += [passage * 200 + rest, passage * 200 + rest[:-1] + ["other"]]
    rows = numbered(texts)
    assert len({simhash.simhash(text, 2) for _, text in rows}) == 1
    assert len(wanted := firsts(rows)) == 21
    assert kept(spark, rows) == sorted(wanted)


@pytest.mark.parametrize("limit", [3])
def test_groups_equal_brute_force(spark, limit):
    """Families of any edit rate that share a common passage, copies, repeated lines, short, empty and null texts."""
    rng = random.Random(16)
    common = prose(rng, 40)
    texts = [[], [], ["one"], ["One"], prose(rng, 3), common, common + ["tail"]]
    for _ in range(6):
        base = prose(rng, rng.randrange(20, 160)) + common
        for _ in range(25):
            copy = list(base)
            for at in rng.sample(range(len(copy)), rng.randrange(0, 7)):
                copy[at] = rng.choice(WORDS)
            texts.append(copy + copy[:12] * rng.randrange(0, 3))
    rows = [*numbered(texts, rng), (1000, None), (1001, " \n")]
    assert kept(spark, rows, bucket_limit=limit) == sorted(firsts(rows))
