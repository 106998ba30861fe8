"""Recall of embedding near-duplicates by brute force, where vectors share a mean, form tight families, or are huge or tiny."""

import math

import numpy as np
import pytest

from quern.llm import hamming


def exact(x, labels, least=0.93):
    u = x / np.abs(x).max(axis=1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    close = (u @ u.T >= least) & (labels[:, None] == labels[None])
    np.fill_diagonal(close, False)
    return close


def found(spark, x, labels, kind="double", **options):
    rows = [(k, v.tolist(), int(c)) for k, (v, c) in enumerate(zip(x, labels, strict=True))]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(4)
    got = hamming.near_duplicate_vectors(df, **options).orderBy("vec_id").collect()
    return np.array([r.n_links for r in got]), np.array([r.component_id for r in got])


def components(close):
    name = np.arange(len(close))
    while True:
        least = np.minimum(name, np.where(close, name[None], len(name)).min(axis=1))
        if (least == name).all():
            return name
        name = least


@pytest.mark.parametrize("mean", [0, 1, 2, 3, 10])
def test_common_mean(spark, mean):
    """Planted pairs at 0.931 to 0.95 among vectors that share a mean so many times as long as the rest."""
    rng = np.random.default_rng(mean)
    common = rng.normal(size=64)
    common /= np.linalg.norm(common)
    rest = rng.normal(size=(1000, 64))
    x = rest / np.linalg.norm(rest, axis=1, keepdims=True) + mean * common
    a = x[:500] / np.linalg.norm(x[:500], axis=1, keepdims=True)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.931, 0.95, size=(500, 1))
    x = np.concatenate([x, cosine * a + np.sqrt(1 - cosine**2) * side])
    labels = np.zeros(len(x), int)
    close = exact(x, labels)
    links, _ = found(spark, x, labels, block_rows=400)
    assert (links <= close.sum(axis=1)).all()
    assert links.sum() >= 0.99 * close.sum()


def test_tight_family(spark):
    """A family of 2,000 among others: every link is counted, over blocks smaller than it."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=64)
    family = centre + 0.055 * rng.normal(size=(2000, 64))
    others = rng.normal(size=(600, 64))
    x, labels = np.concatenate([family, others]), np.array([1] * 2000 + [1, 2] * 300)
    close = exact(x, labels)
    links, component = found(spark, x, labels, "float", block_rows=300)
    close_single = exact(x.astype(np.float32).astype(float), labels)
    assert (links == close_single.sum(axis=1)).all() and links[:2000].min() == 1999
    assert (component == components(close)).all()


def test_huge_and_tiny_numbers(spark):
    x = np.array([[1e200, 0.0], [1e-200, 1e-202], [1.0, 0.01], [-1e300, 1e300], [5e-324, 0.0], [1e308, 1e308]])
    links, component = found(spark, x, np.ones(6, int))
    assert links.tolist() == [3, 3, 3, 0, 3, 0] and component.tolist() == [0, 0, 0, 3, 0, 5]


def test_index_prunes_where_it_can():
    """Without a common direction few pairs are compared; where all are near, none of the tables is believed."""
    rng = np.random.default_rng(6)
    spread = hamming.units(rng.normal(size=(3000, 64)))
    index = hamming.fit_index(spread, np.zeros(3000), 1_000_000, 0.93, 0.995, 7)
    assert index.bits >= 10
    a, b = hamming.pairs_at(spread, 0.935, 99)[0]
    met = (index.encode(a)[0] == index.encode(b)[0]).any(axis=1) & (hamming._distance(index.encode(a)[1], index.encode(b)[1]) <= index.near)
    assert met.mean() >= 0.99
    tight = hamming.units(rng.normal(size=64) + 0.02 * rng.normal(size=(3000, 64)))
    assert hamming.fit_index(tight, np.zeros(3000), 3000, 0.93, 0.995, 7).bits <= 2


def test_blocks_against_pairs():
    rng = np.random.default_rng(8)
    x = hamming.units(rng.normal(size=(40, 3)))
    weights, labels, side = rng.integers(1, 4, 40), rng.integers(0, 2, 40), (np.arange(40) >= 25).astype(int)
    some, n, u, v = hamming.compare_blocks(np.arange(40), weights, labels, x, side, 0.8)
    wanted = {k: sum(int(weights[j]) for j in range(40) if side[j] != side[k] and labels[j] == labels[k] and float(x[j] @ x[k]) >= 0.8) for k in range(40)}
    assert dict(zip(some.tolist(), n.tolist(), strict=True)) == {k: w for k, w in wanted.items() if w}
    assert math.isclose(sum(n), sum(wanted.values())) and len(u) == len(v)
