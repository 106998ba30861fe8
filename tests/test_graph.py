"""Strong components by every way to them, against reachability by brute force."""

import random

import pytest

from quern.operators.graph import strong_components


def brute(edges):
    ways = {}
    for u, v in edges:
        ways.setdefault(u, set()).add(v)
        ways.setdefault(v, set())
    reach = {}
    for u in ways:
        seen, todo = {u}, [u]
        while todo:
            for v in ways[todo.pop()] - seen:
                seen.add(v)
                todo.append(v)
        reach[u] = seen
    members = {u: {v for v in reach[u] if u in reach[v]} for u in ways}
    return {u: (min(m), len(m)) for u, m in members.items()}


def ring(nodes):
    return list(zip(nodes, [*nodes[1:], nodes[0]], strict=True))


def graphs():
    rng = random.Random(7)
    yield "branched", [(k, (3 * k + 1) % 120) for k in range(120)] + [(k, k % 25) for k in range(0, 120, 2)]
    # a long path that comes back from its middle, rings that trees hang from and lead to, edges of a node to itself, a pair
    path = [(k, k + 1) for k in range(100, 160)] + [(130, 100), (131, 131)]
    yield "paths", path + ring([7, 3, 9]) + [(9, 20), (20, 21), (21, 22), (30, 31), (31, 7), (40, 41), (41, 40), (22, 22), (22, 100)]
    yield "trees", [(rng.randrange(k), k) for k in range(1, 90)] + [(rng.randrange(90), rng.choice([0, 5, 11])) for _ in range(6)] + [(200, 0), (0, 201)]
    yield "dense", [(u, v) for part in range(4) for u, v in [(rng.randrange(part * 30, part * 30 + 30), rng.randrange(part * 30, min(120, part * 30 + 34))) for _ in range(90)]]
    yield "sparse", [(rng.randrange(150), rng.randrange(150)) for _ in range(180)]


@pytest.mark.parametrize("at_once", [0, 10_000])
@pytest.mark.parametrize("name, edges", graphs(), ids=[n for n, _ in graphs()])
def test_components(spark, name, edges, at_once):
    got = strong_components(spark.createDataFrame(edges, "src long, dst long").repartition(3), at_once).collect()
    assert len(got) == len({x for e in edges for x in e})
    assert {r.node: (r.component, r.size) for r in got} == brute(edges)
