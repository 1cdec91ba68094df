import random

import pytest

from corpusmill.llm.components import components


def brute(edges):
    least = {n: n for e in edges for n in e}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            m = min(least[a], least[b])
            moved |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return {n: m for n, m in least.items() if any(n in e and e[0] != e[1] for e in edges)}


@pytest.mark.parametrize("seed", [0, 1])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)] + [(500, 501 + i) for i in range(60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == brute(edges)


def test_nothing(spark):
    assert components(spark.createDataFrame([(None, 1), (2, 2)], "u long, v long")).count() == 0
