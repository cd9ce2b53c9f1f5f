"""Components of random and of awkward graphs."""

import random

import pytest

from assayer.llm.common import components


def slow(edges):
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        parent[q] = p
    return {x: find(x) for x in parent if find(x) != x}


GRAPHS = {
    "none": [], "loop": [(3, 3)], "line": [(i, i + 1) for i in range(60)],
    "zigzag": [(i, 61 - i) for i in range(30)] + [(61 - i, i + 1) for i in range(29)],
    "star": [(99, i) for i in range(50)] + [(0, 120)], "twice": [(1, 2), (2, 1), (1, 2), (-5, 2)],
}


@pytest.mark.parametrize("name", [*GRAPHS, "random"])
def test_components(spark, name):
    dice = random.Random(1)
    edges = GRAPHS.get(name, [(dice.randrange(300), dice.randrange(300)) for _ in range(200)])
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({r["a"] for r in got})
    assert {r["a"]: r["b"] for r in got} == slow(edges)
