import numpy as np
import pytest

from gridloom.functions.graph import connected, union


def plain(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
    return {n: root(n) for n in list(up)}


@pytest.fixture(scope="module")
def edges():
    rng = np.random.default_rng(0)
    return [(int(a), int(b)) for a, b in rng.integers(0, 900, (500, 2))] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 5000), (None, 3), (6, 7), (7, 6)]


def test_union(edges):
    x, y = (np.array(c) for c in zip(*[e for e in edges if e[0] is not None], strict=True))
    nodes, least = union(x, y)
    assert dict(zip(nodes.tolist(), least.tolist(), strict=True)) == plain(edges)


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_connected_by_one_task_and_by_rounds(spark, edges, limit):
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    assert {r.node: r.component for r in connected(df, limit=limit).collect()} == plain(edges)


def test_empty(spark):
    df = spark.createDataFrame([], "a long, b long")
    assert connected(df).count() == connected(df, limit=-1).count() == 0
