import numpy as np

from gridloom.llm.hnsw import Graph, nearest


def brute(ids, x, k):
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return {int(ids[i]): [int(ids[j]) for j in np.lexsort((ids, d[i]))[:k]] for i in range(len(ids))}


def test_graph_is_well_formed_and_finds():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    g = Graph(x, np.arange(1500))
    for layer, links in enumerate(g.links):
        assert links.dtype == np.int32
        assert links.max() < len(links)
        assert (links != np.arange(len(links))[:, None]).all(), layer
    found, dist = g.search(x[:300], 10)
    top = np.argsort(((x[:300, None] - x[None]) ** 2).sum(2), 1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found, top, strict=True)]) >= 0.95
    assert (np.diff(dist, axis=1) >= 0).all()


def test_recall_over_shards(spark, data):
    v = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = v.orderBy("vec_id").collect()
    want = brute(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows]), 10)
    got: dict[int, list] = {}
    for r in nearest(v, shard_rows=150, query_block=40, every=3).collect():
        got.setdefault(r.vec_id, []).append(r.neighbour)
    assert set(got) == {i for i in want if i % 3 == 0}
    assert all(len(x) == 10 for x in got.values())
    assert np.mean([len(set(got[i]) & set(want[i])) / 10 for i in got]) >= 0.97


def test_awkward(spark):
    nan = float("nan")
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [5.0, 5.0]), (None, [1.0, 1.0]), (4, None), (5, []), (6, [1.0]), (7, [nan, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "vec_id long, embedding array<float>, shard string, id int")
    got = sorted((r.vec_id, r["rank"], r.neighbour) for r in nearest(df, k=2, every=1).collect())
    assert got == [(1, 1, 2), (1, 2, 9), (2, 1, 9), (2, 2, 1), (3, 1, 2), (3, 2, 9), (9, 1, 2), (9, 2, 1)]
    assert {r.vec_id for r in nearest(df, k=2, every=3).collect()} == {3, 9}
    assert nearest(df.limit(0)).count() == 0
    assert nearest(df.where("vec_id = 1")).count() == 0
