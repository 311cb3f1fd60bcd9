"""Work that must grow no faster than its tables: results against a plain version, in a time that the code before took many times over."""

import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridloom.operators import geometry as G
from gridloom.operators import spatial_join as J
from gridloom.operators import tiles as T
from gridloom.operators.geometry import RING, area, repair


def rings_frame(spark, rings):
    return spark.createDataFrame([(i, [None if v is None else {"x": float(v[0]), "y": float(v[1])} for v in r]) for i, r in enumerate(rings)], f"poly_id long, ring {RING}")


def test_repairing_many_rings(spark):
    """an expression that names the ring was put in each of its places, and worked out there for each vertex."""
    rings = []
    for i in range(20_000):
        w, h = i % 9, i % 7
        rings.append([(0, 0), (w, 0), (w, 0), (w, h), None, (0, h), (float("nan"), 1), (0, 0)])
    began = time.perf_counter()
    got = {r.poly_id: (len(r.ring), r.a) for r in repair(rings_frame(spark, rings)).withColumn("a", area(F.col("ring"))).collect()}
    assert time.perf_counter() - began < 60
    assert got == {i: (4, float(i % 9 * (i % 7))) for i in range(20_000) if i % 9 and i % 7}


def test_repairing_odd_rings(spark):
    nan = float("nan")
    odd = [[], [None], [(1, 1)], [(1, 1), (1, 1)], [(0, 0), (1, 0), (0, 0)], [(0, 0), (2, 0), (0, 2), (0, 0), (0, 0)], [(nan, 0), (0, 0), (1, 0), (1, 1)]]
    df = rings_frame(spark, odd).unionByName(spark.createDataFrame([(99, None)], f"poly_id long, ring {RING}"))
    got = {r.poly_id: [(p.x, p.y) for p in r.ring] for r in repair(df).collect()}
    # of several closing vertices the repeated ones go first, then the last that equals the first
    assert got == {5: [(0.0, 0.0), (2.0, 0.0), (0.0, 2.0)], 6: [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]}


def points_frame(spark, x, y, area):
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "x": x.astype(float), "y": y.astype(float), "area_ha": area}))


def _proximity(x, y, area, k, radius):
    d = np.sqrt((x - x[k]) ** 2 + (y - y[k]) ** 2)
    ok = (d > 0) & (d <= radius)
    return (area[ok] / d[ok] ** 2).sum(), ok.sum()


def test_proximity_of_crowded_points(spark):
    """10,000,000,000 pairs, each of them a row before."""
    rng = np.random.default_rng(1)
    n = 100_000
    x, y, area = rng.integers(-1500, 1500, n), rng.integers(0, 3000, n), rng.uniform(0, 10, n)
    began = time.perf_counter()
    got = {r.id: (r.proximity_index, r.neighbours) for r in J.proximity_index(points_frame(spark, x, y, area), 1000.0).collect()}
    assert time.perf_counter() - began < 100
    assert len(got) == n
    for k in rng.choice(n, 100, replace=False):
        total, count = _proximity(x, y, area, k, 1000.0)
        assert abs(got[k][0] - total) < 1e-10 and got[k][1] == count


def test_proximity_in_pairs_and_on_a_lattice(spark):
    rng = np.random.default_rng(2)
    for whole in (True, False):
        x, y, area = rng.uniform(-70, 130, 6000), rng.uniform(-10, 60, 6000), rng.uniform(0, 10, 6000)
        if whole:
            x, y = np.floor(x), np.floor(y)  # several points a place
        got = {r.id: (r.proximity_index, r.neighbours) for r in J.proximity_index(points_frame(spark, x, y, area), 40.5).collect()}
        for k in range(0, 6000, 61):
            total, count = _proximity(x, y, area, k, 40.5)
            assert abs(got[k][0] - total) < 1e-9 and got[k][1] == count
    lone = spark.createDataFrame([(1, 0.0, 0.0, 2.0), (2, 3.0, 4.0, None), (3, None, 1.0, 5.0), (4, 1e6, 0.0, 1.0)], "id int, x double, y double, area_ha double")
    assert {tuple(r) for r in J.proximity_index(lone, 10.0).collect()} == {(1, 0.0, 1), (2, 2.0 / 25, 1), (3, 0.0, 0), (4, 0.0, 0)}


def _convex(rng, n, size, centre):
    """Convex rings of small whole coordinates, many of which touch."""
    out = []
    for _ in range(n):
        a, b, c, d = rng.integers(1, size, 4)
        x, y = rng.integers(0, centre, 2)
        r = [(x + a, y), (x, y + b), (x - c, y), (x, y - d)]
        out.append(r if rng.random() < 0.5 else r[::-1])
    return out


def test_convex_rings_are_worked_on_as_others_are():
    """The ways that are only for convex rings give what the ways for all give."""
    rng = np.random.default_rng(5)
    p, q = np.array(_convex(rng, 4000, 6, 12), float), np.array(_convex(rng, 4000, 6, 12), float)
    p[T.signed(p) < 0] = p[T.signed(p) < 0][:, ::-1]
    q[T.signed(q) < 0] = q[T.signed(q) < 0][:, ::-1]
    p[::7, 3] = p[::7, 0]  # triangles, filled up
    met = T.meet(p, q, True)
    assert (met == T.meet(p, q)).all() and 0.3 < met.mean() < 0.95
    area = T.shared(p, q, True)
    assert np.abs(area - T.shared(p, q)).max() < 1e-9
    assert (area[~met] == 0).all() and ((area == 0) & met).any()
    turned = np.stack([p[..., 0] * 0.8 - p[..., 1] * 0.6, p[..., 0] * 0.6 + p[..., 1] * 0.8], -1), np.stack([q[..., 0] * 0.8 - q[..., 1] * 0.6, q[..., 0] * 0.6 + q[..., 1] * 0.8], -1)
    assert np.abs(T.shared(*turned, True) - area).max() < 1e-9


def test_polygon_pairs_in_tiles(spark, monkeypatch):
    """Rings of all shapes and sizes, some repeated, over many cells and tiles: each pair once, and as alone."""
    monkeypatch.setattr(T, "TILE", 16)
    rng = np.random.default_rng(6)
    star = lambda n, k: [[(float(x + r * np.cos(t)), float(y + r * np.sin(t))) for t, r in zip(np.sort(rng.random(k)) * 2 * np.pi, rng.uniform(1, 9, k), strict=True)] for x, y in rng.uniform(-30, 30, (n, 2))]
    a = star(60, 7) + _convex(rng, 60, 6, 30) + star(3, 90)
    b = star(40, 11) + _convex(rng, 40, 9, 30)
    b += b[:5]
    da, db = rings_frame(spark, a), rings_frame(spark, b)
    arrays = [[np.array(r, float) for r in s] for s in (a, b)]
    met = {(i, j) for i, p in enumerate(arrays[0]) for j, q in enumerate(arrays[1]) if G.rings_meet(p, q)}
    assert sorted(tuple(r) for r in G.intersecting(da, db, 8.0).collect()) == sorted(met)
    assert sorted(r[0] for r in G.touching(da, db, 8.0).collect()) == sorted({i for i, _ in met})
    got = {(r.a_id, r.b_id): r.intersection_area for r in G.intersection_areas(da, db, 8.0).collect()}
    want = {(i, j): G.shared_area(p, q) for i, p in enumerate(arrays[0]) for j, q in enumerate(arrays[1])}
    assert set(got) <= met and all(abs(got.get(k, 0.0) - v) < 1e-9 for k, v in want.items())


def test_crowded_polygons(spark):
    """2,000,000 pairs in a cell, each of them two rings in a row, and a loop over vertices, before."""
    square = lambda k, n: [(k, k), (k + n, k), (k + n, k + n), (k, k + n)]
    a, b = rings_frame(spark, [square(k % 40, 50) for k in range(2000)]), rings_frame(spark, [square(0, 60 + k % 30) for k in range(1000)])
    began = time.perf_counter()
    assert G.intersection_areas(a, b, 100.0).agg(F.count("*"), F.sum("intersection_area")).first()[0] == 2_000_000
    assert G.intersecting(a, b, 100.0).count() == 2_000_000
    assert G.touching(a, b, 100.0).count() == 2000
    assert time.perf_counter() - began < 60


def _boxes_frame(spark, b):
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(b)), "x0": b[:, 0], "y0": b[:, 1], "x1": b[:, 2], "y1": b[:, 3]}))


def test_points_in_polygons_in_tiles(spark, monkeypatch):
    """Rings of several sizes, repeated and open ones, points on lattice and off, missing coordinates: as ray casting of every pair."""
    monkeypatch.setattr(T, "TILE", 16)
    rng = np.random.default_rng(7)
    rings = [[(float(x + r * np.cos(t)), float(y + r * np.sin(t))) for t, r in zip(np.sort(rng.random(k)) * 2 * np.pi, rng.uniform(2, 15, k), strict=True)] for (x, y), k in zip(rng.uniform(-20, 20, (60, 2)), rng.integers(3, 12, 60), strict=True)]
    rings += rings[:7] + [[(0, 0), (8, 0), (8, 8), (0, 8), (0, 0)]]
    x, y = rng.uniform(-30, 30, 500), rng.uniform(-30, 30, 500)
    x[::3], y[::3] = np.floor(x[::3]), np.floor(y[::3])
    pts = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))] + [(900, None, 1.0), (901, float("nan"), 1.0)], "id long, x double, y double")
    want = {(i, k) for k, ring in enumerate(rings) for i in np.flatnonzero(G._inside(np.stack([x, y], 1), np.array(ring, float)))}
    poly = rings_frame(spark, rings).select(F.col("poly_id"), "ring")
    assert sorted(tuple(r) for r in J.points_in_polygons(pts, poly, 5.0).collect()) == sorted(want)
    least = {i: min(k for j, k in want if j == i) for i, _ in want}
    assert {r.id: r.poly_id for r in J.first_polygon(pts, poly, 5.0).collect()} == {i: least.get(i) for i in [*range(500), 900, 901]}
    assert sorted(r.id for r in pts.join(J.points_held(pts, poly, 5.0), "id", "left_anti").collect()) == sorted({*range(500), 900, 901} - set(least))


def test_crowded_points_and_polygons(spark):
    """100,000,000 candidates, each of them a ring in a row and a loop over its vertices, before."""
    rng = np.random.default_rng(8)
    n = 20_000
    pts = points_frame(spark, rng.uniform(0, 10, n), rng.uniform(0, 10, n), np.zeros(n))
    poly = rings_frame(spark, [[(0, 0), (10, 0), (5, 10 + k % 7)] for k in range(5000)])
    began = time.perf_counter()
    got = J.points_in_polygons(pts, poly, 50.0).groupBy("id").count().collect()
    first = J.first_polygon(pts, poly, 50.0).where("poly_id is not null").collect()
    assert time.perf_counter() - began < 60
    assert len(got) == len(first) and sum(r["count"] for r in got) > 50_000_000


def test_boxes_in_tiles(spark, monkeypatch):
    """Each pair once over many cells and tiles; edges that touch don't overlap; boxes on one another count each."""
    monkeypatch.setattr(T, "TILE", 16)
    rng = np.random.default_rng(9)
    make = lambda n, size: np.concatenate([c := rng.integers(-20, 20, (n, 2)), c + rng.integers(1, size, (n, 2))], 1).astype(float)
    a, b = make(150, 9), make(90, 30)
    a[100:], b[80:] = a[:50], b[:10]
    want = {(i, k): w * h for i, p in enumerate(a) for k, q in enumerate(b) if (w := min(p[2], q[2]) - max(p[0], q[0])) > 0 and (h := min(p[3], q[3]) - max(p[1], q[1])) > 0}
    da, db = _boxes_frame(spark, a), _boxes_frame(spark, b)
    assert sorted((r.a_id, r.b_id) for r in J.bbox_overlap(da, db, 7.0).collect()) == sorted(want)
    assert sorted(tuple(r) for r in J.rect_intersections(da, db, 7.0).collect()) == sorted((i, k, v) for (i, k), v in want.items())
    sums = {k: (len(v := [w for (_, j), w in want.items() if j == k]), sum(v), sum(v) / len(v)) for k in {k for _, k in want}}
    assert {r.b_id: (r.n, r.total, r["mean"]) for r in J.rect_intersection_stats(da, db, 7.0).collect()} == sums


def test_crowded_boxes(spark):
    """30,000,000 pairs, brought together again by all of their columns before."""
    k = np.arange(6000)
    a, b = _boxes_frame(spark, np.stack([k % 7, k % 5, k % 7 + 90.0, k % 5 + 90.0], 1)), _boxes_frame(spark, np.stack([k % 9, k % 9, k % 9 + 100.0, k % 9 + 100.0], 1)[:5000])
    began = time.perf_counter()
    assert J.bbox_overlap(a, b, 50.0).count() == 30_000_000
    assert J.rect_intersections(a, b, 50.0).count() == 30_000_000
    assert {r.n for r in J.rect_intersection_stats(a, b, 50.0).collect()} == {6000}
    assert time.perf_counter() - began < 60


def test_burning_many_rectangles_at_two_resolutions(spark):
    """20,000 rectangles of 30,000 fine pixels each, all of which were listed before; against the list of fine pixels of some of them."""
    from gridloom.functions.grid import GridSpec
    from gridloom.operators.resample import burn_rectangles, dual_burn

    s = GridSpec(0.0, 300.0, 1.0, 300, 300)
    rng = np.random.default_rng(10)
    corner = rng.integers(-20, 290, (20_000, 2)) + rng.choice([0.0, 0.05, 0.2, 0.5], (20_000, 2))
    b = np.concatenate([corner, corner + [40.0, 30.1]], 1)
    began = time.perf_counter()
    got = {(r.row, r.col): r.id for r in dual_burn(_boxes_frame(spark, b), s).collect()}
    assert time.perf_counter() - began < 60
    want = np.full((300, 300), -1)
    for k, (x0, y0, x1, y1) in enumerate(b):  # later ones on top: any part of a pixel
        want[max(0, int(np.floor(300 - y1))) : max(0, int(np.ceil(300 - y0))), max(0, int(np.floor(x0))) : max(0, int(np.ceil(x1)))] = k
    assert got == {(r, c): int(want[r, c]) for r in range(300) for c in range(300) if want[r, c] >= 0}
    few = _boxes_frame(spark, b[:30])
    fine = burn_rectangles(few, GridSpec(0.0, 300.0, 0.2, 1500, 1500), True).select(F.expr("row div 5").alias("row"), F.expr("col div 5").alias("col"), "id")
    listed = burn_rectangles(few, s, True).unionByName(fine).groupBy("row", "col").agg(F.max("id").alias("id"))
    assert {tuple(r) for r in listed.collect()} == {tuple(r) for r in dual_burn(few, s).select("row", "col", "id").collect()}


def test_erosion_copies_no_pixel(spark):
    """each pixel was copied to its nine neighbours and counted in a table of one task; now the sorts of a row and a column tell. Against sets."""
    from gridloom.operators.morphology import erode

    rng = np.random.default_rng(11)
    cells = sorted({(int(g), int(r), int(c)) for g in range(3) for r, c in np.argwhere(rng.random((25, 25)) < 0.9) - 4})
    df = spark.createDataFrame(cells + cells[::5], "g int, row int, col int")  # some twice
    held = set(cells)
    for by in (["g"], None):
        for conn in (4, 8):
            for n in (1, 2):
                out = erode(df if by else df.where("g = 1"), n, conn, by)
                assert "Generate" not in out._jdf.queryExecution().toString()
                near = [(a, b) for a in range(-n, n + 1) for b in range(-n, n + 1) if conn == 8 or abs(a) + abs(b) <= n]
                want = {(g, r, c)[0 if by else 1 :] for g, r, c in held if (by or g == 1) and all((g, r + a, c + b) in held for a, b in near)}
                got = [tuple(x) for x in out.collect()]
                assert want and sorted(got) == sorted(want)


def test_distances_are_not_joined_to_the_grid(spark, monkeypatch):
    """the distances of all pixels were sorted and joined to the grid, twice; now a band gives those of its pixels of the grid. Against all seeds."""
    from gridloom.functions.grid import GridSpec
    from gridloom.operators import distance as D

    monkeypatch.setattr(D, "BAND", 4)
    rng = np.random.default_rng(12)
    s = GridSpec(0.0, 0.0, 10.0, 9, 22)  # a last band that isn't whole
    seeds = [(0, 3), (13, 3), (13, 8), (21, 0)]
    pixels = [(int(k // 9), int(k % 9)) for k in rng.permutation(198)[:120]]
    grid = spark.createDataFrame(pixels + pixels[:3] + [(30, 1), (3, 20), (-1, 0), (None, 2)], "row int, col int")
    out = D.distance_full(grid, spark.createDataFrame(seeds + seeds, "row int, col int"), s)
    assert "Join" not in out._jdf.queryExecution().toString()
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    want = [(r, c, 10 * min(float(np.hypot(r - a, c - b)) for a, b in seeds)) for r, c in pixels + pixels[:3]] + [(30, 1, None), (3, 20, None), (-1, 0, None), (None, 2, None)]
    for g, w in zip(got, sorted(want, key=repr), strict=True):
        assert g[:2] == w[:2] and (g[2] is None) == (w[2] is None) and (w[2] is None or abs(g[2] - w[2]) < 1e-9)
