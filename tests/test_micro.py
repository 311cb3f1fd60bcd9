"""Small grids with results worked out by hand, and properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.grid import GridSpec, resolve_column, to_null
from gridloom.functions.prefix import running_totals
from gridloom.operators import components as C
from gridloom.operators import distance as D
from gridloom.operators import evaluate as E
from gridloom.operators import focal as H
from gridloom.operators import masks as M
from gridloom.operators import models as MO
from gridloom.operators import morphology as X
from gridloom.operators import resample as I
from gridloom.operators import sampling as K
from gridloom.operators import spatial_join as J
from gridloom.operators import zonal as Z
from gridloom.sources import readers as R


def grid(spark, rows, width=None):
    """Pixels of a drawing: characters other than '.' are ones."""
    w = width or max(map(len, rows))
    cells = [(r, c, r * w + c) for r, line in enumerate(rows) for c, ch in enumerate(line) if ch != "."]
    return spark.createDataFrame(cells, "row int, col int, lin long")


def test_diagonal(spark):
    g = grid(spark, ["x....", ".x...", "..x..", "...x.", "....x"])
    assert C.label_patches(g, 8).select("patch_id").distinct().count() == 1
    assert C.label_patches(g, 4).select("patch_id").distinct().count() == 5


def test_snake_converges(spark):
    g = grid(spark, ["xxxxxxxxx", "........x", "xxxxxxxxx", "x........", "xxxxxxxxx", "........x", "xxxxxxxxx"])
    assert [r[0] for r in C.label_patches(g, 4).select("patch_id").distinct().collect()] == [0]


def test_bridge_joins_over_two_background_pixels(spark):
    g = grid(spark, ["......", "x..x..", "......"])
    assert C.label_patches(g).select("patch_id").distinct().count() == 2
    out = C.bridge(g, 1, 6)
    assert out.count() == 2
    assert out.select("patch_id").distinct().count() == 1


def test_hysteresis_keeps_only_parts_with_a_high_pixel(spark):
    rows = [(0, 0, 0, 0.6), (0, 1, 1, 0.65), (2, 3, 15, 0.6), (2, 4, 16, 0.95), (0, 5, 5, None)]
    px = spark.createDataFrame(rows, "row int, col int, lin long, prob double")
    assert {r.lin for r in C.hysteresis(px, 0.6, 0.9).collect()} == {15, 16}
    assert C.hysteresis(px, 0.6, 0.9, 3).count() == 0
    assert {r.lin for r in C.hysteresis(px, 0.6, 0.6, 2).collect()} == {r.lin for r in C.sieve(px.where("prob >= 0.6"), 2).collect()}


def test_empty_mask(spark):
    e = spark.createDataFrame([], "row int, col int, lin long")
    assert C.label_patches(e).count() == 0
    assert X.erode(e).count() == 0
    assert X.dilate(e).count() == 0


def test_opening_is_idempotent(spark):
    g = grid(spark, ["xxxx.x", "xxxx..", "xxxx.x", "......"])
    once = X.opening(g)
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in X.opening(once).collect()} == {(r, c) for r in range(3) for c in range(4)}


def test_partial_blocks_are_dropped(spark):
    px = spark.createDataFrame([(r, c, 1) for r in range(5) for c in range(7)], "row int, col int, wet int")
    assert {(r.brow, r.bcol) for r in Z.block_density(px, 2, 5, 7, 0.01).collect()} == {(a, b) for a in range(2) for b in range(3)}


def test_size_bands_and_mode(spark):
    a = spark.createDataFrame([(v,) for v in (0.01, 0.05, 0.1, 1.0, 5.0, 10.0)], "area_ha double")
    s = Z.size_summary(a).first()
    assert [s[f"patches_{n}"] for n, _, _ in Z.BANDS] == [1] * 6
    m = Z.size_summary(spark.createDataFrame([(v,) for v in (0.25, 0.15, 0.15)], "area_ha double")).first()
    assert m["modal_ha"] == 0.2


def test_missing_is_not_over_a_threshold(spark):
    df = spark.createDataFrame([(float("nan"),), (0.7,), (None,), (-9999.0,), (float("inf"),)], "v double")
    assert df.where(to_null(F.col("v"), -9999.0) >= 0.5).count() == 1


def test_conformal_rank_is_clamped(spark):
    s = spark.createDataFrame([(1, v) for v in (0.1, 0.2, 0.3, 0.4)], "y int, s double")
    assert E.conformal_quantile(s, 0.1, ["y"]).first()["q"] == 0.4
    assert E.conformal_quantile(s, 0.5, ["y"]).first()["q"] == 0.3


def test_majority_tie_goes_to_the_least_region(spark):
    p = spark.createDataFrame([(1, 3), (1, 3), (1, 1), (1, 1), (2, None)], "patch_id int, region int")
    assert {r.patch_id: r.region for r in Z.majority(p, "patch_id", "region").collect()} == {1: 1, 2: -1}


def test_distance_is_zero_on_seeds_and_exact(spark):
    g = GridSpec(0, 0, 10.0, 6, 5)
    allp = spark.createDataFrame([(r, c) for r in range(5) for c in range(6)], "row int, col int")
    seeds = [(0, 0), (4, 5), (2, 2)]
    s = spark.createDataFrame(seeds, "row int, col int")
    for r in D.distance_full(allp, s, g).collect():
        assert abs(r.dist - 10 * min(math.hypot(r.row - a, r.col - b) for a, b in seeds)) < 1e-9
    assert all(r.dist is None for r in D.distance_full(allp, s.limit(0), g).collect())
    assert all(r.dist == 20.0 for r in D.distance_capped(allp, s.limit(0), g, 20.0).collect())


def test_nearest_of_a_single_point(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, "a"), (2, 3000.0, 4000.0, "a"), (3, 1.0, 1.0, "b")], "id int, x double, y double, g string")
    assert {r.id: r.nn for r in J.nearest_other(p, 10.0, ["g"]).collect()} == {1: 5000.0, 2: 5000.0, 3: None}


def test_polygon_with_a_dent(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    poly = spark.createDataFrame([(7, [{"x": x, "y": y} for x, y in ring])], "poly_id int, ring array<struct<x:double,y:double>>")
    pts = spark.createDataFrame([(1, 2.0, 0.5), (2, 2.0, 2.0), (3, 0.5, 2.0), (4, 5.0, 1.0)], "id int, x double, y double")
    assert {r.id for r in J.points_in_polygons(pts, poly, 1.5).collect()} == {1, 3}


def test_depressions_and_flow_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(5):
        dem = rng.integers(0, 9, (6, 7)).astype(float)
        filled = H.fill_depressions(dem)
        # brute force: lower from above until nothing changes
        level = np.where(np.pad(np.zeros((4, 5), bool), 1, constant_values=True), dem, 99.0)
        for _ in range(200):
            for r in range(1, 5):
                for c in range(1, 6):
                    level[r, c] = max(dem[r, c], level[r - 1 : r + 2, c - 1 : c + 2][np.arange(9).reshape(3, 3) != 4].min())
        assert (filled == level).all()
        acc = H.flow_accumulation(filled)
        assert acc.min() == 1
        assert acc.max() <= 42
    slope = np.add.outer(np.zeros(3), np.arange(5.0))
    assert (H.flow_accumulation(slope)[:, 0].sum()) == 15


def test_fit_quantities(spark):
    curve = spark.createDataFrame([(k / 100, 10.0 ** -(k / 20 if k <= 20 else 1 + (k - 20) / 5)) for k in range(1, 41)], "threshold double, fpr double")
    b = E.breakpoint(curve).first()
    assert abs(b.threshold - 0.20) < 0.0201
    assert b.improvement > 0.5


def test_running_totals_cross_partitions(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(500)], "k int, v int")
    got = running_totals(df, [F.col("k")], {"t": "v"}, 7).orderBy("k").collect()
    assert [r.t for r in got] == list(np.cumsum([i % 5 for i in range(500)]))


def test_rebalance_partitions_the_input(spark):
    df = spark.createDataFrame([(i, i % 7, [0, 1, 2, 3, 0][i % 5]) for i in range(200)] + [(999, 77, 0)], "id long, block int, label int")
    out = K.rebalance(df, 1.0, 0.5).collect()
    assert len(out) == 201
    assert not next(r for r in out if r.id == 999).kept
    assert all(r.kept for r in out if r.label >= 2)


def test_masks(spark):
    df = spark.createDataFrame([(0, 0, 1, True), (0, 1, 1, False)], "row int, col int, wet int, valid boolean")
    m = df.where("col = 0").select("row", "col")
    out = M.mask_out(df, m.unionByName(m), "wet").orderBy("col").collect()
    assert [(r.wet, r.valid) for r in out] == [(0, True), (1, False)]
    assert M.all_finite(F.col("v")) is not None
    v = spark.createDataFrame([([1.0, None],), ([1.0, 2.0],), (None,)], "v array<double>")
    assert [r[0] for r in v.select(M.all_finite(F.col("v"))).collect()] == [False, True, False]


def test_resampling(spark):
    s, t = GridSpec(0, 40, 10.0, 4, 4), GridSpec(0, 40, 20.0, 2, 2)
    src = spark.createDataFrame([(r, c, float(r * 4 + c)) for r in range(4) for c in range(4) if (r, c) != (0, 0)], "row int, col int, v double")
    tgt = spark.createDataFrame([(0, 0), (1, 1)], "row int, col int")
    got = {(r.row, r.col): r.v for r in I.bilinear(src, s, tgt, t, "v").collect()}
    assert got == {(0, 0): pytest.approx(10 / 3), (1, 1): pytest.approx(12.5)}
    assert I.coarsening_factor(100, 200) == 1
    assert I.coarsening_factor(1000, 900) == 2
    assert I.simplify([(0, 0), (1, 0.01), (2, 0), (3, 5)], 0.1) == [(0, 0), (2, 0), (3, 5)]
    assert s.snapped(20.0, (5, 5, 35, 35)) == GridSpec(0, 40, 20.0, 2, 2)


def test_roles():
    assert resolve_column(["Name", "GRADE"], "grade", []) == "GRADE"
    assert resolve_column(["Name", "GRADE"], None, ["alc", "name"]) == "Name"
    assert resolve_column(["a"], "b", ["a"]) is None


def test_sources_and_sinks(spark, tmp_path):
    px = spark.createDataFrame([(r, c, float(r) if r else None) for r in range(3) for c in range(3)], "row int, col int, value double")
    R.write_tiles(px, str(tmp_path / "tiles"), 2)
    back = R.read_raster(spark, str(tmp_path / "tiles"))
    assert back.count() == 9
    assert back.where("valid").count() == 6
    assert R.collect_tiles(spark, str(tmp_path / "tiles")).where("tile_file like '%.parquet'").count() == 9
    R.export(px, str(tmp_path / "out.csv"))
    R.export(px, str(tmp_path / "out.json"))
    with pytest.raises(ValueError):
        R.export(px, str(tmp_path / "out.xyz"))
    top = spark.createDataFrame([(2, 1.0, 1, 1, "b"), (1, 3.0, 1, 1, "a")], "rank int, area_ha double, bng_easting int, bng_northing int, region_name string")
    R.export(top, str(tmp_path / "top.csv"))
    assert [r.region_name for r in R.read_ranked(spark, str(tmp_path / "top.csv"), 1, ["rank"]).collect()] == ["a"]
    assert "area" in R.report(top.selectExpr("sum(area_ha) as area"), "t")
    assert R.manifest(top.limit(0)) == "{}"
    a = R.sample_cache(px, str(tmp_path / "cache"), "x").count()
    assert a == R.sample_cache(px.limit(0), str(tmp_path / "cache"), "x").count() == 9
    poly = spark.createDataFrame([(1, "Polygon", [[(0.0, 0.0)], [(1.0, 1.0)]]), (2, "LineString", [[(0.0, 0.0)]])], "id int, geom_type string, parts array<array<struct<x:double,y:double>>>")
    assert R.vertices(poly).count() == 2


def test_maxent_prefers_where_presence_is(spark):
    df = spark.createDataFrame([(i, float(i % 20), float(i // 20), 1 if i % 20 > 15 and i % 3 else 0) for i in range(400)], "sample_id long, a double, b double, y int")
    out = MO.maxent(df, ["a", "b"]).groupBy((F.col("a") > 15).alias("in")).agg(F.avg("suitability").alias("s")).collect()
    s = {r["in"]: r.s for r in out}
    assert s[True] > 2 * s[False]


def test_stream_equals_batch(spark, data, tmp_path):
    from gridloom.sources.views import slices, table
    from gridloom.streaming.slices import slice_stats_stream

    src = str(tmp_path / "in")
    table(spark, data, "events").selectExpr("ts", "user_id % 50 as cell", "value").repartition(3).write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, cell long, value double").option("maxFilesPerTrigger", 1).parquet(src)
    q = slice_stats_stream(stream, "ts", "1 day", "400 days").writeStream.outputMode("complete").format("memory").queryName("slices_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.slice_start, r.cell): (r.n, round(r.mean, 6)) for r in spark.table("slices_out").collect()}
    want = {(r.slice_id, r.cell): (r.n, round(r.mean, 6)) for r in Z.slice_stats(slices(spark, data), ["cell", "slice_id"]).collect()}
    assert got == want


def test_bridge_components_asks_for_every_likely_pixel(spark, data):
    from gridloom.plans.q_patches import bridge_components
    from gridloom.sources import views as V

    want = {r.lin for r in V.px(spark, data).where("prob >= 0.95").select("lin").collect()}
    assert want
    assert {r.lin for r in bridge_components(spark, data).select("lin").collect()} == want


def test_percentiles_against_numpy(spark):
    import numpy as np

    from gridloom.functions.quantiles import percentiles

    rng = np.random.default_rng(2)
    rows = [(None if g == 4 else int(g), None if v > 0.95 else float(round(v, 2))) for g, v in zip(rng.integers(0, 5, 3000), rng.random(3000), strict=True)] + [(9, None), (8, 1.5)]
    df = spark.createDataFrame(rows, "g int, v double")
    qs = [0.0, 0.013, 0.5, 0.9, 1.0]
    got = {r.g: r.q for r in percentiles(df, "v", qs, ["g"]).collect()}
    for g in (0, 1, 2, 3, None, 8):
        assert np.allclose(got[g], np.quantile([v for k, v in rows if k == g and v is not None], qs))
    assert 9 not in got
    assert np.allclose(percentiles(df, "v", qs).first().q, np.quantile([v for _, v in rows if v is not None], qs))
    assert percentiles(df.where("g = 9"), "v", [0.5]).first().q == [None]


def test_logistic_against_numpy(spark):
    import numpy as np

    from gridloom.operators.models import fit_logistic

    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = (x @ np.array([1.0, -2.0, 0.5, 0.0, 0.3]) + rng.normal(size=400) > 0.2).astype(int)
    df = spark.createDataFrame([(r.tolist(), int(t)) for r, t in zip(x, y, strict=True)] + [([None] * 5, 1), ([1.0] * 5, None)], "features array<double>, y int").repartition(3)
    w, b = fit_logistic(df, 0.5, 30)
    z, v, reg = np.concatenate((x, np.ones((400, 1))), 1), np.zeros(6), np.diag([0.5] * 5 + [1e-9])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ v))
        v = v + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + reg, z.T @ (y - p) - reg @ v)
    assert np.allclose([*w, b], v, atol=1e-6)


def test_geographic_folds(spark):
    import numpy as np

    from gridloom.operators.models import geographic_folds

    rng = np.random.default_rng(1)
    centres = [(0, 0), (1000, 0), (0, 1000), (1000, 1000)]
    rows = [(4 * i + k, float(cx + rng.normal()), float(cy + rng.normal())) for i in range(50) for k, (cx, cy) in enumerate(centres)]
    got = geographic_folds(spark.createDataFrame(rows, "id long, x double, y double"), 4).collect()
    assert len({(r.id % 4, r.fold) for r in got}) == len({r.fold for r in got}) == 4


def test_polygons_that_are_not_convex():
    import numpy as np

    from gridloom.operators.geometry import rings_meet, shared_area

    l_shape = np.array([(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)], float)
    notch = np.array([(2, 2), (6, 2), (6, 6), (2, 6)], float)
    assert not rings_meet(l_shape, notch)
    assert shared_area(l_shape, notch) == 0
    square = np.array([(0.5, 0.5), (0.5, 3), (3, 3), (3, 0.5)], float)
    assert rings_meet(l_shape, square)
    assert np.isclose(shared_area(l_shape, square), 2.5 * 0.5 + 0.5 * 2)
    assert np.isclose(shared_area(l_shape, l_shape), 7)
    inner = np.array([(0.2, 0.2), (0.4, 0.2), (0.3, 0.4)], float)
    assert rings_meet(l_shape, inner)
    assert np.isclose(shared_area(inner, l_shape), 0.02)
    touch = np.array([(4, 0.5), (5, 0), (5, 1)], float)
    assert rings_meet(l_shape, touch)


def test_burning_polygons_that_are_not_convex(spark):
    import numpy as np

    from gridloom.functions.grid import GridSpec
    from gridloom.operators.geometry import RING, _inside, burn

    rng = np.random.default_rng(3)
    rings = [[(float(r * np.cos(t) + 20), float(r * np.sin(t) + 20)) for t, r in zip(np.sort(rng.random(9)) * 2 * np.pi, rng.uniform(3, 19, 9), strict=True)] for _ in range(6)]
    df = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in r]) for i, r in enumerate(rings)], f"poly_id long, ring {RING}")
    s = GridSpec(0.0, 40.0, 1.0, 40, 40)
    at = np.array([(c + 0.5, 39.5 - r) for r in range(40) for c in range(40)])
    want = {(i, k // 40, k % 40) for i, ring in enumerate(rings) for k in np.flatnonzero(_inside(at, np.array(ring)))}
    assert {tuple(r) for r in burn(df, s).collect()} == want
    fine = np.array([((c + 0.5) / 8, 40 - (r + 0.5) / 8) for r in range(320) for c in range(320)])
    touched = {tuple(r) for r in burn(df, s, True).collect()}
    for i, ring in enumerate(rings):
        inner = {(i, k // 320 // 8, k % 320 // 8) for k in np.flatnonzero(_inside(fine, np.array(ring)))}
        own = {t for t in touched if t[0] == i}
        assert inner <= own
        assert len(own) <= len(inner) + 60


def _on_edge(p, ring):
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (bx - ax) * (p[1] - ay) == (by - ay) * (p[0] - ax) and min(ax, bx) <= p[0] <= max(ax, bx) and min(ay, by) <= p[1] <= max(ay, by):
            return True
    return False


def _check_edges(spark, at):
    """Rings with vertices, level, upright and oblique edges on the points that decide; notches from all sides."""
    import numpy as np

    from gridloom.functions.grid import GridSpec
    from gridloom.operators.geometry import RING, _inside, burn

    rings = [
        [(6, 3), (3, 6), (0, 3), (3, 0)],
        [(1, 1), (7, 1), (7, 6), (1, 6)],
        [(0, 0), (4, 4), (8, 0), (8, 8), (4, 5), (0, 8)],
        [(0, 0), (8, 0), (4, 4), (8, 8), (0, 8), (3, 4)],
        [(1, 1), (8, 1), (8, 7), (6, 7), (6, 4), (3, 4), (3, 7), (1, 7)],
    ]
    rings = [[(x + at[0], y + 1 - at[1]) for x, y in r] for r in rings]
    df = spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in r]) for i, r in enumerate(rings)], f"poly_id long, ring {RING}")
    points = [(r, c, (c + at[0], 10 - r - at[1])) for r in range(10) for c in range(10)]
    want = {(i, r, c) for i, ring in enumerate(rings) for r, c, p in points if _inside(np.array([p], float), np.array(ring, float))[0] and not _on_edge(p, ring)}
    got = [tuple(x) for x in burn(df, GridSpec(0.0, 10.0, 1.0, 10, 10), at=at).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want
    assert len(want) < sum(_inside(np.array([p], float), np.array(ring, float))[0] for ring in rings for _, _, p in points)


def test_a_centre_on_an_edge_is_outside(spark):
    _check_edges(spark, (0.5, 0.5))


def test_a_corner_on_an_edge_is_outside(spark):
    _check_edges(spark, (0.0, 0.0))
