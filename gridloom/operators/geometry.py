"""Polygons in general (C1, C3, C5, C15, C16, I7-I9, A18, D-19, F26): arrays of rings, each an array of struct<x, y>, joined, clipped and burnt.

A polygon is (poly_id, ring): its outer ring, whose first vertex need not be repeated. Joins go by the cells of the boxes; the exact work is done
for the pairs that share one, in tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import GridSpec
from . import tiles as T

RING = "array<struct<x:double,y:double>>"


def boxes(polygons: DataFrame) -> DataFrame:
    """`polygons` with the box x0, y0, x1, y1 of the ring."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    return polygons.withColumns({"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)})


def _let(value, body) -> "F.Column":
    """`body` of a value that is worked out once a row: a name for it, where Catalyst would put the whole expression in each place it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repair(polygons: DataFrame) -> DataFrame:
    """Rings without missing, repeated or closing vertices; polygons of fewer than three vertices or of no area go (D-19)."""
    known = F.filter("ring", lambda p: p.isNotNull() & p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    fresh = lambda ring: F.filter(ring, lambda p, i: (i == 0) | (p != F.element_at(ring, F.greatest(i, F.lit(1)))))
    opened = lambda ring: F.when((F.size(ring) > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1)), F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))).otherwise(ring)
    whole = lambda ring: F.when(F.size(ring) >= 3, F.when(area(ring) > 0, ring))
    # explode(array(ring)) keeps the filter and what follows from asking for the ring's expression again
    ring = _let(_let(_let(known, fresh), opened), whole)
    return polygons.withColumn("__gl_ring", F.explode(F.array(ring))).where(F.col("__gl_ring").isNotNull()).withColumn("ring", F.col("__gl_ring")).drop("__gl_ring")


def area(ring) -> "F.Column":
    """The area of a simple ring, by the shoelace formula."""
    at = lambda r, k: F.element_at(r, (k % F.size(r)) + 1)
    twice = lambda r: F.aggregate(F.sequence(F.lit(0), F.size(r) - 1), F.lit(0.0), lambda s, k: s + at(r, k)["x"] * at(r, k + 1)["y"] - at(r, k + 1)["x"] * at(r, k)["y"])
    return F.abs(_let(ring, twice)) / 2


def _inside(points: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Even-odd rule."""
    a, b = ring, np.roll(ring, -1, 0)
    x, y = points[:, :1], points[:, 1:]
    cross = (a[:, 1] > y) != (b[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
    return (cross & (x < at)).sum(1) % 2 == 1


def rings_meet(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two rings share a point: an edge of one meets one of the other (touching counts), or one lies in the other."""
    return bool(T.meet(p[None], q[None])[0])


def shared_area(p: np.ndarray, q: np.ndarray) -> float:
    """The area that two simple rings, convex or not, have in common: the signed sum over the triangles of their fans."""
    p, q = (r if T.signed(r) > 0 else r[::-1] for r in (p, q))
    return float(T.shared(p[None], q[None])[0])


def _shapes(polygons: DataFrame) -> DataFrame:
    return boxes(polygons).select(F.col("poly_id").alias("id"), *T.BOX, F.col("ring").cast(RING).alias("ring"))


def _ids(a: DataFrame, b: DataFrame) -> str:
    return f"a_id {dict(a.dtypes)['poly_id']}, b_id {dict(b.dtypes)['poly_id']}"


def intersecting(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """(a_id, b_id): polygons that share a point (C1, C3), each pair once. For the left side split by it, see `touching`."""
    def run(a: T.Side, b: T.Side, i: int, j: int) -> Iterator[dict]:
        ra, rb = T.Rings(a), T.Rings(b)
        for m, n in T.pairs(a, b):
            m, n = T.once(a, b, m, n, cell, i, j)
            hit = np.zeros(len(m), bool)
            for k, p, q, convex in T.alike(ra, rb, m, n):
                hit[k] = T.meet(p, q, convex)
            yield {"a_id": a.ids.take(pa.array(m[hit])), "b_id": b.ids.take(pa.array(n[hit]))}

    return T.tiled(_shapes(a), _shapes(b), cell, run, _ids(a, b))


def touching(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """(a_id): the different ids of polygons of `a` that share a point with any of `b` (C3): joins on it, left_semi or left_anti, split `a`.

    A polygon that met one is done, so in a crowd most meet but a few.
    """
    def run(a: T.Side, b: T.Side, i: int, j: int) -> Iterator[dict]:
        ra, rb = T.Rings(a), T.Rings(b)
        met = np.zeros(a.n, bool)
        s, step = 0, 8
        while s < b.n and not met.all():
            those = np.arange(s, min(s + step, b.n))
            for m, n in T.pairs(a, b, np.flatnonzero(~met), those):
                for k, p, q, convex in T.alike(ra, rb, m, n):
                    met[m[k][T.meet(p, q, convex)]] = True
            s, step = s + step, step * 2
        yield {"a_id": a.ids.filter(pa.array(met))}

    return T.tiled(_shapes(a), _shapes(b), cell, run, _ids(a, b).split(",")[0]).distinct()


def intersection_areas(a: DataFrame, b: DataFrame, cell: float, least: float = 1e-10) -> DataFrame:
    """(a_id, b_id, intersection_area) of simple polygons in general, areas over `least`."""
    def run(a: T.Side, b: T.Side, i: int, j: int) -> Iterator[dict]:
        ra, rb = T.Rings(a), T.Rings(b)
        for m, n in T.pairs(a, b, strict=True):
            m, n = T.once(a, b, m, n, cell, i, j)
            area = np.zeros(len(m))
            for k, p, q, convex in T.alike(ra, rb, m, n):
                area[k] = T.shared(p, q, convex)
            over = area > least
            yield {"a_id": a.ids.take(pa.array(m[over])), "b_id": b.ids.take(pa.array(n[over])), "intersection_area": area[over]}

    return T.tiled(_shapes(a), _shapes(b), cell, run, f"{_ids(a, b)}, intersection_area double")


def burn(polygons: DataFrame, spec: GridSpec, touched: bool = False, at: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """(poly_id, row, col): the pixels of each polygon, by scan lines.

    A pixel belongs to a polygon if the point `at` of it (the centre; (0, 0) is its upper left corner) lies inside by the even-odd rule and not on
    an edge or a vertex; with `touched`, also if the polygon's edge passes through it. Everything is a built-in expression: a line has as many crossings as edges meet it.
    """
    b = boxes(polygons).select("poly_id", "ring", "x0", "x1", F.greatest(F.floor((F.lit(spec.oy) - F.col("y1")) / spec.px), F.lit(0)).alias("r0"), F.least(F.floor((F.lit(spec.oy) - F.col("y0")) / spec.px), F.lit(spec.height - 1)).alias("r1")).where("r0 <= r1")
    line = b.select("poly_id", "ring", F.explode(F.sequence("r0", "r1")).alias("row"))
    y = F.lit(spec.oy) - (F.col("row") + F.lit(at[1])) * F.lit(spec.px)
    n = F.size("ring")
    edge = lambda k: (F.element_at("ring", k + 1), F.element_at("ring", (k + 1) % n + 1))

    def crossing(k):
        p, q = edge(k)
        return F.when((p["y"] > y) != (q["y"] > y), F.when(q["y"] == y, q["x"]).otherwise((q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]))

    def lying(k):
        """What of an edge that begins on the line lies on it: all, or its first vertex."""
        p, q = edge(k)
        end = F.when(q["y"] == y, q["x"]).otherwise(p["x"])
        return F.when(p["y"] == y, F.struct(column(F.least(p["x"], end)).alias("c0"), (after(F.greatest(p["x"], end)) - 1).alias("c1")))

    place = lambda x: (x - F.lit(spec.ox)) / F.lit(spec.px) - F.lit(at[0])
    column, after = lambda x: F.ceil(place(x)), lambda x: F.floor(place(x)) + 1  # noqa: E731  the first columns at or after x, and after it
    xs = F.array_sort(F.array_compact(F.transform(F.sequence(F.lit(0), n - 1), crossing)))
    on = F.array_compact(F.transform(F.sequence(F.lit(0), n - 1), lying))
    spans = F.transform(F.sequence(F.lit(0), F.floor(F.size("xs") / 2) - 1), lambda k: F.struct(F.greatest(after(F.element_at("xs", (2 * k + 1).cast("int"))), F.lit(0)).alias("c0"), F.least(column(F.element_at("xs", (2 * k + 2).cast("int"))) - 1, F.lit(spec.width - 1)).alias("c1")))
    inside = line.withColumns({"xs": xs, "on": on}).where(F.size("xs") >= 2).select("poly_id", "row", "on", F.explode(spans).alias("s")).where("s.c0 <= s.c1")
    inside = inside.select("poly_id", "row", "on", F.explode(F.sequence("s.c0", "s.c1")).alias("col")).where("not exists(on, e -> col between e.c0 and e.c1)").drop("on")
    if touched:
        top, low = F.lit(spec.oy) - F.col("row") * F.lit(spec.px), F.lit(spec.oy) - (F.col("row") + 1) * F.lit(spec.px)
        e = line.select("poly_id", "row", F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(edge(k)[0].alias("p"), edge(k)[1].alias("q")))).alias("e")).select("poly_id", "row", "e.p", "e.q")
        hi, lo = F.least(F.greatest("p.y", "q.y"), top), F.greatest(F.least("p.y", "q.y"), low)
        slope = (F.col("q.x") - F.col("p.x")) / F.nullif(F.col("q.y") - F.col("p.y"), F.lit(0.0))
        x = lambda v: F.coalesce(F.col("p.x") + slope * (v - F.col("p.y")), F.col("p.x"))
        flat = F.col("p.y") == F.col("q.y")
        left, right = F.when(flat, F.least("p.x", "q.x")).otherwise(F.least(x(hi), x(lo))), F.when(flat, F.greatest("p.x", "q.x")).otherwise(F.greatest(x(hi), x(lo)))
        cell = lambda v: F.floor((v - F.lit(spec.ox)) / F.lit(spec.px))
        met = e.where(hi >= lo).select("poly_id", "row", F.greatest(cell(left), F.lit(0)).alias("c0"), F.least(cell(right), F.lit(spec.width - 1)).alias("c1")).where("c0 <= c1")
        inside = inside.unionByName(met.select("poly_id", "row", F.explode(F.sequence("c0", "c1")).alias("col")))
    cells = inside.select("poly_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))
    return cells.distinct() if touched else cells


def burn_last(polygons: DataFrame, spec: GridSpec, touched: bool = False) -> DataFrame:
    """(row, col, poly_id): burnt into one raster, the greatest poly_id wins."""
    return burn(polygons, spec, touched).groupBy("row", "col").agg(F.max("poly_id").alias("poly_id"))


def read_polygons(raster: DataFrame, polygons: DataFrame, spec: GridSpec, corner: bool = False) -> DataFrame:
    """The pixels of a raster that lie in polygons, with their poly_id, a row for each polygon (A18); with `corner`, by their upper left corners."""
    return raster.join(burn(polygons, spec, at=(0.0, 0.0) if corner else (0.5, 0.5)), ["row", "col"])


def vectorise(raster: DataFrame, value: str, drop: tuple = (0, 255)) -> DataFrame:
    """(row, col, value, region_id): 4-connected regions of equal value as their cover; missing and dropped values are in none.

    The cover is this engine's polygon: `burn` gives the same shape, and joins on (row, col) are its intersections.
    """
    from .components import label_patches

    px = raster.where(F.col(value).isNotNull() & ~F.col(value).isin(*drop)).select("row", "col", "lin", value)
    # values are kept apart by giving each its own band of rows
    top = px.agg((F.max("row") + 2).alias("__gl_h"))
    kinds = px.select(value).distinct().withColumn("__gl_k", F.dense_rank().over(Window.orderBy(value)))  # the few classes of a raster
    apart = px.join(kinds, value).crossJoin(F.broadcast(top)).withColumns({"__gl_row": F.col("row"), "row": (F.col("row") + F.col("__gl_k") * F.col("__gl_h")).cast("int")})
    return label_patches(apart, 4).select(F.col("__gl_row").alias("row"), "col", value, F.col("patch_id").alias("region_id"))
