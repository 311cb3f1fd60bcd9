"""Resampling, rasterising, stacks and mosaics (section I)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import GridSpec


def nearest(src: DataFrame, s: GridSpec, target: DataFrame, t: GridSpec, bands: list[str]) -> DataFrame:
    """Target pixels with the bands of the source pixel that holds their centre (I2, I5, C8); NULL outside. Equal grids join as they are."""
    if s.aligned(t):
        return target.select("row", "col").join(src.select("row", "col", *bands), ["row", "col"], "left")
    at = target.select("row", "col", s.row(t.y(F.col("row"))).alias("__gl_r"), s.col(t.x(F.col("col"))).alias("__gl_c"))
    b = src.select(F.col("row").alias("__gl_r"), F.col("col").alias("__gl_c"), *bands)
    return at.join(b, ["__gl_r", "__gl_c"], "left").select("row", "col", *bands)


def bilinear(src: DataFrame, s: GridSpec, target: DataFrame, t: GridSpec, value: str) -> DataFrame:
    """The four source pixels round a target centre, weights renormalised over valid ones (I1); none: NULL."""
    if s.aligned(t):
        return nearest(src, s, target, t, [value])
    fx, fy = (t.x(F.col("col")) - F.lit(s.ox)) / s.px - 0.5, (F.lit(s.oy) - t.y(F.col("row"))) / s.px - 0.5
    at = target.select("row", "col", F.floor(fx).alias("c0"), F.floor(fy).alias("r0"), (fx - F.floor(fx)).alias("wx"), (fy - F.floor(fy)).alias("wy"))
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    w = F.when(F.col("o.a") == 1, F.col("wy")).otherwise(1 - F.col("wy")) * F.when(F.col("o.b") == 1, F.col("wx")).otherwise(1 - F.col("wx"))
    each = at.withColumn("o", corner).select("row", "col", (F.col("r0") + F.col("o.a")).alias("__gl_r"), (F.col("c0") + F.col("o.b")).alias("__gl_c"), w.alias("w")).where("w > 0")
    b = src.where(F.col(value).isNotNull()).select(F.col("row").alias("__gl_r"), F.col("col").alias("__gl_c"), F.col(value).alias("v"))
    return each.join(b, ["__gl_r", "__gl_c"], "left").groupBy("row", "col").agg((F.sum(F.col("v") * F.col("w")) / F.nullif(F.sum(F.when(F.col("v").isNotNull(), F.col("w"))), F.lit(0.0))).alias(value))


def downsample(df: DataFrame, factor: int, aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """(brow, bcol, ...) of factor x factor blocks; aggs: name -> (function, column), functions avg, sum, max, min."""
    fn = {"avg": F.avg, "sum": F.sum, "max": F.max, "min": F.min}
    return df.groupBy(F.expr(f"row div {factor}").cast("int").alias("brow"), F.expr(f"col div {factor}").cast("int").alias("bcol")).agg(*[fn[f](c).alias(n) for n, (f, c) in aggs.items()])


def upsample(coarse: DataFrame, target: DataFrame, th: int, tw: int, ch: int, cw: int, value: str) -> DataFrame:
    """Blocky expansion: target row i takes coarse row floor(i * ch / th)."""
    at = target.select("row", "col", F.floor(F.col("row") * ch / th).cast("int").alias("brow"), F.floor(F.col("col") * cw / tw).cast("int").alias("bcol"))
    return at.join(coarse.select("brow", "bcol", value), ["brow", "bcol"], "left").select("row", "col", value)


def coarsening_factor(cells: int, most: int) -> int:
    """ceil(sqrt(cells / most)), 2 at least, where a grid is over its limit; else 1."""
    return max(2, math.ceil(math.sqrt(cells / most))) if cells > most else 1


def mask_cascade(df: DataFrame, value: str, masks: dict[str, str]) -> DataFrame:
    """The value NULL where a mask holds, and `reason`, the first mask in order that took it."""
    reason = F.lit(None).cast("string")
    for name, cond in reversed(masks.items()):
        reason = F.when(F.coalesce(F.expr(cond), F.lit(False)), name).otherwise(reason)
    out = df.withColumn("reason", F.when(F.col(value).isNotNull(), reason))
    return out.withColumn(value, F.when(F.col("reason").isNull(), F.col(value)))


def _pixel_ranges(rects: DataFrame, spec: GridSpec, touched: bool) -> DataFrame:
    """(id, c0, c1, r0, r1): of each rectangle the columns and rows of pixels that it takes."""
    if touched:
        c0, c1 = F.floor((F.col("x0") - spec.ox) / spec.px), F.ceil((F.col("x1") - spec.ox) / spec.px) - 1
        r0, r1 = F.floor((F.lit(spec.oy) - F.col("y1")) / spec.px), F.ceil((F.lit(spec.oy) - F.col("y0")) / spec.px) - 1
    else:
        c0, c1 = F.ceil((F.col("x0") - spec.ox) / spec.px - 0.5), F.ceil((F.col("x1") - spec.ox) / spec.px - 0.5) - 1
        r0, r1 = F.floor((F.lit(spec.oy) - F.col("y1")) / spec.px - 0.5) + 1, F.floor((F.lit(spec.oy) - F.col("y0")) / spec.px - 0.5)
    return rects.select("id", F.greatest(c0, F.lit(0)).alias("c0"), F.least(c1, F.lit(spec.width - 1)).alias("c1"), F.greatest(r0, F.lit(0)).alias("r0"), F.least(r1, F.lit(spec.height - 1)).alias("r1")).where("c0 <= c1 and r0 <= r1")


def _burn_ranges(ranges: DataFrame) -> DataFrame:
    """(row, col, id): the greatest id of the ranges that hold a pixel; of equal ranges only the greatest is spread over its pixels."""
    top = ranges.groupBy("c0", "c1", "r0", "r1").agg(F.max("id").alias("id"))
    cells = top.select("id", F.explode(F.sequence("r0", "r1")).alias("row"), "c0", "c1").select("id", "row", F.explode(F.sequence("c0", "c1")).alias("col"))
    cells = cells.select("id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))
    return cells.groupBy("row", "col").agg(F.max("id").alias("id"))


def burn_rectangles(rects: DataFrame, spec: GridSpec, touched: bool = False) -> DataFrame:
    """(row, col, id): pixels whose centre is in a rectangle (id, x0, y0, x1, y1), or that it touches; the greatest id wins.

    Centre rule: left and lower bounds in, right and upper bounds out.
    """
    return _burn_ranges(_pixel_ranges(rects, spec, touched))


def dual_burn(rects: DataFrame, spec: GridSpec, factor: int = 5) -> DataFrame:
    """Touched pixels of the grid, and of a grid `factor` times finer brought up by maximum, into one array.

    A range of fine pixels is brought up as a range: its pixels needn't be listed for that.
    """
    fine = GridSpec(spec.ox, spec.oy, spec.px / factor, spec.width * factor, spec.height * factor)
    up = _pixel_ranges(rects, fine, True).select("id", *[F.expr(f"{c} div {factor}").alias(c) for c in ("c0", "c1", "r0", "r1")])
    return _burn_ranges(_pixel_ranges(rects, spec, True).unionByName(up))


def category_codes(df: DataFrame, columns: list[str], missing: str = "NA") -> DataFrame:
    """`df` with `code` 1..k of the sorted different combinations; missing values are `missing` (I10). k is small: one row a soil class."""
    filled = df.withColumns({c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(missing)) for c in columns})
    keys = filled.select(*columns).distinct().withColumn("code", F.row_number().over(Window.orderBy(*columns)))
    return filled.join(keys, columns)


def stack(first: DataFrame, others: list[DataFrame]) -> DataFrame:
    """Bands side by side on the pixels of the first layer."""
    for o in others:
        first = first.join(o, ["row", "col"], "left")
    return first


def simplify(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Douglas-Peucker on an open line."""
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        (x0, y0), (x1, y1) = points[a], points[b]
        length = math.hypot(x1 - x0, y1 - y0)
        far, at = 0.0, None
        for i in range(a + 1, b):
            x, y = points[i]
            d = abs((x1 - x0) * (y0 - y) - (x0 - x) * (y1 - y0)) / length if length else math.hypot(x - x0, y - y0)
            if d > far:
                far, at = d, i
        if at is not None and far > tolerance:
            keep.add(at)
            todo += [(a, at), (at, b)]
    return [points[i] for i in sorted(keep)]
