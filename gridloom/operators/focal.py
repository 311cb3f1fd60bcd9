"""Terrain and neighbourhood operators (section H)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import scatter, square
from ..functions.quantiles import percentiles


def gradient(dem: DataFrame, value: str, px: float) -> DataFrame:
    """gx, gy by central differences, one-sided at the edges; slope = sqrt(gx^2 + gy^2) (H1). NULL neighbours give NULL."""
    out = dem
    for name, part, order in (("gx", "row", "col"), ("gy", "col", "row")):
        w = Window.partitionBy(part).orderBy(order)
        prev, nxt, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
        first, last = F.lag(order).over(w).isNull(), F.lead(order).over(w).isNull()
        out = out.withColumn(name, F.when(first & last, F.lit(0.0)).when(first, (nxt - here) / px).when(last, (here - prev) / px).otherwise((nxt - prev) / (2 * px)))
    return out.withColumn("slope", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))


def wetness_index(flow: Column, slope: Column, px: float) -> Column:
    """ln(max(flow, px) / slope), a slope of at most 1e-6 or none counting as 1e-3 (H2)."""
    s = F.when(slope.isNull() | (slope <= 1e-6), F.lit(1e-3)).otherwise(slope)
    return F.log(F.greatest(flow, F.lit(float(px))) / s)


def neighbours(df: DataFrame, value: str, weights: dict[tuple[int, int], tuple[float, ...]], names: tuple[str, ...]) -> DataFrame:
    """(row, col, names...): weighted sums over the offsets' pixels; a pixel p with offset o lends its value to p - o."""
    moved = scatter(df.select("row", "col", F.col(value).alias("v")), [(-r, -c, *w) for (r, c), w in weights.items()], ("dr", "dc", *names))
    return moved.groupBy("row", "col").agg(*[F.sum(F.col("v") * F.col(n)).alias(n) for n in names], F.count("v").alias("__gl_n"))


def horn(dem: DataFrame, value: str, px: float) -> DataFrame:
    """(row, col, slope_deg, aspect_deg) by Horn's 3 x 3 kernel, of pixels with all nine values (H5). Aspect is clockwise from north, NULL where flat."""
    w = {}
    for r, c in square(1):
        w[r, c] = (c * (2.0 if r == 0 else 1.0) / (8 * px), r * (2.0 if c == 0 else 1.0) / (8 * px))
    s = neighbours(dem, value, w, ("gx", "gy")).where("__gl_n = 9").join(dem.select("row", "col"), ["row", "col"], "left_semi")
    slope = F.degrees(F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))))
    aspect = F.when((F.abs("gx") > 1e-12) | (F.abs("gy") > 1e-12), F.pmod(F.degrees(F.atan2(-F.col("gx"), F.col("gy"))) + 360.0, F.lit(360.0)))
    return s.select("row", "col", slope.alias("slope_deg"), aspect.alias("aspect_deg"))


def circular_mean(df: DataFrame, aspect: str, by: list[str]) -> DataFrame:
    """The mean direction of degrees, NULL where the mean vector is no longer than 1e-6 (H7)."""
    s, c = F.avg(F.sin(F.radians(aspect))), F.avg(F.cos(F.radians(aspect)))
    g = df.groupBy(*by).agg(s.alias("s"), c.alias("c"))
    return g.select(*by, F.when(F.sqrt(F.col("s") * F.col("s") + F.col("c") * F.col("c")) > 1e-6, F.pmod(F.degrees(F.atan2("s", "c")) + 360.0, F.lit(360.0))).alias("aspect_deg"))


def fill_median(df: DataFrame, value: str) -> DataFrame:
    """Missing values take the median of their up to 8 neighbours, else that of all (H8)."""
    missing = df.where(F.col(value).isNull()).select("row", "col")
    near = scatter(df.where(F.col(value).isNotNull()).select("row", "col", F.col(value).alias("v")), [o for o in square(1) if o != (0, 0)]).join(missing, ["row", "col"]).groupBy("row", "col").agg(F.percentile("v", F.lit(0.5)).alias("__gl_m"))
    whole = percentiles(df, value, [0.5]).select(F.col("q")[0].alias("__gl_all"))
    return df.join(near, ["row", "col"], "left").crossJoin(F.broadcast(whole)).withColumn(value, F.coalesce(value, "__gl_m", "__gl_all")).drop("__gl_m", "__gl_all")


def hillshade(gx: Column, gy: Column, azimuths: tuple[float, ...] = (315.0, 45.0, 225.0, 135.0), altitude: float = 45.0) -> Column:
    """The mean illumination from several azimuths (H9)."""
    slope, aspect = F.atan(F.sqrt(gx * gx + gy * gy)), F.atan2(-gx, gy)
    alt = math.radians(altitude)
    shades = [F.lit(math.sin(alt)) * F.cos(slope) + F.lit(math.cos(alt)) * F.sin(slope) * F.cos(F.lit(math.radians(a)) - aspect) for a in azimuths]
    total = shades[0]
    for s in shades[1:]:
        total = total + s
    return total / len(shades)


def stretch(df: DataFrame, value: str, low: float = 0.02, high: float = 0.98, gamma: float = 1.0) -> DataFrame:
    """(v - p_low) / (p_high - p_low), clipped to [0, 1], to the power gamma."""
    b = percentiles(df, value, [low, high]).withColumnRenamed("q", "__gl_b")
    v = (F.col(value) - F.col("__gl_b")[0]) / F.nullif(F.col("__gl_b")[1] - F.col("__gl_b")[0], F.lit(0.0))
    return df.crossJoin(F.broadcast(b)).withColumn("stretched", F.when(F.col(value).isNotNull(), F.pow(F.greatest(F.least(F.coalesce(v, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)), F.lit(gamma)))).drop("__gl_b")


def gaussian(df: DataFrame, value: str, sigma: float) -> DataFrame:
    """(row, col, smooth): Gaussian smoothing normalised by its support, truncated at 4 sigma; pixels of the table only.

    The kernel is separable: two passes of 8 sigma + 1 offsets, not one of its square.
    """
    k = int(4 * sigma + 0.5)
    g = np.exp(-0.5 * (np.arange(-k, k + 1) / sigma) ** 2)
    g /= g.sum()
    one = df.where(F.col(value).isNotNull()).select("row", "col", F.col(value).alias("v"), F.lit(1.0).alias("w"))
    for axis in (0, 1):
        offs = [((i, 0) if axis == 0 else (0, i)) + (float(g[i + k]),) for i in range(-k, k + 1)]
        one = scatter(one, offs, ("dr", "dc", "g")).groupBy("row", "col").agg(F.sum(F.col("v") * F.col("g")).alias("v"), F.sum(F.col("w") * F.col("g")).alias("w"))
    return df.select("row", "col").join(one, ["row", "col"], "left").select("row", "col", F.when(F.col("w") > 1e-6, F.col("v") / F.col("w")).alias("smooth"))


def row_profile(df: DataFrame, value: str, window: int) -> DataFrame:
    """(row, mean, smooth): row means, and their centred moving average of odd width, renormalised at the edges."""
    k = (window if window % 2 else window + 1) // 2
    rows = df.groupBy("row").agg(F.avg(value).alias("mean"))
    # one line for each row of the raster
    return rows.withColumn("smooth", F.avg("mean").over(Window.orderBy("row").rangeBetween(-k, k)))


def shade_alpha(shade: Column, inside: Column, strength: float = 1.0) -> Column:
    """Opacity 0-255 of a terrain shadow: (1 - shade) * strength inside the mask, 0 outside and where there is none."""
    return F.when(F.coalesce(inside, F.lit(False)) & shade.isNotNull(), F.round((1 - F.greatest(F.least(shade, F.lit(1.0)), F.lit(0.0))) * strength * 255)).otherwise(0).cast("int")


def composite(value: Column, inside: Column, table: list[tuple[int, int, int]]) -> Column:
    """Colours (r, g, b, alpha) of values in [0, 1] by a look-up table; outside the mask transparent."""
    place = F.least(F.lit(len(table)), F.floor(F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0)) * (len(table) - 1) + 0.5).cast("int") + 1)
    colours = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b"), F.lit(255).alias("alpha")) for r, g, b in table])
    none = F.struct(F.lit(0).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"), F.lit(0).alias("alpha"))
    return F.when(F.coalesce(inside, F.lit(False)) & value.isNotNull(), F.element_at(colours, place)).otherwise(none)


def preview(df: DataFrame, value: str, inside: str, factor: int) -> DataFrame:
    """(brow, bcol, value, share): block means of the pixels inside the mask, and their share; blocks without one are not there."""
    own = df.withColumns({"brow": F.expr(f"row div {factor}").cast("int"), "bcol": F.expr(f"col div {factor}").cast("int"), "__gl_v": F.when(F.col(inside), F.col(value))})
    return own.groupBy("brow", "bcol").agg(F.avg("__gl_v").alias(value), F.try_divide(F.count("__gl_v"), F.count("*")).alias("share")).where(F.col(value).isNotNull())


def rank_scale(df: DataFrame, value: str) -> DataFrame:
    """Of positive values (number <= v - 1) / (n - 1): ties take the upper rank; a single value is 1, others are 0.

    Values are counted before they are ranked, and ranked by range-partitioned running totals.
    """
    from ..functions.prefix import running_totals

    counts = df.where(F.col(value) > 0).groupBy(F.col(value).alias("__gl_v")).agg(F.count("*").alias("k"))
    ranked = running_totals(counts, [F.col("__gl_v")], {"__gl_upto": "k"})
    n = counts.agg(F.sum("k").alias("__gl_n"))
    out = df.join(ranked.select("__gl_v", "__gl_upto"), df[value] == F.col("__gl_v"), "left").crossJoin(F.broadcast(n))
    scaled = F.when(F.col(value).isNull(), None).when(F.coalesce(F.col(value) > 0, F.lit(False)), F.when(F.col("__gl_n") == 1, 1.0).otherwise((F.col("__gl_upto") - 1) / (F.col("__gl_n") - 1))).otherwise(0.0)
    return out.withColumn("scaled", scaled).drop("__gl_v", "__gl_upto", "__gl_n")


def wetness_composite(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted mean of bands normalised by their 5th and 95th percentiles."""
    out = df
    for c in weights:
        out = out.crossJoin(F.broadcast(percentiles(df, c, [0.05, 0.95]).withColumnRenamed("q", f"__gl_{c}")))  # one row
    total = F.lit(0.0)
    for c, w in weights.items():
        n = (F.col(c) - F.col(f"__gl_{c}")[0]) / F.nullif(F.col(f"__gl_{c}")[1] - F.col(f"__gl_{c}")[0], F.lit(0.0))
        total = total + F.lit(w) * F.greatest(F.least(F.coalesce(n, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return out.withColumn("wetness", total / sum(weights.values())).drop(*[f"__gl_{c}" for c in weights])


def web_tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Web-mercator tile of a position."""
    n = float(1 << zoom)
    return F.floor((lon + 180.0) / 360.0 * n).cast("int"), F.floor((1.0 - F.log(F.tan(F.radians(lat)) + 1.0 / F.cos(F.radians(lat))) / math.pi) / 2.0 * n).cast("int")


def fill_depressions(dem: np.ndarray) -> np.ndarray:
    """Priority-flood (Barnes et al., 2014): every cell is raised to the lowest level from which it drains to the edge or to a missing cell."""
    import heapq

    h, w = dem.shape
    out, seen, heap = dem.copy(), np.isnan(dem), []
    near = [(r, c) for r, c in square(1) if (r, c) != (0, 0)]
    for r in range(h):
        for c in range(w):
            if not seen[r, c] and (r in (0, h - 1) or c in (0, w - 1) or any(np.isnan(dem[r + a, c + b]) for a, b in near)):
                heapq.heappush(heap, (dem[r, c], r, c))
                seen[r, c] = True
    while heap:
        level, r, c = heapq.heappop(heap)
        for a, b in near:
            i, j = r + a, c + b
            if 0 <= i < h and 0 <= j < w and not seen[i, j]:
                seen[i, j] = True
                out[i, j] = max(out[i, j], level)
                heapq.heappush(heap, (out[i, j], i, j))
    return out


def flow_accumulation(filled: np.ndarray) -> np.ndarray:
    """The number of cells, itself included, that drain through each cell; ties of steepness go to the first of the eight."""
    h, w = filled.shape
    acc = np.where(np.isnan(filled), np.nan, 1.0)
    order = [i for i in np.argsort(-filled, axis=None, kind="stable") if not np.isnan(filled.flat[i])]
    near = [(r, c, math.hypot(r, c)) for r, c in square(1) if (r, c) != (0, 0)]
    for i in order:
        r, c = divmod(int(i), w)
        best, to = 0.0, None
        for a, b, d in near:
            y, x = r + a, c + b
            if 0 <= y < h and 0 <= x < w and not np.isnan(filled[y, x]):
                drop = (filled[r, c] - filled[y, x]) / d
                if drop > best:
                    best, to = drop, (y, x)
        if to:
            acc[to] += acc[r, c]
    return acc


def terrain_tiles(dem: DataFrame, value: str, px: float, size: int, halo: int) -> DataFrame:
    """(row, col, filled, depth, flow, cti): hydrology of haloed tiles, cropped to their cores.

    A tile with its halo is one group; the halo bounds how far flow is followed, as documented for tiled processing.
    """
    t = dem.withColumns({"tr": F.expr(f"row div {size}"), "tc": F.expr(f"col div {size}")})
    o = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    dealt = t.select("row", "col", value, "tr", "tc", o.alias("a")).select("*", o.alias("b")).withColumns({"tr": F.col("tr") + F.col("a"), "tc": F.col("tc") + F.col("b")})
    inside = F.col("row").between(F.col("tr") * size - halo, (F.col("tr") + 1) * size - 1 + halo) & F.col("col").between(F.col("tc") * size - halo, (F.col("tc") + 1) * size - 1 + halo)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(key[0]), int(key[1])
        r0, c0 = int(pdf["row"].min()), int(pdf["col"].min())
        grid = np.full((int(pdf["row"].max()) - r0 + 1, int(pdf["col"].max()) - c0 + 1), np.nan)
        grid[pdf["row"] - r0, pdf["col"] - c0] = pdf[value]
        filled = fill_depressions(grid)
        flow = flow_accumulation(filled)
        level = np.nan_to_num(filled, nan=float(np.nanmedian(filled)) if not np.isnan(filled).all() else 0.0)
        gy = np.gradient(level, px, axis=0) if level.shape[0] > 1 else np.zeros_like(level)
        gx = np.gradient(level, px, axis=1) if level.shape[1] > 1 else np.zeros_like(level)
        slope = np.hypot(gx, gy)
        cti = np.log(np.maximum(flow, px) / np.where(slope <= 1e-6, 1e-3, slope))
        own = pdf[(pdf["row"] // size == tr) & (pdf["col"] // size == tc)]
        at = (own["row"].to_numpy() - r0, own["col"].to_numpy() - c0)
        return pd.DataFrame({"row": own["row"].to_numpy(), "col": own["col"].to_numpy(), "filled": filled[at], "depth": np.maximum(filled[at] - grid[at], 0), "flow": flow[at], "cti": cti[at]}).dropna(subset=["filled"])

    return dealt.where(inside & (F.col("tr") >= 0) & (F.col("tc") >= 0)).groupBy("tr", "tc").applyInPandas(run, "row int, col int, filled double, depth double, flow double, cti double")
