"""Euclidean distance transforms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import GridSpec, disc, inside, scatter

#: Rows of pixels that one task brings to their envelopes at a time.
BAND = 128


def distance_capped(grid: DataFrame, seeds: DataFrame, spec: GridSpec, cap: float) -> DataFrame:
    """(row, col, dist) of all pixels of the grid: metres to the nearest seed, `cap` where none is that near."""
    k = cap / spec.px
    offsets = [(r, c, float(np.hypot(r, c) * spec.px)) for r, c in disc(k)]
    near = inside(scatter(seeds.select("row", "col"), offsets, ("dr", "dc", "d")), spec).groupBy("row", "col").agg(F.min("d").alias("d"))
    return grid.select("row", "col").join(near, ["row", "col"], "left").select("row", "col", F.coalesce("d", F.lit(float(cap))).alias("dist"))


def distance_full(grid: DataFrame, seeds: DataFrame, spec: GridSpec) -> DataFrame:
    """(row, col, dist) of the pixels of `grid`, which may be some only: exact, without a cap; NULL if there is no seed.

    Two passes. Columns: every seed row gives each of its column's rows the vertical distance to the nearest seed, one group a column, whose rows leave it as arrays of a band.
    Rows: the lower envelope of the parabolas of a row's columns (Felzenszwalb and Huttenlocher, 2012), for a band of `BAND` rows at a time, whose
    columns are the same. A group is a column, or a band of rows with its pixels of the grid, whatever the raster's size; no distance becomes a row but the grid's.
    """
    height, width, px = spec.height, spec.width, spec.px

    def vertical(t: pa.Table) -> pa.Table:
        rows = np.unique(t.column("row").to_numpy())
        all_rows = np.arange(-(-height // BAND) * BAND)  # a whole number of bands
        at = np.searchsorted(rows, all_rows)
        up = np.abs(all_rows - rows[np.maximum(at - 1, 0)])
        down = np.abs(rows[np.minimum(at, len(rows) - 1)] - all_rows)
        g = np.minimum(up, down).astype(np.int64)
        bands = np.arange(len(g) // BAND)
        lists = pa.ListArray.from_arrays(pa.array(np.append(bands * BAND, len(g)).astype(np.int32)), pa.array(g))
        return pa.table({"band": bands, "col": pa.array(np.full(len(bands), t.column("col")[0].as_py()), pa.int32()), "g": lists})

    def envelope(q: np.ndarray, f: np.ndarray) -> np.ndarray:
        """(rows, width): distances of a band whose columns `q`, in order, have the squared vertical distances `f`."""
        n, every = len(f), np.arange(len(f))
        v, z, k = np.zeros((n, len(q)), np.int64), np.full((n, len(q) + 1), np.inf), np.zeros(n, np.int64)
        z[:, 0] = -np.inf
        for i in range(1, len(q)):
            s, open_ = np.empty(n), every
            while len(open_):
                j = v[open_, k[open_]]
                s[open_] = ((f[open_, i] + q[i] ** 2) - (f[open_, j] + q[j] ** 2)) / (2 * q[i] - 2 * q[j])
                open_ = open_[s[open_] <= z[open_, k[open_]]]
                k[open_] -= 1
            k += 1
            v[every, k], z[every, k] = i, s
            z[every, np.minimum(k + 1, len(q))] = np.inf
        x = np.arange(width)
        own = np.stack([v[r, np.searchsorted(z[r, 1 : k[r] + 1], x, "left")] for r in range(n)])
        return np.sqrt((x[None, :] - q[own]) ** 2 + np.take_along_axis(f, own, 1)) * px

    def read(cells: pa.Table, columns: pa.Table) -> pa.Table:
        row, col = (pc.fill_null(cells.column(c), -1).to_numpy() for c in ("row", "col"))
        dist, known = np.zeros(len(row)), np.zeros(len(row), bool)
        if len(row) and columns.num_rows:
            order = np.argsort(columns.column("col").to_numpy())
            f = np.stack(columns.column("g").combine_chunks().flatten().to_numpy().reshape(-1, BAND)[order], 1).astype(np.float64) ** 2
            r = row % BAND
            known = (row >= 0) & (row < height) & (col >= 0) & (col < width)
            some = np.unique(r[known])
            d = envelope(columns.column("col").to_numpy()[order].astype(np.float64), f[some])
            dist[known] = d[np.searchsorted(some, r[known]), col[known]]
        return pa.table({"row": cells.column("row"), "col": cells.column("col"), "dist": pa.array(dist, mask=~known)})

    columns = seeds.where("row is not null and col is not null").select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).groupBy("col").applyInArrow(vertical, "band long, col int, g array<bigint>")
    pixels = grid.select(F.floor(F.col("row") / BAND).alias("band"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))
    return pixels.groupBy("band").cogroup(columns.groupBy("band")).applyInArrow(read, "row int, col int, dist double")
