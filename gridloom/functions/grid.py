"""Grid geometry: pixels, blocks, offsets. A raster is a long table of (row, col, ...) with a GridSpec beside it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GridSpec:
    """A north-up grid in planar metres; (ox, oy) is its upper left corner."""

    ox: float
    oy: float
    px: float
    width: int
    height: int

    @property
    def pixel_ha(self) -> float:
        return self.px * self.px / 10_000.0

    def x(self, col: Column) -> Column:
        return F.lit(self.ox) + (col + F.lit(0.5)) * F.lit(self.px)

    def y(self, row: Column) -> Column:
        return F.lit(self.oy) - (row + F.lit(0.5)) * F.lit(self.px)

    def col(self, x: Column) -> Column:
        return F.floor((x - F.lit(self.ox)) / F.lit(self.px)).cast("int")

    def row(self, y: Column) -> Column:
        return F.floor((F.lit(self.oy) - y) / F.lit(self.px)).cast("int")

    def snapped(self, res: float, bounds: tuple[float, float, float, float]) -> GridSpec:
        """The grid of resolution `res` that covers bounds (xmin, ymin, xmax, ymax), snapped outward to multiples of `res` from this origin."""
        from math import ceil, floor

        x0, y0, x1, y1 = bounds
        c0, c1 = floor((x0 - self.ox) / res), ceil((x1 - self.ox) / res)
        r0, r1 = floor((self.oy - y1) / res), ceil((self.oy - y0) / res)
        return GridSpec(self.ox + c0 * res, self.oy - r0 * res, res, c1 - c0, r1 - r0)

    def aligned(self, other: GridSpec) -> bool:
        return self == other


def to_null(c: Column, nodata: float | None = None) -> Column:
    """Missing values are NULL from here on: NaN, infinities and the nodata value. (NaN >= t is true in Spark.)"""
    ok = ~F.isnan(c) & (F.abs(c) < F.lit(1.7e308))
    return F.when(ok & (c != F.lit(nodata)) if nodata is not None else ok, c)


def square(k: int) -> list[tuple[int, int]]:
    """Offsets of Chebyshev distance <= k."""
    return [(r, c) for r in range(-k, k + 1) for c in range(-k, k + 1)]


def diamond(k: int) -> list[tuple[int, int]]:
    """Offsets of Manhattan distance <= k."""
    return [(r, c) for r, c in square(k) if abs(r) + abs(c) <= k]


def disc(k: float) -> list[tuple[int, int]]:
    """Offsets of Euclidean distance <= k."""
    return [(r, c) for r, c in square(int(k)) if r * r + c * c <= k * k]


def scatter(df: DataFrame, offsets: list[tuple], names: tuple[str, ...] = ("dr", "dc")) -> DataFrame:
    """Every row once for each offset, with row and col moved by it; further members of an offset become the columns in `names`."""
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, o, strict=True)]) for o in offsets])
    out = df.withColumn("__gl_o", F.explode(table))
    return out.withColumns({"row": F.col("row") + F.col("__gl_o.dr"), "col": F.col("col") + F.col("__gl_o.dc")} | {n: F.col(f"__gl_o.{n}") for n in names[2:]}).drop("__gl_o")


def inside(df: DataFrame, spec: GridSpec) -> DataFrame:
    return df.where(F.col("row").between(0, spec.height - 1) & F.col("col").between(0, spec.width - 1))


def resolve_column(columns: list[str], wanted: str | None, candidates: list[str]) -> str | None:
    """A column by its role: the wanted name exactly, then without case, then the first candidate without case; else None."""
    lower = {c.lower(): c for c in reversed(columns)}
    if wanted is not None:
        return wanted if wanted in columns else lower.get(wanted.lower())
    return next((lower[c.lower()] for c in candidates if c.lower() in lower), None)
