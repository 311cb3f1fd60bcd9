"""Binary morphology on sparse masks (E5-E7): a mask is the set of its pixels (row, col); what isn't there is background."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import GridSpec, diamond, inside, scatter, square


def dilate(mask: DataFrame, n: int = 1, connectivity: int = 8, spec: GridSpec | None = None) -> DataFrame:
    """(row, col) of the mask dilated n times: Chebyshev distance <= n for 8-, Manhattan for 4-connected elements."""
    out = scatter(mask.select("row", "col"), square(n) if connectivity == 8 else diamond(n)).distinct()
    return inside(out, spec) if spec else out


def erode(mask: DataFrame, n: int = 1, connectivity: int = 4, by: list[str] | None = None) -> DataFrame:
    """(row, col) of the mask eroded n times; outside is background. With `by`, each group of these columns is a mask of its own.

    A square is a run of columns by a run of rows, and a cross both at once: neighbours in sorted rows and columns tell whether a run is full. So no pixel
    is copied to its neighbours, and a task holds the sort of its share, which spills, and no table of counts.
    """
    by = by or []
    parts = int(mask.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_row, in_col = Window.partitionBy(*by, "row").orderBy("col"), Window.partitionBy(*by, "col").orderBy("row")

    def full(c: str, w: "Window", k: int) -> Column:
        return F.coalesce((F.lag(c, k).over(w) == F.col(c) - k) & (F.lead(c, k).over(w) == F.col(c) + k), F.lit(False))

    px = mask.select(*by, "row", "col").where("row is not null and col is not null").repartition(parts, *(by or ["row"]))
    px = px.withColumn("__gl_b", F.lag("col").over(in_row)).where("__gl_b is null or __gl_b <> col").drop("__gl_b")
    if n < 1:
        return px
    if connectivity == 8:
        px = px.withColumn("__gl_f", full("col", in_row, n)).where("__gl_f").drop("__gl_f")
        return px.withColumn("__gl_f", full("row", in_col, n)).where("__gl_f").drop("__gl_f")
    for _ in range(n):
        px = px.withColumn("__gl_f", full("col", in_row, 1)).withColumn("__gl_g", full("row", in_col, 1)).where("__gl_f and __gl_g").drop("__gl_f", "__gl_g")
    return px


def opening(mask: DataFrame, connectivity: int = 8) -> DataFrame:
    """Erosion, then dilation, by a 3 x 3 element."""
    return dilate(erode(mask, 1, connectivity), 1, connectivity)
