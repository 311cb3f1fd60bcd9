"""Connected components of pixels, and what is built on them: bridging, hysteresis, sieving, coverage holes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.graph import connected
from ..functions.lineage import cut
from .morphology import dilate


def runs(mask: DataFrame) -> DataFrame:
    """(row, c0, c1, node): maximal horizontal runs of the pixels (row, col, lin) of a mask; node is the first pixel's lin."""
    w = Window.partitionBy("row").orderBy("col")
    new = F.when(F.col("col") == F.lag("col").over(w) + 1, 0).otherwise(1)
    return mask.select("row", "col", "lin").distinct().withColumn("__gl_new", new).withColumn("__gl_g", F.sum("__gl_new").over(w)).groupBy("row", "__gl_g").agg(F.min("col").alias("c0"), F.max("col").alias("c1"), F.min("lin").alias("node")).drop("__gl_g")


def label_patches(mask: DataFrame, connectivity: int = 8) -> DataFrame:
    """`mask` (row, col, lin, ...) with patch_id, the least lin of its component, for 4- or 8-connected pixels.

    Pixels become runs first; runs of neighbouring rows are joined in bins of 64 columns, so the join is an equi-join.
    """
    reach = 1 if connectivity == 8 else 0
    r = cut(runs(mask))
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / 64), F.floor(b / 64)))
    up = r.select("row", "c0", "c1", "node", bins(F.col("c0") - reach, F.col("c1") + reach).alias("bin"))
    down = r.select((F.col("row") - 1).alias("row2"), F.col("c0").alias("d0"), F.col("c1").alias("d1"), F.col("node").alias("b"), bins(F.col("c0"), F.col("c1")).alias("bin2"))
    edges = up.join(down, (F.col("row") == F.col("row2")) & (F.col("bin") == F.col("bin2")) & (F.col("c0") <= F.col("d1") + reach) & (F.col("c1") >= F.col("d0") - reach)).select(F.col("node").alias("a"), "b")
    comps = connected(edges).withColumnRenamed("node", "n")
    labelled = r.join(comps, r.node == comps.n, "left").select("row", "c0", "c1", F.coalesce("component", "node").alias("patch_id"))
    pixels = labelled.select("row", F.explode(F.sequence("c0", "c1")).alias("col"), "patch_id")
    return mask.join(pixels, ["row", "col"])


def bridge(mask: DataFrame, n: int, width: int, connectivity: int = 8) -> DataFrame:
    """Components of the mask dilated n times, given to the original pixels only (E2). patch_id is the least original lin."""
    grown = dilate(mask, n, connectivity).withColumn("lin", F.col("row") * F.lit(width + 4 * n) + F.col("col"))
    wide = label_patches(grown, connectivity).select("row", "col", F.col("patch_id").alias("__gl_c"))
    joined = cut(mask.join(wide, ["row", "col"]))
    return joined.join(joined.groupBy("__gl_c").agg(F.min("lin").alias("patch_id")), "__gl_c").drop("__gl_c")


def hysteresis(px: DataFrame, low: float, high: float, min_size: int = 1, connectivity: int = 8) -> DataFrame:
    """Components of prob >= low that hold a pixel of prob >= high and at least min_size pixels (E3; high = low: E9)."""
    labelled = cut(label_patches(px.where(F.col("prob") >= low), connectivity))
    keep = labelled.groupBy("patch_id").agg(F.max("prob").alias("__gl_top"), F.count("*").alias("__gl_n")).where((F.col("__gl_top") >= high) & (F.col("__gl_n") >= min_size)).select("patch_id")
    return labelled.join(keep, "patch_id", "left_semi")


def sieve(mask: DataFrame, min_pixels: int, connectivity: int = 8) -> DataFrame:
    """Components of at least min_pixels."""
    labelled = cut(label_patches(mask, connectivity))
    return labelled.join(labelled.groupBy("patch_id").count().where(F.col("count") >= min_pixels), "patch_id", "left_semi")


def coverage_holes(footprint: DataFrame, data: DataFrame, pixel_ha: float, min_ha: float = 0.0, top: int = 8) -> DataFrame:
    """(hole_id, pixels, area_ha): the `top` largest 8-connected parts of the footprint that hold no data."""
    holes = label_patches(footprint.join(data.select("row", "col"), ["row", "col"], "left_anti"))
    return holes.groupBy(F.col("patch_id").alias("hole_id")).agg(F.count("*").alias("pixels")).withColumn("area_ha", F.col("pixels") * F.lit(pixel_ha)).where(F.col("area_ha") >= min_ha).orderBy(F.desc("pixels"), "hole_id").limit(top)
