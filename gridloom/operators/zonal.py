"""Aggregations over patches, zones and blocks (section F)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import percentiles

BANDS = [("le_001", 0.0, 0.01), ("001_01", 0.01, 0.1), ("01_1", 0.1, 1.0), ("1_5", 1.0, 5.0), ("5_10", 5.0, 10.0), ("ge_10", 10.0, None)]


def size_band(area: Column) -> Column:
    """The size band of an area in hectares: <= .01, (.01, .1), [.1, 1), [1, 5), [5, 10), >= 10."""
    return F.when(area <= 0.01, "le_001").when(area < 0.1, "001_01").when(area < 1.0, "01_1").when(area < 5.0, "1_5").when(area < 10.0, "5_10").otherwise("ge_10")


def patch_metrics(labelled: DataFrame, pixel_ha: float) -> DataFrame:
    """(patch_id, pixel_count, area_ha, centroid_x, centroid_y) (F1)."""
    return labelled.groupBy("patch_id").agg(F.count("*").alias("pixel_count"), F.avg("x").alias("centroid_x"), F.avg("y").alias("centroid_y")).withColumn("area_ha", F.col("pixel_count") * F.lit(pixel_ha))


def size_summary(patches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and areas by size band, mean, median and modal size (F2, F3). The mode is of areas rounded half-even to 0.1, the least of ties."""
    b = size_band(F.col("area_ha"))
    aggs = [F.count("*").alias("num_patches"), F.sum("area_ha").alias("total_ha"), F.avg("area_ha").alias("mean_ha"), F.percentile("area_ha", F.lit(0.5)).alias("median_ha"), F.max("area_ha").alias("largest_ha"), F.mode(F.bround("area_ha", 1), True).alias("modal_ha")]
    for name, _, _ in BANDS:
        aggs += [F.sum((b == name).cast("int")).alias(f"patches_{name}"), F.sum(F.when(b == name, F.col("area_ha")).otherwise(0.0)).alias(f"area_{name}")]
    return (patches.groupBy(*by) if by else patches.groupBy()).agg(*aggs)


def landscape_division(patches: DataFrame) -> DataFrame:
    """Division index, effective mesh, largest share and the share of the largest tenth.

    The tenth is found by area classes: areas are counted by value, so no global sort of patches takes place in one task.
    """
    tot = patches.agg(F.count("*").alias("n"), F.sum("area_ha").alias("a"), F.sum(F.col("area_ha") * F.col("area_ha")).alias("a2"), F.max("area_ha").alias("top"))
    sizes = patches.groupBy("area_ha").agg(F.count("*").alias("k"))
    w = Window.orderBy(F.desc("area_ha")).rowsBetween(Window.unboundedPreceding, -1)
    # different areas are multiples of a pixel: few, whatever the number of patches
    share = sizes.withColumn("before", F.coalesce(F.sum("k").over(w), F.lit(0))).crossJoin(F.broadcast(tot.select(F.greatest(F.lit(1), F.floor(F.col("n") * 0.1)).alias("m"))))
    tenth = share.agg(F.sum(F.greatest(F.lit(0), F.least(F.col("k"), F.col("m") - F.col("before"))) * F.col("area_ha")).alias("tenth"))
    return tot.crossJoin(tenth).select((1 - F.col("a2") / (F.col("a") * F.col("a"))).alias("division"), (F.col("a2") / F.col("a")).alias("mesh_ha"), (100 * F.col("top") / F.col("a")).alias("largest_pct"), (100 * F.col("tenth") / F.col("a")).alias("top_tenth_pct"))


def majority(pixels: DataFrame, group: str, region: str) -> DataFrame:
    """(group, region, pixels): the region that most pixels of a group lie in; ties: the least; none: -1."""
    counts = pixels.where(F.col(region).isNotNull()).groupBy(group, region).agg(F.count("*").alias("pixels"))
    best = counts.groupBy(group).agg(F.max_by(region, F.struct("pixels", -F.col(region))).alias(region), F.max("pixels").alias("pixels"))
    return pixels.select(group).distinct().join(best, group, "left").fillna({region: -1, "pixels": 0})


def block_density(mask: DataFrame, factor: int, height: int, width: int, pixel_ha: float) -> DataFrame:
    """(brow, bcol, ha_per_km2) of full factor x factor blocks; partial blocks at the edges are dropped."""
    km2 = factor * factor * pixel_ha / 100.0
    b = mask.withColumns({"brow": F.expr(f"row div {factor}").cast("int"), "bcol": F.expr(f"col div {factor}").cast("int")})
    return b.where((F.col("brow") < height // factor) & (F.col("bcol") < width // factor)).groupBy("brow", "bcol").agg((F.sum("wet") * F.lit(pixel_ha) / F.lit(km2)).alias("ha_per_km2"))


def zone_stats(df: DataFrame, value: str, by: list[str] | None = None, quantiles: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """n, mean, min, max and exact percentiles."""
    by = by or []
    whole = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    q = percentiles(df, value, list(quantiles), by).withColumnsRenamed({c: f"__gl_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__gl_{c}"))
    return whole.join(q, same, "left").select(*by, "n", "mean", "min", "max", *[F.col("q")[i].alias(f"p{round(p * 100):02d}") for i, p in enumerate(quantiles)])


def tow_class(area_m2: Column, height_share: Column, coverage: float = 0.5) -> Column:
    """Lone 5-350, Group (350, 1000], Small over 1000 m2, of patches high enough in a share of their pixels."""
    return F.when(height_share < coverage, "fail").when(area_m2.between(5.0, 350.0), "Lone").when((area_m2 > 350.0) & (area_m2 <= 1000.0), "Group").when(area_m2 > 1000.0, "Small").otherwise("none")


def slice_stats(df: DataFrame, by: list[str]) -> DataFrame:
    """Mean and sample deviation of time slices; n = 1 gives no deviation."""
    return df.groupBy(*by).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def vif(df: DataFrame, columns: list[str]) -> DataFrame:
    """(band, vif): the diagonal of the inverse correlation matrix, infinite (NULL) from R2 = .9999 on.

    One aggregation gives all sums; the matrix, as wide as there are bands, is inverted on the driver.
    """
    import numpy as np

    k = len(columns)
    row = df.dropna(subset=columns).agg(*[F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]).first()
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    sd = np.sqrt(np.where(np.diag(cov) > 0, np.diag(cov), 1.0))
    inv = np.diag(np.linalg.pinv(cov / np.outer(sd, sd)))
    out = [(c, None if 1 - 1 / max(v, 1e-12) >= 0.9999 else float(v)) for c, v in zip(columns, inv, strict=True)]
    return df.sparkSession.createDataFrame(out, "band string, vif double")
