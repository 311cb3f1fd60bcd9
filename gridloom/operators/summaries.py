"""Short aggregations over masks, zones, polygons and layers that reports are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import percentiles


def count_if(c: Column) -> Column:
    return F.count(F.when(c, 1))


def split_area(mask: DataFrame, on: Column, pixel_ha: float) -> DataFrame:
    """One row: the area of a mask on a layer and off it."""
    k = on.cast("int")
    return mask.agg((F.sum(k) * F.lit(pixel_ha)).alias("on_ha"), (F.sum(1 - k) * F.lit(pixel_ha)).alias("off_ha"))


def zone_counts(zoned: DataFrame, zones: DataFrame, zone: str, name: str) -> DataFrame:
    """(zone, name): the rows of each zone, 0 for those without."""
    return zones.select(zone).join(zoned.groupBy(zone).agg(F.count("*").alias(name)), zone, "left").fillna({name: 0})


def zone_areas(zoned: DataFrame, zones: DataFrame, wet: Column, pixel_ha: float) -> DataFrame:
    """(zone_id, zone_name, wet_ha, area_ha) of all zones, zeros for those without a pixel."""
    a = zoned.groupBy("zone_id").agg((F.sum(F.coalesce(wet, F.lit(False)).cast("int")) * pixel_ha).alias("wet_ha"), (F.count("*") * pixel_ha).alias("area_ha"))
    return zones.select("zone_id", "zone_name").join(a, "zone_id", "left").fillna({"wet_ha": 0.0, "area_ha": 0.0})


def zone_density(areas: DataFrame) -> DataFrame:
    """Hectares a square kilometre, NULL for a zone of no area."""
    return areas.select("zone_id", "zone_name", "area_ha", "wet_ha", F.try_divide("wet_ha", F.col("area_ha") / 100).alias("density"))


def counts_with_background(px: DataFrame, zone: str, wet: Column) -> DataFrame:
    """(zone, pixels, wet), zone 0 included (F8)."""
    return px.groupBy(zone).agg(F.count("*").alias("pixels"), count_if(wet).alias("wet"))


def zone_proportions(areas: DataFrame) -> DataFrame:
    """(name, pct, wet_ha), the greatest area first; nameless zones are named by their number."""
    name = F.coalesce("zone_name", F.concat(F.lit("zone "), F.col("zone_id").cast("string")))
    return areas.select(name.alias("name"), F.try_divide(100 * F.col("wet_ha"), F.col("area_ha")).alias("pct"), "wet_ha").orderBy(F.desc_nulls_last("wet_ha"), "name")


def association(mask: DataFrame, on: Column) -> DataFrame:
    """One row: the share of a mask that lies on a layer, in per cent."""
    return mask.agg((100.0 * F.avg(on.cast("int"))).alias("pct"))


def coverage(px: DataFrame, wet: Column, pixel_ha: float, country_km2: float) -> DataFrame:
    """One row: pixels, shares without data and wet, and the wet share of a country's area."""
    n, k = F.count("*"), count_if(wet)
    return px.agg(n.alias("pixels"), (100.0 * count_if(~F.col("valid")) / n).alias("nodata_pct"), F.try_divide(100.0 * k, count_if(F.col("valid"))).alias("wet_pct"), (k * F.lit(pixel_ha) / F.lit(country_km2 * 100.0) * 100).alias("country_pct"))


def polygon_scores(px: DataFrame, key: str, threshold: float = 0.5) -> DataFrame:
    """Of each polygon: truth pixels, those predicted, mean and median probability, recall, whether it was found, and by its mean."""
    z = px.groupBy(key).agg(F.count("*").alias("truth"), count_if(F.col("prob") >= threshold).alias("tp"), F.round(F.avg("prob"), 6).alias("mean_prob"))
    z = z.join(percentiles(px, "prob", [0.5], [key]), key, "left").withColumn("median_prob", F.round(F.col("q")[0], 6)).drop("q")
    return z.select("*", (F.col("truth") - F.col("tp")).alias("fn"), F.round(F.col("tp") / F.col("truth"), 6).alias("recall"), (F.col("tp") > 0).alias("detected"), (F.col("mean_prob") >= threshold).alias("wet_by_mean"))


def polygon_rollup(scores: DataFrame, polygons: DataFrame, least: float) -> DataFrame:
    """One row: mean recall, polygons of at least that recall, found ones, and those without a pixel."""
    r = scores.agg(F.round(F.avg("recall"), 6).alias("m_iou"), count_if(F.col("recall") >= least).alias("n_half"), count_if(F.col("detected")).alias("n_detected"), F.count("*").alias("k"))
    return r.crossJoin(polygons.agg(F.count("*").alias("z"))).select("m_iou", "n_half", "n_detected", (F.col("z") - F.col("k")).alias("n_excluded"))  # one row each


def interior_stats(areas: DataFrame, column: str, small: float) -> DataFrame:
    """One row of statistics of eroded polygons' areas, and how many are below `small` (F32)."""
    q = percentiles(areas, column, [0.25, 0.5, 0.75])
    a = areas.agg(F.count("*").alias("n"), F.avg(column).alias("mean"), F.min(column).alias("min"), F.max(column).alias("max"), count_if(F.round(column, 6) < small).alias("below"))
    return a.crossJoin(F.broadcast(q)).select("n", F.col("q")[1].alias("median"), "mean", "min", "max", F.col("q")[0].alias("q25"), F.col("q")[2].alias("q75"), "below")  # one row each


def false_positives(df: DataFrame, by: str, threshold: float) -> DataFrame:
    """(by, n, fp, fp_pct) of negatives: how many each original class has over the threshold."""
    fp = count_if(F.col("p") > threshold)
    return df.where("y = 0").groupBy(by).agg(F.count("*").alias("n"), fp.alias("fp"), (100.0 * fp / F.count("*")).alias("fp_pct"))


def distribution(df: DataFrame, *by: str) -> DataFrame:
    """(by..., n)."""
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def background(px: DataFrame, taken: list[DataFrame]) -> DataFrame:
    """Valid pixels that none of the layers takes (C14)."""
    out = px.where("valid")
    for t in taken:
        out = out.join(t.select("row", "col"), ["row", "col"], "left_anti")
    return out


def merge_greatest(layers: list[tuple[DataFrame, int]]) -> DataFrame:
    """(row, col, code): of overlapping layers the greatest code."""
    out = None
    for df, code in layers:
        one = df.select("row", "col", F.lit(code).alias("code"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("row", "col").agg(F.max("code").alias("code"))


def mask_algebra(keep: DataFrame, within: DataFrame, without: DataFrame, always: DataFrame, key: str) -> DataFrame:
    """((keep and within) but not without) or always, as sets of a key."""
    return keep.select(key).intersect(within.select(key)).subtract(without.select(key)).union(always.select(key)).distinct()


def expanded(seed: Column, ratio: Column, least: float = 0.01) -> Column:
    """The expansion threshold of a seed threshold: seed * ratio, `least` below the seed at most, and `least` at the least (L3)."""
    return F.greatest(F.lit(least), F.least(seed * ratio, seed - least))


def top_rows(df: DataFrame, value: str, key: str, n: int) -> DataFrame:
    """The n greatest rows of a report with their rank, ties by key (G1): a top-k, then a window over its n rows."""
    few = df.orderBy(F.desc(value), key).limit(n)
    return few.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), key)))
