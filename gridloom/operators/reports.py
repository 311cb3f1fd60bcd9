"""Reports over masks, regions and models: hysteresis statistics, region tables, breakdowns, importance lists, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import percentiles


def hysteresis_stats(px: DataFrame, kept: DataFrame, low: float, high: float, pixel_ha: float, bytes_a_pixel: int = 13) -> DataFrame:
    """One row (L9): valid pixels, those over the low and the high threshold, those kept and their components, area, shares, and the memory of the arrays."""
    n = lambda c: F.count(F.when(c, 1))
    a = px.agg(F.count("*").alias("pixels"), F.count("prob").alias("valid"), n(F.col("prob") >= low).alias("low"), n(F.col("prob") >= high).alias("high"))
    b = kept.agg(F.count("*").alias("kept"), F.countDistinct("patch_id").alias("components"))
    return a.crossJoin(F.broadcast(b)).select("pixels", "valid", "low", "high", "kept", "components", (F.col("kept") * F.lit(pixel_ha)).alias("kept_ha"), F.try_divide(100.0 * F.col("kept"), F.col("valid")).alias("kept_pct"), F.try_divide(100.0 * F.col("kept"), F.col("low")).alias("of_low_pct"), (F.col("pixels") * bytes_a_pixel / 1e6).alias("ram_mb"))  # one row each


def region_table(px: DataFrame, patches: DataFrame, neighbours: DataFrame, regions: DataFrame, pixel_ha: float) -> DataFrame:
    """A row for each region (F9): wet pixels on and off peat, shares, patch counts and sizes, mesh, mean nearest distance inside the region; regions without any have zeros.

    px: zone_id, prob, peat, forest; patches: zone_id, area_ha; neighbours: zone_id, nn; regions: zone_id, zone_name.
    """
    wet = F.col("prob") >= 0.5
    n = lambda c: F.count(F.when(c, 1))
    p = px.groupBy("zone_id").agg(F.count("*").alias("pixels"), n(wet).alias("wet"), n(wet & F.col("peat")).alias("wet_on_peat"), n(wet & ~F.col("peat")).alias("wet_off_peat"), n(F.col("forest")).alias("forest"), n(wet & F.col("forest")).alias("wet_forest"))
    a = F.col("area_ha")
    s = patches.groupBy("zone_id").agg(F.count("*").alias("num_patches"), F.sum(a).alias("total_ha"), F.avg(a).alias("mean_ha"), F.max(a).alias("largest_ha"), F.try_divide(F.sum(a * a), F.sum(a)).alias("mesh_ha"))
    d = neighbours.groupBy("zone_id").agg(F.avg("nn").alias("mean_nn"))
    out = regions.select("zone_id", "zone_name").join(p, "zone_id", "left").join(s, "zone_id", "left").join(d, "zone_id", "left")
    out = out.withColumn("wet_ha", F.col("wet") * F.lit(pixel_ha)).withColumn("forest_pct", F.try_divide(100.0 * F.col("wet_forest"), F.col("forest")))
    return out.fillna(0).fillna(0.0)


def peat_counts(px: DataFrame) -> DataFrame:
    """One row of eight counts and their shares (F19): suitable or not, on peat or not, and the four pairs. px: suitable, peat."""
    n = lambda c: F.count(F.when(c, 1))
    s, p = F.col("suitable"), F.col("peat")
    c = px.agg(F.count("*").alias("total"), n(s).alias("suitable"), n(~s).alias("unsuitable"), n(p).alias("on_peat"), n(~p).alias("off_peat"), n(s & p).alias("suitable_on_peat"), n(s & ~p).alias("suitable_off_peat"), n(~s & p).alias("unsuitable_on_peat"), n(~s & ~p).alias("unsuitable_off_peat"))
    pct = lambda a, b: F.try_divide(100.0 * F.col(a), F.col(b))
    return c.select("*", pct("suitable", "total").alias("suitable_pct"), pct("on_peat", "total").alias("peat_pct"), pct("suitable_on_peat", "suitable").alias("of_suitable_on_peat_pct"), pct("suitable_off_peat", "suitable").alias("of_suitable_off_peat_pct"), pct("suitable_on_peat", "on_peat").alias("of_peat_suitable_pct"), pct("suitable_off_peat", "off_peat").alias("of_other_suitable_pct"))


def sectioned(df: DataFrame, value: str, sections: list[str], high: float, distance: str | None = None, within: float = 0.0) -> DataFrame:
    """(section, key, n, mean, median, min, max, high_pct, within_pct) of every section's groups, and of all rows as section 'all' (F20).

    Rows are dealt to their sections by an explode of as many as there are; all sections share one aggregation and one pass of exact medians.
    """
    keys = F.array(F.struct(F.lit("all").alias("section"), F.lit(None).cast("string").alias("key")), *[F.struct(F.lit(s).alias("section"), F.col(s).cast("string").alias("key")) for s in sections])
    each = df.withColumn("__gl_s", F.explode(keys)).select("__gl_s.section", "__gl_s.key", F.col(value).alias("v"), (F.col(distance) if distance else F.lit(None).cast("double")).alias("dist"))
    stats = each.groupBy("section", "key").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), (100.0 * F.avg((F.col("v") >= high).cast("int"))).alias("high_pct"), (100.0 * F.avg((F.col("dist") <= within).cast("int"))).alias("within_pct"))
    q = percentiles(each, "v", [0.5], ["section", "key"]).select(F.col("section").alias("s2"), F.col("key").alias("k2"), F.col("q")[0].alias("median"))
    return stats.join(q, (F.col("section") == F.col("s2")) & F.col("key").eqNullSafe(F.col("k2")), "left").select("section", "key", "n", "mean", "median", "min", "max", "high_pct", "within_pct")


def contributions(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(band, mean_abs, weight): the mean absolute contribution w * (x - mean) of each band of a linear model, the exact Shapley values of independent bands (M7)."""
    means = df.agg(*[F.avg(c).alias(f"__gl_m_{c}") for c in weights])
    a = df.crossJoin(F.broadcast(means)).agg(*[F.avg(F.abs(F.lit(float(w)) * (F.col(c) - F.col(f"__gl_m_{c}")))).alias(c) for c, w in weights.items()])  # one row
    return a.select(F.explode(F.array(*[F.struct(F.lit(c).alias("band"), F.col(c).alias("mean_abs"), F.lit(float(w)).alias("weight")) for c, w in weights.items()])).alias("s")).select("s.*")


def importance_list(importance: DataFrame, value: str, top: int = 20) -> DataFrame:
    """(rank, band, value): the `top` greatest in descending order, ties by name."""
    few = importance.orderBy(F.desc(value), "band").limit(top)
    return few.select(F.row_number().over(Window.orderBy(F.desc(value), "band")).alias("rank"), "band", value)  # at most `top` rows


def provenance(meta: DataFrame, path: str, tag: str) -> DataFrame:
    """`ok` and `reason` of each model: whether the file that its calibration used is the one of its training tag (L7): paths are compared by their last part, without case."""
    base = lambda c: F.lower(F.regexp_extract(F.trim(F.regexp_replace(F.col(c), r"\\", "/")), r"([^/]*)$", 1))
    reason = F.when(F.coalesce(base(tag), F.lit("")) == "", "no training tag").when(F.coalesce(base(path), F.lit("")) == "", "no calibration file").when(base(path) != base(tag), "other file")
    return meta.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())


def independent_validation(positives: DataFrame, negatives: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    """Confusion counts and ratios of positives and negatives (row, col), each once, on scored pixels (row, col, p); pixels without a score, or in both, don't count."""
    from .evaluate import metrics

    both = positives.select("row", "col").distinct().withColumn("y", F.lit(1)).unionByName(negatives.select("row", "col").distinct().withColumn("y", F.lit(0)))
    one = both.groupBy("row", "col").agg(F.min("y").alias("y"), F.count("*").alias("k")).where("k = 1")
    return metrics(one.join(scores.where("p is not null"), ["row", "col"]).withColumn("fold", F.lit(0)), threshold, ["fold"])
