"""Per-pixel filters, projections and masks (section D)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import to_null
from ..functions.quantiles import percentiles


def normalise_probability(df: DataFrame, value: str, valid: str = "valid") -> DataFrame:
    """value / 255 if the greatest valid value is over 1 + 1e-6, else as it is; NULL where not valid (D-15)."""
    top = df.where(valid).agg(F.max(value).alias("__gl_top"))
    return df.crossJoin(F.broadcast(top)).withColumn("p", F.when(F.col(valid), F.when(F.col("__gl_top") > 1 + 1e-6, F.col(value) / 255.0).otherwise(F.col(value)))).drop("__gl_top")


def all_finite(features: Column, nodata: float | None = None) -> Column:
    """Whether no component of a vector is missing (D-16)."""
    return features.isNotNull() & F.forall(features, lambda v: F.coalesce(to_null(v.cast("double"), nodata).isNotNull(), F.lit(False)))


def exclude_features(features: Column, drop: list[int]) -> Column:
    """The vector without the components of these places (D-17)."""
    return F.filter(features, lambda _, i: ~i.isin(drop))


def height_screen(df: DataFrame, height: str, cover: str, min_height: float = 3.0, min_cover: float = 0.15) -> DataFrame:
    """Rows whose canopy height and cover are known and high enough (D-1)."""
    return df.where((to_null(F.col(height)) >= min_height) & (to_null(F.col(cover)) >= min_cover))


def canopy_cover(df: DataFrame, height: str, factor: int, min_height: float = 3.0, min_cover: float = 0.15) -> DataFrame:
    """(brow, bcol, cover, woodland) of blocks: the share of pixels with max(height, 0) >= min_height (D-2)."""
    hit = (F.greatest(F.col(height), F.lit(0.0)) >= min_height).cast("int")
    cells = df.groupBy(F.expr(f"row div {factor}").cast("int").alias("brow"), F.expr(f"col div {factor}").cast("int").alias("bcol")).agg(F.avg(hit).alias("cover"))
    return cells.withColumn("woodland", F.col("cover") >= min_cover)


def hole_mask(footprint: DataFrame, covered: DataFrame) -> DataFrame:
    """Pixels of the footprint that aren't covered (D-3)."""
    return footprint.join(covered.select("row", "col"), ["row", "col"], "left_anti")


def mask_out(df: DataFrame, mask: DataFrame, column: str, fill: object = 0) -> DataFrame:
    """`column` set to `fill` inside the mask; the valid mask is a column of its own and stays (D-6)."""
    m = mask.select("row", "col").distinct().withColumn("__gl_m", F.lit(True))
    return df.join(m, ["row", "col"], "left").withColumn(column, F.when(F.col("__gl_m"), F.lit(fill)).otherwise(F.col(column))).drop("__gl_m")


def clip_to(df: DataFrame, cover: DataFrame) -> DataFrame:
    """Pixels inside the cover; for a negative buffer give it an eroded cover (D-7)."""
    return df.join(cover.select("row", "col").distinct(), ["row", "col"], "left_semi")


def any_mask(df: DataFrame, value: str, masks: list[Column]) -> DataFrame:
    """`value` NULL where any mask holds, and `masked` for the pixels that lose one by it (D-8)."""
    hit = F.greatest(*[F.coalesce(m.cast("int"), F.lit(0)) for m in masks]) if len(masks) > 1 else F.coalesce(masks[0].cast("int"), F.lit(0))
    return df.withColumn("masked", ((hit == 1) & F.col(value).isNotNull()).cast("int")).withColumn(value, F.when(hit == 0, F.col(value)))


def sanitise(c: Column, limit: float = 1e10) -> Column:
    """NULL for what isn't finite, the rest clipped to +- limit (D-9)."""
    v = to_null(c)
    return F.when(v.isNotNull(), F.greatest(F.least(v, F.lit(limit)), F.lit(-limit)))


def terrain_source(mode: str, sources: dict[str, DataFrame], fallback: str = "global") -> DataFrame:
    """The terrain table of a mode, without case; the fallback where the mode has none (D-5)."""
    names = {k.lower(): v for k, v in sources.items()}
    return names.get(mode.strip().lower(), names[fallback])


def winsorise(df: DataFrame, columns: list[str], low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Columns clipped to their exact percentiles (D-10)."""
    out = df
    for c in columns:
        out = out.crossJoin(F.broadcast(percentiles(df, c, [low, high]).withColumnRenamed("q", f"__gl_b_{c}")))  # one row
    return out.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.col(f"__gl_b_{c}")[1]), F.col(f"__gl_b_{c}")[0])) for c in columns}).drop(*[f"__gl_b_{c}" for c in columns])


def known_category(df: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """Categories that training didn't see become the least known one (D-10). `known` has one column of the same name."""
    k = known.select(F.col(column).alias("__gl_k")).where("__gl_k is not null").distinct()
    first = k.agg(F.min("__gl_k").alias("__gl_first"))
    return df.join(k, df[column] == F.col("__gl_k"), "left").crossJoin(F.broadcast(first)).withColumn(column, F.coalesce("__gl_k", "__gl_first")).drop("__gl_k", "__gl_first")


def collapse_classes(df: DataFrame, column: str) -> DataFrame:
    """1 for classes >= 2 if any class is over 1; a mask of 0 and 1 stays (D-11)."""
    top = df.agg(F.max(column).alias("__gl_top"))
    return df.crossJoin(F.broadcast(top)).withColumn(column, F.when(F.col("__gl_top") > 1, (F.col(column) >= 2).cast("int")).otherwise(F.col(column))).drop("__gl_top")


def seed_mask(columns: list[str], kind: str, threshold: float | None) -> Column:
    """Presence seeds: with a threshold the second band (else the first) >= it; without, integers = 1, floats > 0.5 (D-12)."""
    band = F.col(columns[1] if len(columns) > 1 and threshold is not None else columns[0])
    hit = band >= threshold if threshold is not None else (band == 1 if kind == "int" else band > 0.5)
    return F.coalesce(hit, F.lit(False))


def peat_extent(depth: Column | None, prob: Column | None) -> Column:
    """Depth over 0, or probability of 0.5 and more (D-13)."""
    return F.coalesce(depth > 0, F.lit(False)) if depth is not None else F.coalesce(prob >= 0.5, F.lit(False))


def depth_metres(c: Column) -> Column:
    """Centimetres to metres; missing is 0 (D-21)."""
    return F.coalesce(c / 100.0, F.lit(0.0))
