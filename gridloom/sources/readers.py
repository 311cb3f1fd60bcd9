"""Sources and sinks: Parquet, CSV and JSON scans with missing values as NULL, tile sets, mosaics, tile windows."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import GridSpec, to_null


def read_raster(spark: SparkSession, path: str, nodata: float | None = None, value: str = "value") -> DataFrame:
    """A pixel table with missing values as NULL and a `valid` column (A3)."""
    df = spark.read.parquet(path)
    return df.withColumn(value, to_null(F.col(value).cast("double"), nodata)).withColumn("valid", F.col(value).isNotNull())


def binary_raster(df: DataFrame, threshold: float | None = None, value: str = "prob", valid: str = "valid") -> DataFrame:
    """1 / 0 with the valid mask kept beside it: v >= threshold, or v > 0.5 without one (A1)."""
    hit = F.col(value) >= threshold if threshold is not None else F.col(value) > 0.5
    return df.withColumn("mask", F.when(F.col(valid) & hit, 1).otherwise(0))


def three_valued(df: DataFrame, threshold: float, value: str) -> DataFrame:
    """1 / 0 / NULL; a probability outside [0, 1] is missing (A2, A4)."""
    p = probability(F.col(value))
    return df.withColumn("mask", F.when(p.isNotNull(), (p >= threshold).cast("int")))


def probability(c: Column) -> Column:
    v = to_null(c)
    return F.when(v.between(0.0, 1.0), v)


def probability_band(df: DataFrame, bands: list[str]) -> str:
    """The second band if there is one, else the first (A5)."""
    have = [b for b in bands if b in df.columns]
    return have[1] if len(have) > 1 else have[0]


def collect_tiles(spark: SparkSession, folder: str, glob: str = "*.parquet") -> DataFrame:
    """All tiles of a folder with their file names."""
    return spark.read.option("pathGlobFilter", glob).parquet(folder).withColumn("tile_file", F.col("_metadata.file_name"))


def load_tiles(tiles: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """Features, labels and coordinates of the wanted tiles (tile_id) in one table: a scan of all of them, each once."""
    return tiles.join(wanted.select("tile_id").distinct(), "tile_id", "left_semi").select("tile_id", "row", "col", *columns)


def union_mosaic(tiles: DataFrame, bounds: tuple[int, int, int, int] | None = None, mask: DataFrame | None = None) -> DataFrame:
    """The first valid value of each pixel over the union of the tiles' extents; cropped to (row0, row1, col0, col1), or to the box of a mask."""
    out = tiles.groupBy("row", "col").agg(F.min_by("value", F.when(F.col("value").isNotNull(), F.col("tile_id"))).alias("value"))
    if mask is not None:
        box = mask.agg(F.min("row").alias("__gl_r0"), F.max("row").alias("__gl_r1"), F.min("col").alias("__gl_c0"), F.max("col").alias("__gl_c1"))
        out = out.crossJoin(F.broadcast(box)).where("row between __gl_r0 and __gl_r1 and col between __gl_c0 and __gl_c1").select("row", "col", "value")  # one row
    if bounds is not None:
        out = out.where(F.col("row").between(*bounds[:2]) & F.col("col").between(*bounds[2:]))
    return out


def tile_position(name: Column) -> tuple[Column, Column]:
    """(x, y) of a file name that ends in -X-Y.suffix, NULL where it doesn't."""
    pick = lambda g: F.when(F.regexp_extract(name, r"-(\d+)-(\d+)\.\w+$", g) != "", F.regexp_extract(name, r"-(\d+)-(\d+)\.\w+$", g).cast("int"))
    return pick(1), pick(2)


def mosaic(tiles: DataFrame, tile: str = "tile_id", last: bool = False) -> DataFrame:
    """One value a pixel: of overlapping tiles the first, in tile order, that has a valid value; with `last`, the last."""
    keyed = tiles.where("value is not null").groupBy("row", "col")
    pick = F.max_by if last else F.min_by
    return keyed.agg(pick("value", tile).alias("value"), pick(tile, tile).alias(tile))


def validate_inputs(meta: DataFrame) -> DataFrame:
    """(path, reason): reason is NULL for accepted files of (path, bands, crs); the first CRS in path order is the rule."""
    first = meta.where("bands = 1 and crs is not null").agg(F.min_by("crs", "path").alias("first_crs"))
    return meta.crossJoin(F.broadcast(first)).select("path", F.when(F.col("bands") != 1, "bands").when(F.col("crs").isNull(), "no crs").when(F.col("crs") != F.col("first_crs"), "other crs").alias("reason"))


def tile_windows(spark: SparkSession, spec: GridSpec, size: int, halo: int) -> DataFrame:
    """Core and haloed windows (inclusive bounds) of all tiles, clamped to the grid."""
    rows, cols = -(-spec.height // size), -(-spec.width // size)
    t = spark.range(rows * cols).select((F.col("id") / cols).cast("int").alias("tr"), (F.col("id") % cols).cast("int").alias("tc"))
    lo = lambda k, pad: F.greatest(F.col(k) * size - pad, F.lit(0)).cast("int")
    hi = lambda k, n, pad: F.least((F.col(k) + 1) * size - 1 + pad, F.lit(n - 1)).cast("int")
    return t.select("tr", "tc", lo("tr", 0).alias("r0"), hi("tr", spec.height, 0).alias("r1"), lo("tc", 0).alias("c0"), hi("tc", spec.width, 0).alias("c1"), lo("tr", halo).alias("hr0"), hi("tr", spec.height, halo).alias("hr1"), lo("tc", halo).alias("hc0"), hi("tc", spec.width, halo).alias("hc1"))


def read_ranked(spark: SparkSession, path: str, n: int, required: list[str]) -> DataFrame:
    """The first n rows by `rank` of a CSV file that has the required columns."""
    df = spark.read.option("header", True).schema("rank int, area_ha double, bng_easting int, bng_northing int, region_name string").csv(path)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df.orderBy("rank").limit(n)


def vertices(df: DataFrame) -> DataFrame:
    """Polygons of a vector table (id, geom_type, parts array<array<struct<x,y>>>), exploded to single parts (A10, D-18, D-20)."""
    return df.where(F.col("geom_type").isin("Polygon", "MultiPolygon")).select("*", F.posexplode("parts").alias("part", "ring")).drop("parts")


def concat_layers(layers: dict[str, DataFrame]) -> DataFrame:
    """All layers below each other with source_layer; columns that a layer lacks are NULL."""
    out = None
    for name in layers:
        one = layers[name].withColumn("source_layer", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def sample_cache(df: DataFrame, folder: str, *keys: str) -> DataFrame:
    """`df`, kept as Parquet below `folder` under the md5 of the keys; read from there if it is there."""
    import hashlib

    path = f"{folder}/{hashlib.md5('|'.join(keys).encode()).hexdigest()}"
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_tiles(df: DataFrame, path: str, size: int = 256) -> None:
    """Parquet, one folder for each tile row, clustered by tile so that row-group statistics prune windows."""
    t = df.withColumn("tile_row", F.floor(F.col("row") / size).cast("int")).withColumn("tile_col", F.floor(F.col("col") / size).cast("int"))
    t.repartition("tile_row", "tile_col").sortWithinPartitions("tile_row", "tile_col", "row", "col").write.mode("overwrite").partitionBy("tile_row").parquet(path)


def export(df: DataFrame, path: str) -> None:
    """A table as CSV, JSON or Parquet, by the path's suffix."""
    kind = PurePosixPath(path).suffix.lower()
    writers = {".csv": lambda w: w.option("header", True).csv(path), ".json": lambda w: w.json(path), ".geojson": lambda w: w.json(path), ".parquet": lambda w: w.parquet(path)}
    if kind not in writers:
        raise ValueError(f"no writer for {kind or path!r}")
    writers[kind](df.write.mode("overwrite"))


def report(summary: DataFrame, title: str) -> str:
    """A one-row summary as text of fixed layout."""
    row = summary.first()
    if row is None:
        return f"{title}\n(no data)\n"
    wide = max(map(len, summary.columns))
    lines = [f"{k.ljust(wide)}  {'-' if v is None else f'{v:,.4f}' if isinstance(v, float) else v}" for k, v in row.asDict().items()]
    return "\n".join([title, "=" * len(title), *lines, ""])


def manifest(summary: DataFrame) -> str:
    """A one-row summary as a JSON object (B2)."""
    row = summary.first()
    return json.dumps({} if row is None else row.asDict(), default=str, sort_keys=True)


def scatter_to_grid(grid: DataFrame, points: DataFrame, column: str) -> DataFrame:
    """The grid's pixels with the points' class, NULL where there is none; of points in one pixel the greatest class."""
    one = points.groupBy("row", "col").agg(F.max(column).alias(column))
    return grid.select("row", "col").join(one, ["row", "col"], "left")

