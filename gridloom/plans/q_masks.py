"""Queries of sections A, B and D."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import masks as M
from ..sources import readers as R
from ..sources import views as V
from ..sources.views import sql
from .base import query, spec

S = SparkSession
PEAT = "(row+col)%7<3"


@query(sql("SELECT lin, CASE WHEN valid AND prob>=0.5 THEN 1 ELSE 0 END AS mask, valid FROM px", "px"))
def binary_mask(spark: S, d: str) -> DataFrame:
    return R.binary_raster(V.px(spark, d), 0.5).select("lin", "mask", "valid")


@query(sql("SELECT lin, CASE WHEN raw/50.0 BETWEEN 0 AND 1 THEN (raw/50.0>=0.5)::INTEGER END AS mask FROM px", "px"))
def three_valued_mask(spark: S, d: str) -> DataFrame:
    return R.three_valued(V.px(spark, d).withColumn("v", F.col("raw") / 50.0), 0.5, "v").select("lin", "mask")


@query(sql("SELECT lin, CASE WHEN raw BETWEEN 0 AND 100 AND etype<>'error' THEN raw END AS value, raw BETWEEN 0 AND 100 AND etype<>'error' AS valid FROM px", "px"))
def raster_float(spark: S, d: str) -> DataFrame:
    from ..functions.grid import to_null

    p = V.px(spark, d).select("lin", F.when(F.col("raw").between(0, 100) & F.col("valid"), F.col("raw")).otherwise(F.lit(-9999.0)).alias("v"))
    return p.select("lin", to_null(F.col("v"), -9999.0).alias("value")).withColumn("valid", F.col("value").isNotNull())


@query(sql("SELECT row, col, arg_min(value, tile_id) AS value, min(tile_id) AS tile_id FROM (SELECT row, col, raw+t AS value, (row//25)*1000+(col+t*2)//25+t*100 AS tile_id FROM px, (VALUES (0),(1)) v(t) WHERE valid AND (t=0 OR col%25<2)) GROUP BY row, col", "px"))
def mosaic_first_wins(spark: S, d: str) -> DataFrame:
    p = V.px(spark, d).where("valid").withColumn("t", F.explode(F.array(F.lit(0), F.lit(1)))).where("t = 0 or col % 25 < 2")
    tiles = p.selectExpr("row", "col", "raw + t as value", "(row div 25) * 1000 + (col + t * 2) div 25 + t * 100 as tile_id")
    return R.mosaic(tiles).select("row", "col", "value", "tile_id")


@query(sql("SELECT 's_' || n_nationkey || '.tif' AS path, CASE WHEN n_nationkey%5=4 THEN 'bands' WHEN n_nationkey%7=3 THEN 'no crs' WHEN n_nationkey%3=2 THEN 'other crs' END AS reason FROM nation"))
def validate_inputs(spark: S, d: str) -> DataFrame:
    meta = V.table(spark, d, "nation").selectExpr("concat('s_', n_nationkey, '.tif') as path", "case when n_nationkey % 5 = 4 then 2 else 1 end as bands", "case when n_nationkey % 7 = 3 then null when n_nationkey % 3 = 2 then 'b' else 'a' end as crs")
    return R.validate_inputs(meta)


@query(sql("SELECT tr::INTEGER AS tr, tc::INTEGER AS tc, (tr*25)::INTEGER AS r0, least(tr*25+24,h-1)::INTEGER AS r1, (tc*30)::INTEGER AS c0, least(tc*30+29,99)::INTEGER AS c1, greatest(tr*25-2,0)::INTEGER AS hr0, least(tr*25+26,h-1)::INTEGER AS hr1, greatest(tc*30-2,0)::INTEGER AS hc0, least(tc*30+31,99)::INTEGER AS hc1 FROM (SELECT DISTINCT row//25 AS tr FROM px), (VALUES (0),(1),(2),(3)) c(tc), (SELECT max(row)+1 AS h FROM px)", "px").replace("tr*25", "tr*25"))
def tile_windows(spark: S, d: str) -> DataFrame:
    # tiles of 25 rows and 30 columns: two square gridings crossed
    from ..functions.grid import GridSpec

    g = spec(spark, d)
    rows = R.tile_windows(spark, GridSpec(g.ox, g.oy, g.px, 25, g.height), 25, 2).select("tr", "r0", "r1", "hr0", "hr1")
    cols = R.tile_windows(spark, GridSpec(g.ox, g.oy, g.px, g.width, 30), 30, 2).select("tc", "c0", "c1", "hc0", "hc1")
    return rows.crossJoin(F.broadcast(cols)).select("tr", "tc", "r0", "r1", "c0", "c1", "hr0", "hr1", "hc0", "hc1")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey%3=0 THEN NULL ELSE p_partkey*10 END AS px, CASE WHEN p_partkey%3=0 THEN NULL ELSE p_size END AS py FROM part".replace("p_partkey*10", "(p_partkey*10)::INTEGER"))
def filename_coords(spark: S, d: str) -> DataFrame:
    p = V.table(spark, d, "part").selectExpr("p_partkey as id", "case when p_partkey % 3 = 0 then 'tile.npz' else concat('tile-', p_partkey * 10, '-', p_size, '.npz') end as name")
    x, y = R.tile_position(F.col("name"))
    return p.select("id", x.alias("px"), y.alias("py"))


@query(sql("SELECT lin, CASE WHEN valid THEN raw/(CASE WHEN (SELECT max(raw) FROM px WHERE valid)>1+1e-6 THEN 255.0 ELSE 1.0 END)::DOUBLE END AS p FROM px", "px"))
def prob_normalise(spark: S, d: str) -> DataFrame:
    return M.normalise_probability(V.px(spark, d), "raw").select("lin", "p")


@query(sql("SELECT sample_id, len(list_filter(features, lambda x: x < -0.3)) = 0 AS ok FROM samples", "samples"))
def valid_all_bands(spark: S, d: str) -> DataFrame:
    s = V.samples(spark, d).withColumn("features", F.transform("features", lambda x: F.when(x < -0.3, F.lit(float("nan"))).otherwise(x)))
    return s.select("sample_id", M.all_finite(F.col("features")).alias("ok"))


@query(sql("SELECT sample_id, len(features) - 3 AS n, round(list_sum(list_transform(features, lambda x: x::DOUBLE)) - features[1]::DOUBLE - features[4]::DOUBLE - features[64]::DOUBLE, 5) AS total FROM samples", "samples"))
def feature_exclusion(spark: S, d: str) -> DataFrame:
    f = M.exclude_features(F.col("features"), [0, 3, 63])
    return V.samples(spark, d).select("sample_id", F.size(f).cast("long").alias("n"), F.round(F.aggregate(f, F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


@query(sql("SELECT lin, raw, prob FROM px WHERE raw >= 3.0 AND prob >= 0.15", "px"))
def height_screen(spark: S, d: str) -> DataFrame:
    return M.height_screen(V.px(spark, d), "raw", "prob").select("lin", "raw", "prob")


@query(sql("SELECT (row//5)::INTEGER AS brow, (col//5)::INTEGER AS bcol, round(avg((greatest(raw-40,0)>=3)::INTEGER),6) AS cover, avg((greatest(raw-40,0)>=3)::INTEGER)>=0.6 AS woodland FROM px GROUP BY 1,2", "px"))
def canopy_cover(spark: S, d: str) -> DataFrame:
    return M.canopy_cover(V.px(spark, d).withColumn("h", F.col("raw") - 40.0), "h", 5, min_cover=0.6).withColumn("cover", F.round("cover", 6))


@query(sql(f"SELECT count(*) AS pixels, round(count(*)*0.01::DOUBLE,6) AS area_ha FROM px WHERE {PEAT} AND NOT valid", "px"))
def hole_area(spark: S, d: str) -> DataFrame:
    p = V.px(spark, d)
    return M.hole_mask(V.peat(p), p.where("valid")).agg(F.count("*").alias("pixels"), F.round(F.count("*") * 0.01, 6).alias("area_ha"))


@query(sql("SELECT lin, coalesce(prob, raw/200.0::DOUBLE) AS v FROM px", "px"))
def fallback_fill(spark: S, d: str) -> DataFrame:
    return V.px(spark, d).select("lin", F.coalesce("prob", F.col("raw") / 200.0).alias("v"))


@query(sql("SELECT lin, valid, CASE WHEN (row+col)%11<2 THEN 0 WHEN valid AND prob>=0.5 THEN 1 ELSE 0 END AS mask FROM px", "px"))
def urban_mask(spark: S, d: str) -> DataFrame:
    p = V.px(spark, d)
    return M.mask_out(R.binary_raster(p, 0.5), V.peat(p, 11, 2), "mask").select("lin", "valid", "mask")


@query(sql(f"SELECT lin, CASE WHEN NOT (({PEAT}) OR lin%5=0 OR raw>90) THEN prob END AS prob, ((({PEAT}) OR lin%5=0 OR raw>90) AND prob IS NOT NULL)::INTEGER AS masked FROM px", "px"))
def or_masks(spark: S, d: str) -> DataFrame:
    return M.any_mask(V.px(spark, d), "prob", [F.expr("(row + col) % 7 < 3"), F.col("lin") % 5 == 0, F.col("raw") > 90]).select("lin", "prob", "masked")


@query(sql("SELECT lin, greatest(least(raw-20, 50.0::DOUBLE), -10.0::DOUBLE) AS v FROM px WHERE etype<>'error' UNION ALL SELECT lin, NULL FROM px WHERE etype='error'", "px"))
def sanitize_clip(spark: S, d: str) -> DataFrame:
    p = V.px(spark, d).select("lin", F.when(F.col("valid"), F.col("raw") - 20).otherwise(F.lit(float("inf"))).alias("v"))
    v = M.sanitise(F.col("v"), 50.0)
    return p.select("lin", F.when(v.isNotNull(), F.greatest(v, F.lit(-10.0))).alias("v"))


@query(sql("SELECT lin, round(greatest(least(raw, b[2]), b[1]),6) AS raw FROM px, (SELECT quantile_cont(raw,[0.005,0.995]) AS b FROM px)", "px"))
def winsorize(spark: S, d: str) -> DataFrame:
    return M.winsorise(V.px(spark, d), ["raw"]).select("lin", F.round("raw", 6).alias("raw"))


@query("SELECT p_partkey AS id, CASE WHEN p_size < 10 THEN p_size ELSE 1 END AS cat FROM part")
def unknown_category(spark: S, d: str) -> DataFrame:
    p = V.table(spark, d, "part").selectExpr("p_partkey as id", "p_size as cat")
    return M.known_category(p, "cat", p.where("cat < 10").select("cat")).select("id", "cat")


@query(sql("SELECT lin, (label>=2)::INTEGER AS label FROM px_label", "px_label"))
def binary_label_map(spark: S, d: str) -> DataFrame:
    return M.collapse_classes(V.px_label(spark, d), "label").select("lin", "label")


@query(sql("SELECT lin, coalesce(prob>=0.7,false) AS a, coalesce(raw/100>0.5,false) AS b, lin%3=1 AS c FROM px", "px"))
def presence_seed(spark: S, d: str) -> DataFrame:
    p = V.px(spark, d).withColumns({"one": (F.col("lin") % 3).cast("int"), "share": F.col("raw") / 100})
    return p.select("lin", M.seed_mask(["one", "prob"], "float", 0.7).alias("a"), M.seed_mask(["share"], "float", None).alias("b"), M.seed_mask(["one"], "int", None).alias("c"))


@query(sql("SELECT lin, raw-30>0 AS by_depth, coalesce(prob>=0.5,false) AS by_prob, CASE WHEN prob IS NOT NULL THEN (prob>=0.5)::INTEGER END AS peat_mask, CASE WHEN valid THEN raw/100 ELSE 0 END AS depth_m FROM px", "px"))
def peat_masks(spark: S, d: str) -> DataFrame:
    p = V.px(spark, d).withColumn("cm", F.when(F.col("valid"), F.col("raw")))
    return p.select("lin", M.peat_extent(F.col("raw") - 30, None).alias("by_depth"), M.peat_extent(None, F.col("prob")).alias("by_prob"), F.when(F.col("prob").isNotNull(), (F.col("prob") >= 0.5).cast("int")).alias("peat_mask"), M.depth_metres(F.col("cm")).alias("depth_m"))


@query(sql("SELECT lin, x, y, round(sin(radians(raw*3.6)),6)+0.0 AS sin_aspect, round(cos(radians(raw*3.6)),6)+0.0 AS cos_aspect FROM px", "px"))
def pixel_coords(spark: S, d: str) -> DataFrame:
    g = spec(spark, d)
    a = F.radians(F.col("raw") * 3.6)
    return V.px(spark, d).select("lin", g.x(F.col("col")).alias("x"), g.y(F.col("row")).alias("y"), (F.round(F.sin(a), 6) + 0.0).alias("sin_aspect"), (F.round(F.cos(a), 6) + 0.0).alias("cos_aspect"))


@query(sql("SELECT lin, raw FROM px JOIN zones ON col BETWEEN cmin+1 AND cmax-1 WHERE zone_id%2=1 AND row BETWEEN 1 AND (SELECT max(row) FROM px)-1", "px", "zones"))
def vector_clip_buffered(spark: S, d: str) -> DataFrame:
    """A clip by odd zones with a buffer of -1 pixel."""
    from ..operators.morphology import erode

    p, z = V.px(spark, d), V.zone_columns(V.zones(spark, d).where("zone_id % 2 = 1"))
    cover = p.join(z, F.col("col") == F.col("zcol")).select("row", "col")
    return M.clip_to(p, erode(cover, 1, 4)).select("lin", "raw")


@query("SELECT c_custkey AS id, (c_custkey*10)::BIGINT AS bng, NULL::INTEGER AS lone, 'customer' AS source_layer FROM customer UNION ALL SELECT s_suppkey, NULL, s_nationkey, 'supplier' FROM supplier")
def concat_layers(spark: S, d: str) -> DataFrame:
    c = V.table(spark, d, "customer").selectExpr("c_custkey as id", "c_custkey * 10 as bng")
    s = V.table(spark, d, "supplier").selectExpr("s_suppkey as id", "s_nationkey as lone")
    return R.concat_layers({"customer": c, "supplier": s}).select("id", "bng", "lone", "source_layer")


@query(sql("SELECT px.row, px.col, k AS cls FROM px LEFT JOIN (SELECT row, col, max(etype) AS k FROM px WHERE lin%13=0 GROUP BY 1,2) s ON px.row=s.row AND px.col=s.col", "px"))
def background_raster(spark: S, d: str) -> DataFrame:
    p = V.px(spark, d)
    return R.scatter_to_grid(p, p.where("lin % 13 = 0").select("row", "col", F.col("etype").alias("cls")), "cls")


@query(sql("SELECT lin, arg_max(raw+t, t) AS value FROM px, (VALUES (0),(1),(2)) v(t) WHERE lin%(t+1)=0 GROUP BY lin", "px"))
def mosaic_last_on_top(spark: S, d: str) -> DataFrame:
    p = V.px(spark, d).withColumn("t", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where("lin % (t + 1) = 0")
    m = R.mosaic(p.selectExpr("row", "col", "raw + t as value", "t as tile_id"), last=True)
    return m.selectExpr("cast(row as bigint) * 100 + col as lin", "value")


@query("SELECT event_id, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' AND event_id%100 BETWEEN 10 AND 40")
def date_bounds_filter(spark: S, d: str) -> DataFrame:
    e = V.table(spark, d, "events")
    return e.where("ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-12' and event_id % 100 between 10 and 40").select("event_id", "event_type", "value")
