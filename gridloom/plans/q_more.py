"""Queries of reports, rules and models that stand beside those of the other modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.lineage import cut
from ..operators import evaluate as E
from ..operators import focal as FO
from ..operators import geometry as G
from ..operators import masks as MA
from ..operators import models as M
from ..operators import reports as P
from ..operators import sampling as K
from ..operators import spatial_join as J
from ..sources import readers as RD
from ..sources import views as V
from ..sources.views import sql
from .base import query, spec
from .q_geometry import ZD
from .q_learn import BLOCK, blocked, training
from .q_patches import HYST, _rounded, kept
from .q_rules import DEC, EVG, NAMES, TARGET, _any, _has, _n

S = SparkSession


@query(sql("SELECT pixels, valid, low, high, kept, components, round(kept*0.01,6)::DOUBLE AS kept_ha, round(100.0*kept/valid,6) AS kept_pct, round(100.0*kept/low,6) AS of_low_pct, round(pixels*13/1e6,6)::DOUBLE AS ram_mb FROM (SELECT count(*) AS pixels, count(prob) AS valid, count(*) FILTER (WHERE prob>=0.6) AS low, count(*) FILTER (WHERE prob>=0.9) AS high FROM px), (SELECT count(*) AS kept, count(DISTINCT patch_id) AS components FROM kept)", "px", **HYST))
def hysteresis_stats(spark: S, d: str) -> DataFrame:
    """L9."""
    return _rounded(P.hysteresis_stats(V.px(spark, d), kept(spark, d), 0.6, 0.9, 0.01))


REG = {
    "p": "SELECT zone_id, count(*) AS pixels, count(*) FILTER (WHERE prob>=0.5) AS wet, count(*) FILTER (WHERE prob>=0.5 AND (row+col)%7<3) AS wet_on_peat, count(*) FILTER (WHERE prob>=0.5 AND (row+col)%7>=3) AS wet_off_peat, count(*) FILTER (WHERE row%5<2) AS forest, count(*) FILTER (WHERE prob>=0.5 AND row%5<2) AS wet_forest FROM px JOIN zones ON col BETWEEN cmin AND cmax GROUP BY 1",
    "pa": "SELECT region+1 AS zone_id, area_ha, id, x, y FROM pts WHERE region%6<>5",
    "s": "SELECT zone_id, count(*) AS num_patches, sum(area_ha) AS total_ha, avg(area_ha) AS mean_ha, max(area_ha) AS largest_ha, sum(area_ha*area_ha)/sum(area_ha) AS mesh_ha FROM pa GROUP BY 1",
    "nn": "SELECT a.zone_id, a.id, min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))) AS nn FROM pa a LEFT JOIN pa b ON a.zone_id=b.zone_id AND a.id<>b.id GROUP BY 1,2",
    "n": "SELECT zone_id, avg(nn) AS mean_nn FROM nn GROUP BY 1",
}


@query(sql("SELECT zone_id, zone_name, " + ", ".join(f"coalesce({c},0)::BIGINT AS {c}" for c in ("pixels", "wet", "wet_on_peat", "wet_off_peat", "forest", "wet_forest", "num_patches")) + ", " + ", ".join(f"round(coalesce({c},0),6)::DOUBLE AS {c}" for c in ("total_ha", "mean_ha", "largest_ha", "mesh_ha", "mean_nn")) + ", round(coalesce(wet,0)*0.01,6)::DOUBLE AS wet_ha, round(coalesce(100.0*wet_forest/nullif(forest,0),0),6)::DOUBLE AS forest_pct FROM zones LEFT JOIN p USING (zone_id) LEFT JOIN s USING (zone_id) LEFT JOIN n USING (zone_id)", "px", "zones", "pts", **REG))
def region_table(spark: S, d: str) -> DataFrame:
    """every region in one table, those without patches with zeros."""
    z = V.zones(spark, d)
    cells = z.select("zone_id", F.explode(F.sequence("cmin", "cmax")).alias("col"))  # the columns of each zone: an equi-join
    px = V.px(spark, d).join(cells, "col").selectExpr("zone_id", "prob", "(row + col) % 7 < 3 as peat", "row % 5 < 2 as forest")
    pa = V.pts(spark, d).where("region % 6 <> 5").selectExpr("cast(region + 1 as bigint) as zone_id", "id", "x", "y", "area_ha")
    nn = J.nearest_other(pa, 300.0, ["zone_id"])
    return _rounded(P.region_table(px, pa, nn, z, 0.01))


C8 = "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in (("suitable", "s"), ("unsuitable", "NOT s"), ("on_peat", "p"), ("off_peat", "NOT p"), ("suitable_on_peat", "s AND p"), ("suitable_off_peat", "s AND NOT p"), ("unsuitable_on_peat", "NOT s AND p"), ("unsuitable_off_peat", "NOT s AND NOT p"))) + " FROM (SELECT raw>=60 AS s, (row+col)%7<3 AS p FROM px WHERE valid)"


@query(sql("SELECT *, round(100.0*suitable/total,6) AS suitable_pct, round(100.0*on_peat/total,6) AS peat_pct, round(100.0*suitable_on_peat/suitable,6) AS of_suitable_on_peat_pct, round(100.0*suitable_off_peat/suitable,6) AS of_suitable_off_peat_pct, round(100.0*suitable_on_peat/on_peat,6) AS of_peat_suitable_pct, round(100.0*suitable_off_peat/off_peat,6) AS of_other_suitable_pct FROM c", "px", c=C8))
def peat_counts(spark: S, d: str) -> DataFrame:
    """the eight counts."""
    return _rounded(P.peat_counts(V.px(spark, d).where("valid").selectExpr("raw >= 60 as suitable", "(row + col) % 7 < 3 as peat")))


SEC = ("grade", "region", "peat", "cover")
SECTIONS = "SELECT raw AS v, (row*37+col*11)%500 AS dist, CASE WHEN lin%5<2 THEN '1-2' WHEN lin%5<4 THEN '3' ELSE '4-6' END AS grade, (col//20)::VARCHAR AS region, ((row+col)%7<3)::VARCHAR AS peat, etype AS cover FROM px WHERE valid"
_AGG = "count(v) AS n, round(avg(v),6) AS mean, round(quantile_cont(v,0.5),6) AS median, round(min(v),6) AS min, round(max(v),6) AS max, round(100.0*avg((v>=60)::INTEGER),6) AS high_pct, round(100.0*avg((dist<=250)::INTEGER),6) AS within_pct FROM s"


@query(sql(" UNION ALL ".join([f"SELECT 'all' AS section, NULL AS key, {_AGG}", *[f"SELECT '{c}' AS section, {c} AS key, {_AGG} GROUP BY {c}" for c in SEC]]), "px", s=SECTIONS))
def landvalue_sections(spark: S, d: str) -> DataFrame:
    """all sections, with extremes, the share within a distance, land cover and regions."""
    p = V.px(spark, d).where("valid").selectExpr("raw", "cast((row * 37 + col * 11) % 500 as double) as dist", "case when lin % 5 < 2 then '1-2' when lin % 5 < 4 then '3' else '4-6' end as grade", "cast(col div 20 as string) as region", "(row + col) % 7 < 3 as peat", "etype as cover")
    return _rounded(P.sectioned(p, "raw", list(SEC), 60.0, "dist", 250.0))


W = {"a": 3.0, "b": -2.0, "c": 0.5}


@query(sql("SELECT row_number() OVER (ORDER BY v DESC, band)::INTEGER AS rank, band, round(v,6) AS mean_abs FROM (SELECT 'a' AS band, avg(abs(3.0*(a-ma))) AS v FROM f, m UNION ALL SELECT 'b', avg(abs(-2.0*(b-mb))) FROM f, m UNION ALL SELECT 'c', avg(abs(0.5*(c-mc))) FROM f, m) ORDER BY v DESC, band LIMIT 2", "samples", f="SELECT features[1]::DOUBLE AS a, features[2]::DOUBLE AS b, features[3]::DOUBLE AS c FROM samples", m="SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc FROM f"))
def importance_list(spark: S, d: str) -> DataFrame:
    """The greatest contributions of a linear model."""
    f = V.samples(spark, d).selectExpr("cast(features[0] as double) as a", "cast(features[1] as double) as b", "cast(features[2] as double) as c")
    return P.importance_list(P.contributions(f, W), "mean_abs", 2).withColumn("mean_abs", F.round("mean_abs", 6))


@query(sql("SELECT id, tag, reason, reason IS NULL AS ok FROM (SELECT id, tag, CASE WHEN t='' THEN 'no training tag' WHEN f='' THEN 'no calibration file' WHEN f<>t THEN 'other file' END AS reason FROM (SELECT p_partkey AS id, tag, lower(coalesce(regexp_extract(trim(path),'([^/]*)$',1),'')) AS f, lower(coalesce(regexp_extract(trim(tag),'([^/]*)$',1),'')) AS t FROM (SELECT p_partkey, CASE WHEN p_size%7=0 THEN NULL ELSE '/data/x/Site_' || p_size%5 || '.KML' END AS path, CASE WHEN p_size%11=0 THEN '' ELSE 'y/site_' || p_size%4 || '.kml' END AS tag FROM part)))"))
def provenance_check(spark: S, d: str) -> DataFrame:
    """L7."""
    p = V.table(spark, d, "part").selectExpr("p_partkey as id", "case when p_size % 7 = 0 then null else concat('\\\\data\\\\x\\\\Site_', p_size % 5, '.KML') end as path", "case when p_size % 11 = 0 then '' else concat('y/site_', p_size % 4, '.kml') end as tag")
    return P.provenance(p, "path", "tag").select("id", "tag", "reason", "ok")


IV = {
    "zd": ZD,
    "pos": "SELECT DISTINCT row, col FROM px JOIN zd ON abs(px.x-cx)+abs(px.y-cy)<r",
    "neg": "SELECT row, col FROM (SELECT row, col, row_number() OVER (PARTITION BY row//10 ORDER BY md5(lin::VARCHAR), lin) AS t FROM px) WHERE t<=40",
    "one": "SELECT row, col, min(y) AS y FROM (SELECT row, col, 1 AS y FROM pos UNION ALL SELECT row, col, 0 FROM neg) GROUP BY 1,2 HAVING count(*)=1",
    "k": "SELECT count(*) FILTER (WHERE prob>0.5 AND one.y=1) AS tp, count(*) FILTER (WHERE prob>0.5 AND one.y=0) AS fp, count(*) FILTER (WHERE prob<=0.5 AND one.y=1) AS fn, count(*) FILTER (WHERE prob<=0.5 AND one.y=0) AS tn FROM one JOIN px USING (row, col) WHERE prob IS NOT NULL",
}


@query(sql("SELECT tp, fp, fn, tn, round(tp/nullif(tp+fp,0),6) AS precision, round(tp/nullif(tp+fn,0),6) AS recall FROM k", "px", "zones", **IV))
def independent_validation(spark: S, d: str) -> DataFrame:
    """Positives from polygons, negatives spread over strips of ten rows."""
    z = V.zones(spark, d).selectExpr("zone_id as poly_id", "400000.0D + (cmin + 10) * 10.0D + 3 as cx", "300000.0D - (zone_id * 17 % 8 + 2) * 10.0D - 3 as cy", "71.5D + zone_id as r")
    ring = F.expr("array(named_struct('x', cx + r, 'y', cy), named_struct('x', cx, 'y', cy + r), named_struct('x', cx - r, 'y', cy), named_struct('x', cx, 'y', cy - r))").cast(G.RING)
    px = V.px(spark, d)
    pos = G.burn(z.select("poly_id", ring.alias("ring")), spec(spark, d)).select("row", "col")
    neg = K.balanced(px.withColumn("strip", F.expr("row div 10")), 40, "strip", "lin").select("row", "col")
    return P.independent_validation(pos, neg, px.select("row", "col", F.col("prob").alias("p")), 0.5).select("tp", "fp", "fn", "tn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


BIRCH = f"(upper(trim(code)) IN ('BRAND#1','BRAND#7') OR {_has('pri', 'bolt')})"
DOWNY = "(upper(trim(code))='BRAND#7' OR regexp_matches(lower(trim(pri)), '\\bred\\s+bolt\\b'))"
ONLY2 = f"CASE WHEN pri IN ('','nan','none','n/a') THEN true WHEN {BIRCH} THEN {DOWNY} WHEN NOT {_any('pri', NAMES)} THEN false ELSE NOT {_any('pri', ['bolt', 'widget'])} END"


def downy(spark: S, d: str) -> tuple:
    s = V.species(spark, d)
    return s, R.is_birch(F.col("pri"), F.col("code"), ("BRAND#1", "BRAND#7"), "bolt"), R.is_downy(F.col("pri"), F.col("code"), ("BRAND#7",), "red bolt")


@query(sql(f"SELECT id, {DOWNY} AS downy, {ONLY2} AS only_allowed, ({_any('name', TARGET)} OR {DOWNY}) AND ({_has('name', 'ring')} OR {_has('pri', 'ring')}) AS off_peat, ({_any('name', TARGET)} OR {DOWNY}) AND {ONLY2} AS on_peat FROM species", "species"))
def downy_birch_rules(spark: S, d: str) -> DataFrame:
    """J3-J6 with the downy birch's branches."""
    s, birch, is_downy = downy(spark, d)
    return s.select("id", is_downy.alias("downy"), R.only_allowed(F.col("pri"), TARGET, NAMES, birch, is_downy).alias("only_allowed"), R.off_peat(F.col("name"), [F.col("pri")], TARGET, "ring", "red", False, is_downy).alias("off_peat"), R.on_peat(F.col("name"), [F.col("pri")], TARGET, NAMES, is_downy, [(birch, is_downy)]).alias("on_peat"))


H1, H0 = ["wid"], ["st"]


@query(sql(f"SELECT id, CASE WHEN d>e THEN 1 WHEN e>d THEN 0 WHEN {_n('pri', EVG)}>{_n('pri', DEC)} THEN 0 WHEN {_n('pri', DEC)}>{_n('pri', EVG)} THEN 1 WHEN {_n('pri', H1)}+{_n('sec', H1)}>0 THEN 1 WHEN {_n('pri', H0)}+{_n('sec', H0)}>0 THEN 0 ELSE 1 END AS label FROM (SELECT id, pri, sec, {_n('pri', DEC)}+{_n('sec', DEC)} AS d, {_n('pri', EVG)}+{_n('sec', EVG)} AS e FROM species)", "species"))
def dry_type_with_hints(spark: S, d: str) -> DataFrame:
    """J7 with general words."""
    return V.species(spark, d).select("id", R.dry_type(F.col("pri"), [F.col("sec")], DEC, EVG, (H1, H0)).alias("label"))


@query(sql("SELECT label, CASE WHEN label=1 THEN 'wet' WHEN label=0 THEN 'background' END AS binary_01, CASE label WHEN 0 THEN 'evergreen' WHEN 1 THEN 'deciduous' WHEN 2 THEN 'wet' END AS legacy_012, CASE label WHEN 0 THEN 'evergreen' WHEN 1 THEN 'deciduous' WHEN 2 THEN 'wet_on_peat' WHEN 3 THEN 'wet_off_peat' END AS split_bg_0123 FROM (SELECT DISTINCT label FROM px_label)", "px_label"))
def class_schemas(spark: S, d: str) -> DataFrame:
    """The three schemas."""
    return V.px_label(spark, d).select("label").distinct().select("label", *[R.class_name(F.col("label"), m).alias(s) for s, m in R.SCHEMAS.items()])


@query("SELECT id, CASE WHEN b='' THEN 'run_' || id WHEN ends_with(b, '_' || id) THEN b ELSE b || '_' || id END AS run FROM (SELECT p_partkey AS id, CASE WHEN p_size%9=0 THEN '' WHEN p_size%4=0 THEN p_name || '_' || p_partkey ELSE p_name END AS b FROM part)")
def run_ids(spark: S, d: str) -> DataFrame:
    """J19."""
    p = V.table(spark, d, "part").selectExpr("p_partkey as id", "case when p_size % 9 = 0 then ' ' when p_size % 4 = 0 then concat(p_name, '_', p_partkey) else concat(p_name, '/') end as name")
    return p.select("id", R.run_id(F.col("name"), F.col("id")).alias("run"))


@query("SELECT k::INTEGER AS width, i::INTEGER AS place, CASE WHEN k=65 THEN 'band_' || i WHEN i<64 THEN 'emb_' || lpad(i::VARCHAR,2,'0') ELSE ['elevation','slope','aspect','twi'][i-63] END AS name FROM (SELECT unnest([65,66,67,68]) AS k), (SELECT unnest(range(68)) AS i) WHERE i<k AND (SELECT max(len(embedding)) FROM embeddings)=64")
def feature_names(spark: S, d: str) -> DataFrame:
    """D-25: names of the bands by their number, for rows of 64 embeddings with two to four bands behind them."""
    wide = V.table(spark, d, "embeddings").agg(F.max(F.size("embedding"))).first()[0]
    return spark.createDataFrame([(wide + k, i, n) for k in (1, 2, 3, 4) for i, n in enumerate(R.feature_names(wide + k))], "width int, place int, name string")


@query(sql("SELECT zone_id, count(*) AS n, round(sum(raw),2) AS total FROM px JOIN zones ON col BETWEEN cmin AND cmax WHERE valid GROUP BY 1", "px", "zones"))
def terrain_source(spark: S, d: str) -> DataFrame:
    """D-5: the mode names a source that isn't there, so the fallback is read."""
    src = MA.terrain_source(" Radar ", {"LIDAR": V.px(spark, d).where("not valid"), "global": V.px(spark, d).where("valid")})
    cells = V.zones(spark, d).select("zone_id", F.explode(F.sequence("cmin", "cmax")).alias("col"))
    return src.join(cells, "col").groupBy("zone_id").agg(F.count("*").alias("n"), F.round(F.sum("raw"), 2).alias("total"))


@query(sql("SELECT lin, CASE WHEN prob IS NOT NULL AND (row+col)%7<3 THEN round((1-greatest(least(prob,1),0))*0.6*255)::INTEGER ELSE 0 END AS alpha, CASE WHEN prob IS NOT NULL AND (row+col)%7<3 THEN [10,120,250][floor(prob*2+0.5)::INTEGER+1] ELSE 0 END AS red, CASE WHEN prob IS NOT NULL AND (row+col)%7<3 THEN 255 ELSE 0 END AS opacity FROM px", "px"))
def terrain_shadow(spark: S, d: str) -> DataFrame:
    """H14."""
    p, inside = V.px(spark, d), F.expr("(row + col) % 7 < 3")
    c = FO.composite(F.col("prob"), inside, [(10, 0, 0), (120, 60, 0), (250, 90, 9)])
    return p.select("lin", FO.shade_alpha(F.col("prob"), inside, 0.6).alias("alpha"), c["r"].alias("red"), c["alpha"].alias("opacity"))


@query(sql("SELECT (row//8)::INTEGER AS brow, (col//8)::INTEGER AS bcol, round(avg(CASE WHEN (row+col)%7<3 THEN raw END),6) AS raw, round(count(CASE WHEN (row+col)%7<3 THEN raw END)/count(*),6) AS share FROM px GROUP BY 1,2 HAVING count(CASE WHEN (row+col)%7<3 THEN raw END)>0", "px"))
def elevation_preview(spark: S, d: str) -> DataFrame:
    """I13."""
    return _rounded(FO.preview(V.px(spark, d).withColumn("inside", F.expr("(row + col) % 7 < 3")), "raw", "inside", 8))


EQ = "SELECT id FROM (SELECT dr.*, np, n0, n1, least(floor(np*0.7::DOUBLE), n0+n1) AS q FROM dr JOIN (SELECT block, count(*) FILTER (WHERE label>=2) AS np, count(*) FILTER (WHERE label=0) AS n0, count(*) FILTER (WHERE label=1) AS n1 FROM bl GROUP BY 1) USING (block)) WHERE np>0 AND n0+n1>0 AND (label>=2 OR (label=1 AND t<=least(n1, floor((q+1)/2)+greatest(0, q-floor((q+1)/2)-n0))) OR (label=0 AND t<=least(n0, q-floor((q+1)/2)+greatest(0, floor((q+1)/2)-n1))))"


@query(sql(EQ, "pts", **BLOCK))
def rebalance_equal(spark: S, d: str) -> DataFrame:
    """K4 with equal quotas."""
    return K.rebalance(blocked(spark, d), 0.7, None).where("kept").select("id")


@query(sql("SELECT id, round(nn/avg(nn) OVER (),6) AS weight FROM (SELECT a.id, min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))) AS nn FROM pts a JOIN pts b ON a.id<>b.id GROUP BY 1)", "pts"))
def near_distance_weights(spark: S, d: str) -> DataFrame:
    """K14."""
    return M.near_distance_weights(V.pts(spark, d), 100.0).withColumn("weight", F.round("weight", 6))


@query()
def geographic_folds(spark: S, d: str) -> DataFrame:
    """K-means over positions; tested for what makes it one."""
    return M.geographic_folds(V.pts(spark, d), 5).select("id", "x", "y", "fold")


SW = {
    "t": "SELECT i/100.0::DOUBLE AS threshold FROM (SELECT unnest(range(1,100)) AS i)",
    "cv": "SELECT threshold, count(*) FILTER (WHERE p>=threshold AND y=1) AS tp, count(*) FILTER (WHERE p>=threshold AND y=0) AS fp, count(*) FILTER (WHERE y=1) AS pos FROM oof, t WHERE p IS NOT NULL AND y_original IN (1,2,3) GROUP BY 1",
    "pr": "SELECT threshold, tp/nullif(tp+fp,0) AS precision, tp/pos AS recall FROM cv",
}


@query(sql("SELECT threshold, round(precision,6) AS precision, round(recall,6) AS recall, (SELECT max(precision)>=0.55-1e-9 FROM pr) AS met FROM pr WHERE precision IS NOT NULL ORDER BY (precision>=0.55-1e-9)::INTEGER DESC, CASE WHEN precision>=0.55-1e-9 THEN 0 ELSE precision END DESC, threshold LIMIT 1", "oof", **SW))
def deployment_threshold(spark: S, d: str) -> DataFrame:
    """L1: the first threshold that reaches a precision, against deciduous background alone."""
    o = V.oof(spark, d).where("y_original in (1, 2, 3)")
    c = E.sweep(o, [i / 100 for i in range(1, 100)])
    curve = c.select("threshold", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"))
    return _rounded(E.deployment_target(curve, 0.55))


TILES = "SELECT row, col, (row//20)*10+col//20 AS tile_id, raw, prob, x, y FROM px"


@query(sql("SELECT tile_id::BIGINT AS tile_id, count(*) AS n, round(sum(raw),4) AS raw, round(avg(x),4) AS x, count(prob) AS valid FROM tl WHERE tile_id%3=1 GROUP BY 1", "px", tl=TILES))
def tile_load(spark: S, d: str) -> DataFrame:
    """The wanted tiles' features, labels and positions in one table."""
    t = V.px(spark, d).selectExpr("(row div 20) * 10 + col div 20 as tile_id", "row", "col", "raw", "prob", "x")
    rows = RD.load_tiles(t, t.where("tile_id % 3 = 1").select("tile_id"), ["raw", "prob", "x"])
    return rows.groupBy("tile_id").agg(F.count("*").alias("n"), F.round(F.sum("raw"), 4).alias("raw"), F.round(F.avg("x"), 4).alias("x"), F.count("prob").alias("valid"))


@query(sql("SELECT row, col, round(arg_min(prob, CASE WHEN prob IS NOT NULL THEN tile END),6) AS value FROM (SELECT row, col, prob, 1 AS tile FROM px WHERE col<60 UNION ALL SELECT row, col, prob/2, 2 FROM px WHERE col>=40) WHERE row BETWEEN 3 AND 40 AND col BETWEEN 30 AND 70 GROUP BY 1,2", "px"))
def mosaic_union_cropped(spark: S, d: str) -> DataFrame:
    """The union of two tiles' extents, cropped to the box of a mask."""
    p = V.px(spark, d)
    t = p.where("col < 60").selectExpr("row", "col", "prob as value", "1 as tile_id").unionByName(p.where("col >= 40").selectExpr("row", "col", "prob / 2 as value", "2 as tile_id"))
    box = spark.createDataFrame([(3, 30), (40, 70), (20, 50)], "row int, col int")
    return RD.union_mosaic(t, mask=box).withColumn("value", F.round("value", 6))


@query()
def trained_predict(spark: S, d: str) -> DataFrame:
    """M3: a logistic regression trained on two folds, its coefficients applied to all rows; tested against numpy."""
    t = cut(training(spark, d))
    w, b = M.fit_logistic(t.where("fold < 2"), 1.0)
    return M.predict_linear(t, w, b, 0.5).select("sample_id", "fold", "y", F.round("p", 6).alias("p"), "pred")
