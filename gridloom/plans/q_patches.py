"""Queries of sections E and F."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.quantiles import percentiles
from ..operators import components as C
from ..operators import morphology as MO
from ..operators import summaries as U
from ..operators import zonal as Z
from ..sources import views as V
from ..sources.views import sql
from .base import query, spec

S = SparkSession


def comp_sql(low: float, conn: int) -> dict[str, str]:
    offs = ", ".join(f"({r},{c})" for r in (-1, 0, 1) for c in (-1, 0, 1) if (r or c) and (conn == 8 or not (r and c)))
    return {
        "low": f"SELECT row, col, lin, prob, x, y FROM px WHERE prob >= {low}::DOUBLE",
        "e": f"SELECT a.lin AS a, b.lin AS b FROM low a, (VALUES {offs}) o(dr,dc), low b WHERE b.row=a.row+dr AND b.col=a.col+dc",
        "reach": "SELECT lin AS a, lin AS b FROM low UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b=e.a",
        "lab": "SELECT a AS lin, min(b) AS patch_id FROM reach GROUP BY a",
    }


HYST = comp_sql(0.6, 8) | {"keep": "SELECT patch_id FROM lab JOIN low USING (lin) GROUP BY patch_id HAVING max(prob)>=0.9::DOUBLE AND count(*)>=3", "kept": "SELECT low.*, lab.patch_id FROM low JOIN lab USING (lin) WHERE patch_id IN (SELECT patch_id FROM keep)"}
PATCH = HYST | {"patches": "SELECT patch_id, count(*) AS pixel_count, avg(x) AS centroid_x, avg(y) AS centroid_y, count(*)*0.01::DOUBLE AS area_ha FROM kept GROUP BY patch_id"}


def low_mask(spark: S, d: str, t: float = 0.6) -> DataFrame:
    return V.px(spark, d).where(F.col("prob") >= t)


def kept(spark: S, d: str) -> DataFrame:
    return C.hysteresis(V.px(spark, d), 0.6, 0.9, 3)


def patches(spark: S, d: str) -> DataFrame:
    return Z.patch_metrics(kept(spark, d), 0.01)


@query(sql("SELECT lin, patch_id FROM lab", "px", **comp_sql(0.6, 8)))
def components_8(spark: S, d: str) -> DataFrame:
    return C.label_patches(low_mask(spark, d)).select("lin", "patch_id")


@query(sql("SELECT lin, patch_id FROM lab", "px", **comp_sql(0.6, 4)))
def components_4(spark: S, d: str) -> DataFrame:
    return C.label_patches(low_mask(spark, d), 4).select("lin", "patch_id")


@query(sql("SELECT lin, patch_id FROM kept", "px", **HYST))
def hysteresis(spark: S, d: str) -> DataFrame:
    return kept(spark, d).select("lin", "patch_id")


@query(sql("SELECT lin, patch_id FROM lab WHERE patch_id IN (SELECT patch_id FROM lab GROUP BY 1 HAVING count(*)>=4)", "px", **comp_sql(0.8, 8)))
def sieve(spark: S, d: str) -> DataFrame:
    return C.sieve(low_mask(spark, d, 0.8), 4).select("lin", "patch_id")


@query(sql("SELECT lin, patch_id FROM lab WHERE patch_id IN (SELECT patch_id FROM lab GROUP BY 1 HAVING count(*)>=3)", "px", **comp_sql(0.9, 8)))
def balanced_output(spark: S, d: str) -> DataFrame:
    return C.hysteresis(V.px(spark, d), 0.9, 0.9, 3).select("lin", "patch_id")


@query(
    sql(
        "SELECT core.lin, min(core.lin) OVER (PARTITION BY m) AS patch_id FROM core JOIN (SELECT a AS g, min(b) AS m FROM reach GROUP BY a) r ON r.g=core.row*1000+core.col",
        "px",
        core="SELECT row, col, lin FROM px WHERE prob>=0.95::DOUBLE",
        low="SELECT DISTINCT row+dr AS row, col+dc AS col, (row+dr)*1000+col+dc AS g FROM core, (VALUES (-1),(0),(1)) a(dr), (VALUES (-1),(0),(1)) b(dc)",
        e="SELECT a.g AS a, b.g AS b FROM low a, (VALUES (-1),(0),(1)) x(dr), (VALUES (-1),(0),(1)) y(dc), low b WHERE b.row=a.row+dr AND b.col=a.col+dc",
        reach="SELECT g AS a, g AS b FROM low UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b=e.a",
    )
)
def bridge_components(spark: S, d: str) -> DataFrame:
    return C.bridge(low_mask(spark, d, 0.95), 1, V.WIDTH).select("lin", "patch_id")


@query(sql("SELECT DISTINCT row+dr AS row, col+dc AS col FROM px, (VALUES (-2),(-1),(0),(1),(2)) a(dr), (VALUES (-2),(-1),(0),(1),(2)) b(dc) WHERE prob>=0.97::DOUBLE AND abs(dr)+abs(dc)<=2 AND row+dr BETWEEN 0 AND (SELECT max(row) FROM px) AND col+dc BETWEEN 0 AND 99", "px"))
def dilate(spark: S, d: str) -> DataFrame:
    return MO.dilate(low_mask(spark, d, 0.97), 2, 4, spec(spark, d))


@query(sql("SELECT m.row, m.col FROM m, (VALUES (0,0),(0,1),(1,0),(0,-1),(-1,0)) o(dr,dc), m n WHERE n.row=m.row+dr AND n.col=m.col+dc GROUP BY 1,2 HAVING count(*)=5", "px", m="SELECT row, col FROM px WHERE prob>=0.3::DOUBLE"))
def erode(spark: S, d: str) -> DataFrame:
    return MO.erode(low_mask(spark, d, 0.3), 1, 4)


@query(sql("SELECT DISTINCT row+dr AS row, col+dc AS col FROM er, o", "px", m="SELECT row, col FROM px WHERE prob>=0.2::DOUBLE", o="SELECT dr, dc FROM (VALUES (-1),(0),(1)) a(dr), (VALUES (-1),(0),(1)) b(dc)", er="SELECT m.row, m.col FROM m, o, m n WHERE n.row=m.row+dr AND n.col=m.col+dc GROUP BY 1,2 HAVING count(*)=9"))
def opening(spark: S, d: str) -> DataFrame:
    return MO.opening(low_mask(spark, d, 0.2), 8)


HOLE = comp_sql(0, 8) | {"low": "SELECT row, col, lin FROM px WHERE NOT valid"}


@query(sql("SELECT patch_id AS hole_id, count(*) AS pixels, round(count(*)*0.01::DOUBLE,6) AS area_ha FROM lab GROUP BY 1 HAVING count(*)>=2 ORDER BY 2 DESC, 1 LIMIT 8", "px", **HOLE))
def coverage_holes(spark: S, d: str) -> DataFrame:
    p = V.px(spark, d)
    return C.coverage_holes(p, p.where("valid"), 0.01, 0.015).withColumn("area_ha", F.round("area_ha", 6))


@query(sql("SELECT patch_id, pixel_count, round(area_ha,6) AS area_ha, round(centroid_x,6) AS centroid_x, round(centroid_y,6) AS centroid_y FROM patches", "px", **PATCH))
def patch_metrics(spark: S, d: str) -> DataFrame:
    return patches(spark, d).select("patch_id", "pixel_count", F.round("area_ha", 6).alias("area_ha"), F.round("centroid_x", 6).alias("centroid_x"), F.round("centroid_y", 6).alias("centroid_y"))


def _bands(v: str) -> str:
    return f"CASE WHEN {v}<=0.01 THEN 'le_001' WHEN {v}<0.1 THEN '001_01' WHEN {v}<1 THEN '01_1' WHEN {v}<5 THEN '1_5' WHEN {v}<10 THEN '5_10' ELSE 'ge_10' END"


def size_sql(src: str, by: str = "") -> str:
    cols = "".join(f", sum((b='{n}')::INTEGER)::BIGINT AS patches_{n}, round(sum(CASE WHEN b='{n}' THEN area_ha ELSE 0 END),6) AS area_{n}" for n, _, _ in Z.BANDS)
    return f"SELECT {by}{', ' if by else ''}count(*) AS num_patches, round(sum(area_ha),6) AS total_ha, round(avg(area_ha),6) AS mean_ha, round(quantile_cont(area_ha,0.5),6) AS median_ha, round(max(area_ha),6) AS largest_ha, (SELECT r FROM (SELECT round_even(z.area_ha,1) AS r, count(*) AS k FROM {src} z {f'WHERE z.{by}=q.{by}' if by else ''} GROUP BY 1 ORDER BY k DESC, r LIMIT 1)) AS modal_ha{cols} FROM (SELECT *, {_bands('area_ha')} AS b FROM {src}) q {f'GROUP BY {by}' if by else ''}"


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in keys else F.col(c) for c, t in df.dtypes])


@query(sql(size_sql("patches"), "px", **PATCH))
def patch_size_summary(spark: S, d: str) -> DataFrame:
    return _rounded(Z.size_summary(patches(spark, d)))


@query(sql(size_sql("pts", "region"), "pts"))
def region_patch_stats(spark: S, d: str) -> DataFrame:
    return _rounded(Z.size_summary(V.pts(spark, d), ["region"]))


DIV = "SELECT round(1-a2/(a*a),6) AS division, round(a2/a,6) AS mesh_ha, round(100*top/a,6) AS largest_pct, round(100*t/a,6) AS top_tenth_pct FROM (SELECT sum(area_ha) AS a, sum(area_ha*area_ha) AS a2, max(area_ha) AS top FROM {0}), (SELECT sum(area_ha) AS t FROM (SELECT area_ha, row_number() OVER (ORDER BY area_ha DESC) AS rn, count(*) OVER () AS n FROM {0}) WHERE rn <= greatest(1, floor(n*0.1)))"


@query(sql(DIV.format("patches"), "px", **PATCH))
def landscape_division(spark: S, d: str) -> DataFrame:
    return _rounded(Z.landscape_division(cut(patches(spark, d))))


@query(sql("SELECT sum(CASE WHEN (row+col)%7<3 THEN 1 ELSE 0 END)*0.01::DOUBLE AS on_ha, sum(CASE WHEN (row+col)%7<3 THEN 0 ELSE 1 END)*0.01::DOUBLE AS off_ha FROM px WHERE prob>=0.5", "px").replace("sum(CASE", "round(sum(CASE").replace("*0.01::DOUBLE", "*0.01::DOUBLE,6)"))
def peat_split(spark: S, d: str) -> DataFrame:
    return _rounded(U.split_area(V.px(spark, d).where("prob >= 0.5"), F.expr("(row + col) % 7 < 3"), 0.01))


def zoned(spark: S, d: str) -> DataFrame:
    return V.px(spark, d).join(V.zone_columns(V.zones(spark, d)), F.col("col") == F.col("zcol")).drop("zcol")


@query(sql("SELECT zone_id, count(lin) AS wet FROM zones LEFT JOIN px ON col BETWEEN cmin AND cmax AND prob>=0.98 GROUP BY 1", "px", "zones"))
def zonal_counts(spark: S, d: str) -> DataFrame:
    return U.zone_counts(zoned(spark, d).where("prob >= 0.98"), V.zones(spark, d), "zone_id", "wet")


REG = "SELECT zone_id, zone_name, count(lin) FILTER (WHERE prob>=0.5)*0.01::DOUBLE AS wet_ha, count(lin)*0.01::DOUBLE AS area_ha FROM zones LEFT JOIN px ON col BETWEEN cmin AND cmax AND zone_id%6<>0 GROUP BY 1,2"


def regions(spark: S, d: str) -> DataFrame:
    return U.zone_areas(zoned(spark, d).where("zone_id % 6 <> 0"), V.zones(spark, d), F.col("prob") >= 0.5, 0.01)


@query(sql("SELECT zone_id, zone_name, round(area_ha,6) AS area_ha, round(wet_ha,6) AS wet_ha, round(wet_ha/nullif(area_ha/100,0),6) AS density FROM reg", "px", "zones", reg=REG))
def region_density(spark: S, d: str) -> DataFrame:
    return _rounded(U.zone_density(regions(spark, d)))


@query(sql("SELECT zone, count(*) AS pixels, count(*) FILTER (WHERE prob>=0.5) AS wet FROM (SELECT prob, CASE WHEN col<80 THEN col//4+1 ELSE 0 END AS zone FROM px) GROUP BY 1", "px").replace("SELECT zone,", "SELECT zone::INTEGER AS zone,"))
def region_density_with_background(spark: S, d: str) -> DataFrame:
    z = V.px(spark, d).withColumn("zone", F.expr("cast(case when col < 80 then col div 4 + 1 else 0 end as int)"))
    return U.counts_with_background(z, "zone", F.col("prob") >= 0.5)


@query(sql("SELECT CASE WHEN area_ha=0 THEN 'zone ' || zone_id ELSE zone_name END AS name, round(100*wet_ha/nullif(area_ha,0),6) AS pct, round(wet_ha,6) AS wet_ha FROM reg", "px", "zones", reg=REG))
def region_proportions(spark: S, d: str) -> DataFrame:
    r = regions(spark, d).withColumn("zone_name", F.when(F.col("area_ha") > 0, F.col("zone_name")))
    return _rounded(U.zone_proportions(r))


@query(sql("SELECT patch_id, coalesce(r, -1) AS region, coalesce(k, 0) AS pixels FROM (SELECT DISTINCT patch_id FROM kept) LEFT JOIN (SELECT patch_id AS p, r, k, row_number() OVER (PARTITION BY patch_id ORDER BY k DESC, r) AS rn FROM (SELECT patch_id, (col//4+1)::INTEGER AS r, count(*) AS k FROM kept WHERE (col//4)%5<>2 GROUP BY 1,2)) ON p=patch_id AND rn=1", "px", **HYST))
def patch_majority_region(spark: S, d: str) -> DataFrame:
    k = kept(spark, d).withColumn("region", F.expr("cast(case when (col div 4) % 5 <> 2 then col div 4 + 1 end as int)"))
    return Z.majority(k, "patch_id", "region")


def _density(n: int) -> str:
    return sql(f"SELECT (row//{n})::INTEGER AS brow, (col//{n})::INTEGER AS bcol, round(count(*) FILTER (WHERE prob>=0.5)*0.01/({n * n}*0.01/100),6) AS ha_per_km2 FROM px WHERE row//{n} < (SELECT max(row)+1 FROM px)//{n} AND col//{n} < 100//{n} GROUP BY 1,2", "px")


def _block(spark: S, d: str, n: int) -> DataFrame:
    g = spec(spark, d)
    p = V.px(spark, d).withColumn("wet", F.coalesce((F.col("prob") >= 0.5).cast("int"), F.lit(0)))
    return _rounded(Z.block_density(p, n, g.height, g.width, g.pixel_ha))


@query(_density(7))
def block_density_fine(spark: S, d: str) -> DataFrame:
    return _block(spark, d, 7)


@query(_density(30))
def block_density_coarse(spark: S, d: str) -> DataFrame:
    return _block(spark, d, 30)


ELEV = "(row*31+col*17)%200+raw/10.0"


def elev(df: DataFrame) -> DataFrame:
    return df.withColumn("elev", F.expr("cast((row * 31 + col * 17) % 200 as double) + raw / 10.0D"))


@query(sql(f"SELECT count(e) AS n, round(avg(e),6) AS mean, round(min(e),6) AS min, round(max(e),6) AS max, round(quantile_cont(e,0.1),6) AS p10, round(quantile_cont(e,0.5),6) AS p50, round(quantile_cont(e,0.9),6) AS p90 FROM (SELECT {ELEV} AS e FROM px WHERE prob>=0.5)", "px"))
def elevation_summary(spark: S, d: str) -> DataFrame:
    return _rounded(Z.zone_stats(elev(V.px(spark, d).where("prob >= 0.5")), "elev"))


@query(sql("SELECT round(100.0*avg(((row+col)%9<4)::INTEGER),6) AS pct FROM px WHERE prob>=0.5", "px"))
def association_pct(spark: S, d: str) -> DataFrame:
    return _rounded(U.association(V.px(spark, d).where("prob >= 0.5"), F.expr("(row + col) % 9 < 4")))


TOW = HYST | {"t": "SELECT patch_id, count(*)*25.0 AS a, avg((raw>=40)::INTEGER) AS h FROM kept JOIN (SELECT lin, raw FROM px) USING (lin) GROUP BY 1"}


@query(sql("SELECT CASE WHEN h<0.5 THEN 'fail' WHEN a BETWEEN 5 AND 350 THEN 'Lone' WHEN a>350 AND a<=1000 THEN 'Group' WHEN a>1000 THEN 'Small' ELSE 'none' END AS cls, count(*) AS n, round(sum(a),6)::DOUBLE AS area_m2 FROM t GROUP BY 1", "px", **TOW))
def tow_classes(spark: S, d: str) -> DataFrame:
    t = kept(spark, d).groupBy("patch_id").agg((F.count("*") * 25.0).alias("a"), F.avg((F.col("raw") >= 40).cast("int")).alias("h"))
    return t.withColumn("cls", Z.tow_class(F.col("a"), F.col("h"))).groupBy("cls").agg(F.count("*").alias("n"), F.round(F.sum("a"), 6).alias("area_m2"))


@query(sql("SELECT count(*) AS pixels, round(100.0*count(*) FILTER (WHERE NOT valid)/count(*),6) AS nodata_pct, round(100.0*count(*) FILTER (WHERE prob>=0.5)/count(*) FILTER (WHERE valid),6) AS wet_pct, round(count(*) FILTER (WHERE prob>=0.5)*0.01/(130279*100.0)*100,9) AS country_pct FROM px", "px"))
def coverage_summary(spark: S, d: str) -> DataFrame:
    c = U.coverage(V.px(spark, d), F.col("prob") >= 0.5, 0.01, 130279.0)
    return c.select("pixels", F.round("nodata_pct", 6).alias("nodata_pct"), F.round("wet_pct", 6).alias("wet_pct"), F.round("country_pct", 9).alias("country_pct"))


EVAL = "SELECT zone_id, count(*) AS truth, count(*) FILTER (WHERE prob>=0.5) AS tp, round(avg(prob),6) AS mean_prob, round(quantile_cont(prob,0.5),6) AS median_prob FROM px JOIN zones ON col BETWEEN cmin AND cmax WHERE (row+col)%7<3 GROUP BY 1"


def polygon_eval(spark: S, d: str) -> DataFrame:
    return U.polygon_scores(zoned(spark, d).where("(row + col) % 7 < 3"), "zone_id")


@query(sql("SELECT *, truth-tp AS fn, round(tp/truth,6) AS recall, tp>0 AS detected, mean_prob>=0.5 AS wet_by_mean FROM ev", "px", "zones", ev=EVAL))
def polygon_recall(spark: S, d: str) -> DataFrame:
    return polygon_eval(spark, d)


@query(sql("SELECT round(avg(round(tp/truth,6)),6) AS m_iou, count(*) FILTER (WHERE tp/truth>=0.45) AS n_half, count(*) FILTER (WHERE tp>0) AS n_detected, (SELECT count(*) FROM zones)-count(*) AS n_excluded FROM ev", "px", "zones", ev=EVAL))
def polygon_rollup(spark: S, d: str) -> DataFrame:
    return U.polygon_rollup(polygon_eval(spark, d), V.zones(spark, d), 0.45)


INNER = "SELECT id, greatest(0, w-2)*greatest(0, h-2)*0.01::DOUBLE AS ha FROM (SELECT c_custkey AS id, c_custkey%9+1 AS w, (c_custkey//9)%9+1 AS h FROM customer)"


@query(sql("SELECT count(*) AS n, round(quantile_cont(ha,0.5),6) AS median, round(avg(ha),6) AS mean, round(min(ha),6) AS min, round(max(ha),6) AS max, round(quantile_cont(ha,0.25),6) AS q25, round(quantile_cont(ha,0.75),6) AS q75, count(*) FILTER (WHERE ha<0.03) AS below FROM i WHERE ha>0", i=INNER))
def polygon_interior_stats(spark: S, d: str) -> DataFrame:
    """Rectangles of w x h pixels, each eroded by itself with a 3 x 3 element."""
    r = V.table(spark, d, "customer").selectExpr("c_custkey as id", "c_custkey % 9 as w", "(c_custkey div 9) % 9 as h")
    cells = r.select("id", F.explode(F.sequence(F.lit(0), F.col("w"))).alias("col"), "h").select("id", "col", F.explode(F.sequence(F.lit(0), F.col("h"))).alias("row"))
    inner = MO.erode(cells, 1, 8, ["id"]).groupBy("id").agg((F.count("*") * F.lit(0.01)).alias("ha"))
    return _rounded(U.interior_stats(inner, "ha", 0.03))


@query(sql("SELECT (raw>=60) AS suitable, (row+col)%7<3 AS peat, count(*) AS pixels, round(100.0*count(*)/(SELECT count(*) FROM px WHERE valid),6) AS pct FROM px WHERE valid GROUP BY 1,2", "px"))
def peat_breakdown(spark: S, d: str) -> DataFrame:
    p = V.px(spark, d).where("valid")
    n = p.agg(F.count("*").alias("n"))
    return p.groupBy((F.col("raw") >= 60).alias("suitable"), F.expr("(row + col) % 7 < 3").alias("peat")).agg(F.count("*").alias("pixels")).crossJoin(F.broadcast(n)).select("suitable", "peat", "pixels", F.round(100.0 * F.col("pixels") / F.col("n"), 6).alias("pct"))


GS = "SELECT grade, region, peat, grouping(grade)::BIGINT*4+grouping(region)*2+grouping(peat) AS gid, count(*) AS n, round(avg(raw),6) AS mean, round(quantile_cont(raw,0.5),6) AS median, round(100.0*avg((raw>=60)::INTEGER),6) AS high_pct FROM (SELECT raw, CASE WHEN lin%5<2 THEN '1-2' WHEN lin%5<4 THEN '3' ELSE '4-6' END AS grade, (col//20)::INTEGER AS region, (row+col)%7<3 AS peat FROM px WHERE valid) GROUP BY GROUPING SETS ((grade),(region),(peat),())"


@query(sql(GS, "px"))
def landvalue_grouping_sets(spark: S, d: str) -> DataFrame:
    p = V.px(spark, d).where("valid").selectExpr("raw", "case when lin % 5 < 2 then '1-2' when lin % 5 < 4 then '3' else '4-6' end as grade", "cast(col div 20 as int) as region", "(row + col) % 7 < 3 as peat")
    g = p.groupingSets([[F.col("grade")], [F.col("region")], [F.col("peat")], []], "grade", "region", "peat")
    stats = g.agg(F.grouping_id().alias("gid"), F.count("*").alias("n"), F.round(F.avg("raw"), 6).alias("mean"), F.round(100.0 * F.avg((F.col("raw") >= 60).cast("int")), 6).alias("high_pct"))
    sets = F.explode(F.array(*[F.struct(F.lit(i).alias("gid"), *[(F.col(c) if c == k else F.lit(None).cast(t)).alias(c) for c, t in (("grade", "string"), ("region", "int"), ("peat", "boolean"))]) for i, k in ((3, "grade"), (5, "region"), (6, "peat"), (7, ""))])).alias("s")
    q = percentiles(p.select("raw", sets).select("raw", "s.*"), "raw", [0.5], ["gid", "grade", "region", "peat"]).select(*[F.col(c).alias(f"q_{c}") for c in ("gid", "grade", "region", "peat")], F.round(F.col("q")[0], 6).alias("median"))
    same = F.lit(True)
    for c in ("gid", "grade", "region", "peat"):
        same &= F.col(c).eqNullSafe(F.col(f"q_{c}"))
    return stats.join(q, same, "left").select("grade", "region", "peat", "gid", "n", "mean", "median", "high_pct")


@query(sql("SELECT cell, slice_id, count(value) AS n, round(avg(value),6) AS mean, round(stddev_samp(value),6) AS std FROM slices GROUP BY 1,2", "slices"))
def slice_mean_std(spark: S, d: str) -> DataFrame:
    return _rounded(Z.slice_stats(V.slices(spark, d), ["cell", "slice_id"]))


@query(sql("SELECT DISTINCT etype, (row//2)::INTEGER AS row, (col//2)::INTEGER AS col FROM px", "px"))
def dissolve_cells(spark: S, d: str) -> DataFrame:
    return V.px(spark, d).selectExpr("etype", "cast(row div 2 as int) as row", "cast(col div 2 as int) as col").distinct()


def _vif(band: str, a: str, b: str) -> str:
    """1 / (1 - R2) of a band on two others, by their correlations."""
    r2 = f"((r_{band}{a}*r_{band}{a}+r_{band}{b}*r_{band}{b}-2*r_{band}{a}*r_{band}{b}*r_{a}{b})/(1-r_{a}{b}*r_{a}{b}))"
    return f"SELECT '{band}' AS band, round(1/(1-{r2}),4) AS vif FROM r"


@query(sql(" UNION ALL ".join((_vif("a", "b", "c"), _vif("b", "a", "c"), _vif("c", "a", "b"))), "px", r="SELECT corr(a,b) AS r_ab, corr(a,b) AS r_ba, corr(a,c) AS r_ac, corr(a,c) AS r_ca, corr(b,c) AS r_bc, corr(b,c) AS r_cb FROM (SELECT raw AS a, raw*0.5+lin%37 AS b, raw*0.2+(lin%37)*0.7+lin%11 AS c FROM px)"))
def vif(spark: S, d: str) -> DataFrame:
    p = V.px(spark, d).selectExpr("raw as a", "raw * 0.5D + lin % 37 as b", "raw * 0.2D + (lin % 37) * 0.7D + lin % 11 as c")
    return Z.vif(p, ["a", "b", "c"]).withColumn("vif", F.round("vif", 4))


@query(sql("SELECT round(quantile_cont(raw,0.05),6) AS p5, round(quantile_cont(raw,0.10),6) AS p10, round(quantile_cont(raw,0.20),6) AS p20 FROM px WHERE prob>=0.4", "px"))
def presence_percentiles(spark: S, d: str) -> DataFrame:
    q = percentiles(V.px(spark, d).where("prob >= 0.4"), "raw", [0.05, 0.1, 0.2])
    return q.select(*[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p5", "p10", "p20"))])


@query(sql("SELECT etype, label, count(*) AS n FROM px_label GROUP BY 1,2", "px_label"))
def class_distribution(spark: S, d: str) -> DataFrame:
    return U.distribution(V.px_label(spark, d), "etype", "label")


@query(sql("SELECT region, count(*) AS n FROM (SELECT * FROM pts ORDER BY area_ha DESC, id LIMIT 50) GROUP BY 1", "pts"))
def region_frequency(spark: S, d: str) -> DataFrame:
    return V.pts(spark, d).orderBy(F.desc("area_ha"), "id").limit(50).transform(U.distribution, "region").orderBy(F.desc("n"), "region")


@query(sql("SELECT row_number() OVER (ORDER BY area_ha DESC, id) AS rank, id, round(area_ha,6) AS area_ha, round_even(x+id%2*0.5,0)::INTEGER AS easting, coalesce(zone_name,'Unknown') AS region_name FROM pts LEFT JOIN zones ON zone_id=region+2 ORDER BY area_ha DESC, id LIMIT 20", "pts", "zones").replace("OVER (ORDER BY area_ha DESC, id) AS rank", "OVER (ORDER BY area_ha DESC, id)::INTEGER AS rank"))
def top_patches(spark: S, d: str) -> DataFrame:
    z = V.zones(spark, d).withColumn("zone_id", F.col("zone_id") - 2)
    t = U.top_rows(V.pts(spark, d), "area_ha", "id", 20).join(z, F.col("zone_id") == F.col("region"), "left")
    return t.select("rank", "id", F.round("area_ha", 6).alias("area_ha"), F.bround(F.col("x") + F.col("id") % 2 * 0.5, 0).cast("int").alias("easting"), F.coalesce("zone_name", F.lit("Unknown")).alias("region_name"))
