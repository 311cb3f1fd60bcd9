"""Queries of sections C, H and I."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import GridSpec
from ..functions.lineage import cut
from ..functions.quantiles import percentiles
from ..operators import distance as D
from ..operators import focal as H
from ..operators import resample as I
from ..operators import spatial_join as J
from ..operators import summaries as U
from ..sources import views as V
from ..sources.views import sql
from .base import query, spec
from .q_patches import ELEV, _rounded, elev

S = SparkSession
SEEDS = "SELECT row, col FROM px WHERE lin%97=0"
RECT = "SELECT c_custkey AS id, (c_custkey*37%900)::DOUBLE+0.25 AS x0, (c_custkey*53%900)::DOUBLE+0.25 AS y0, (c_custkey*37%900)::DOUBLE+0.25+c_custkey%17+1 AS x1, (c_custkey*53%900)::DOUBLE+0.25+c_custkey%13+1 AS y1 FROM customer"
RECT2 = "SELECT s_suppkey AS id, (s_suppkey*71%880)::DOUBLE AS x0, (s_suppkey*29%880)::DOUBLE AS y0, (s_suppkey*71%880)::DOUBLE+40 AS x1, (s_suppkey*29%880)::DOUBLE+30 AS y1 FROM supplier"


def rects(spark: S, d: str) -> DataFrame:
    return V.table(spark, d, "customer").selectExpr("c_custkey as id", "cast(c_custkey * 37 % 900 as double) + 0.25D as x0", "cast(c_custkey * 53 % 900 as double) + 0.25D as y0").withColumns({"x1": F.col("x0") + F.col("id") % 17 + 1, "y1": F.col("y0") + F.col("id") % 13 + 1})


def big_rects(spark: S, d: str) -> DataFrame:
    return V.table(spark, d, "supplier").selectExpr("s_suppkey as id", "cast(s_suppkey * 71 % 880 as double) as x0", "cast(s_suppkey * 29 % 880 as double) as y0").withColumns({"x1": F.col("x0") + 40, "y1": F.col("y0") + 30})


def ring_of(df: DataFrame) -> DataFrame:
    """Each box as a triangle: its lower edge, and the middle of its upper edge."""
    v = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return df.select(F.col("id").alias("poly_id"), F.array(v(F.col("x0"), F.col("y0")), v(F.col("x1"), F.col("y0")), v((F.col("x0") + F.col("x1")) / 2, F.col("y1"))).alias("ring"))


IN = "SELECT p.id, r.id AS poly_id FROM pp p JOIN r ON p.y >= r.y0 AND p.y < r.y1 AND p.x >= r.x0+(p.y-r.y0)/(r.y1-r.y0)*(r.x1-r.x0)/2 AND p.x < r.x1-(p.y-r.y0)/(r.y1-r.y0)*(r.x1-r.x0)/2"
PP = "SELECT id, x%920+0.371::DOUBLE AS x, y%920+0.617::DOUBLE AS y FROM pts"


def probe(spark: S, d: str) -> DataFrame:
    return V.pts(spark, d).selectExpr("id", "x % 920 + 0.371D as x", "y % 920 + 0.617D as y")


@query(sql("SELECT * FROM inn", "pts", r=RECT2, pp=PP, inn=IN))
def point_in_polygon(spark: S, d: str) -> DataFrame:
    return J.points_in_polygons(probe(spark, d), ring_of(big_rects(spark, d)), 50.0)


@query(sql("SELECT id FROM pp WHERE id IN (SELECT id FROM inn)", "pts", r=RECT2, pp=PP, inn=IN))
def semi_on_peat(spark: S, d: str) -> DataFrame:
    p = probe(spark, d)
    return p.join(J.points_held(p, ring_of(big_rects(spark, d)), 50.0), "id", "left_semi").select("id")


@query(sql("SELECT id FROM pp WHERE id NOT IN (SELECT id FROM inn)", "pts", r=RECT2, pp=PP, inn=IN))
def anti_off_peat(spark: S, d: str) -> DataFrame:
    p = probe(spark, d)
    return p.join(J.points_held(p, ring_of(big_rects(spark, d)), 50.0), "id", "left_anti").select("id")


@query(sql("SELECT pp.id, coalesce('poly ' || min(poly_id), 'Unknown') AS name FROM pp LEFT JOIN inn USING (id) GROUP BY 1", "pts", r=RECT2, pp=PP, inn=IN))
def point_region_name(spark: S, d: str) -> DataFrame:
    f = J.first_polygon(probe(spark, d), ring_of(big_rects(spark, d)), 50.0)
    return f.select("id", F.coalesce(F.concat(F.lit("poly "), F.col("poly_id").cast("string")), F.lit("Unknown")).alias("name"))


OVER = "FROM a JOIN b ON a.x0<b.x1 AND b.x0<a.x1 AND a.y0<b.y1 AND b.y0<a.y1"


@query(sql(f"SELECT a.id AS a_id, b.id AS b_id {OVER}", a=RECT, b=RECT2))
def bbox_overlap(spark: S, d: str) -> DataFrame:
    return J.bbox_overlap(rects(spark, d), big_rects(spark, d), 50.0).select("a_id", "b_id")


@query(sql(f"SELECT a.id AS a_id, b.id AS b_id, round((least(a.x1,b.x1)-greatest(a.x0,b.x0))*(least(a.y1,b.y1)-greatest(a.y0,b.y0)),6) AS intersection_area {OVER}", a=RECT, b=RECT2))
def rect_intersection_area(spark: S, d: str) -> DataFrame:
    return _rounded(J.rect_intersections(rects(spark, d), big_rects(spark, d), 50.0))


@query(sql(f"SELECT b.id AS b_id, count(*) AS n, round(sum(w),5) AS total, round(avg(w),5) AS mean FROM (SELECT a.id AS i, b.id, (least(a.x1,b.x1)-greatest(a.x0,b.x0))*(least(a.y1,b.y1)-greatest(a.y0,b.y0)) AS w {OVER}) b GROUP BY 1", a=RECT, b=RECT2))
def intersection_summary(spark: S, d: str) -> DataFrame:
    return J.rect_intersection_stats(rects(spark, d), big_rects(spark, d), 50.0).select("b_id", "n", F.round("total", 5).alias("total"), F.round("mean", 5).alias("mean"))


PROX = "SELECT a.id, b.area_ha, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS d FROM pts a JOIN pts b ON abs(a.x-b.x)<=1000 AND abs(a.y-b.y)<=1000"


@query(sql("SELECT pts.id, round(coalesce(sum(j.area_ha/(d*d)),0),6) AS proximity_index, count(d) AS neighbours FROM pts LEFT JOIN (SELECT * FROM j0 WHERE d>0 AND d<=1000) j ON j.id=pts.id GROUP BY 1", "pts", j0=PROX))
def proximity_index(spark: S, d: str) -> DataFrame:
    return _rounded(J.proximity_index(V.pts(spark, d), 1000.0))


@query(sql("SELECT a.id, round(sqrt(min((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))),6) AS nn FROM pts a LEFT JOIN pts b ON a.id<>b.id GROUP BY 1", "pts"))
def nearest_neighbour(spark: S, d: str) -> DataFrame:
    return _rounded(J.nearest_other(V.pts(spark, d), 250.0))


@query(sql("SELECT a.region, round(avg(nn),6) AS mean_nn FROM (SELECT a.id, a.region, sqrt(min((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))) AS nn FROM pts a LEFT JOIN pts b ON a.id<>b.id AND a.region=b.region GROUP BY 1,2) a GROUP BY 1", "pts"))
def region_mean_nn(spark: S, d: str) -> DataFrame:
    return J.nearest_other(V.pts(spark, d), 500.0, ["region"]).groupBy("region").agg(F.round(F.avg("nn"), 6).alias("mean_nn"))


@query(sql("SELECT s.id, px.raw, px.prob FROM (SELECT id, floor(x/10)::INTEGER AS col, floor(y/10)::INTEGER AS row FROM pts) s LEFT JOIN px ON px.row=s.row AND px.col=s.col", "pts", "px"))
def point_sample(spark: S, d: str) -> DataFrame:
    p = V.pts(spark, d).selectExpr("id", "x + 400000.0D as x", "300000.0D - y - 1e-7D as y")
    return J.sample_raster(p, V.px(spark, d), spec(spark, d), ["raw", "prob"]).select("id", "raw", "prob")


@query(sql("SELECT lin FROM px WHERE valid AND NOT coalesce(prob>=0.9,false) AND (row+col)%11>=2 AND lin%5<>0", "px"))
def background_anti_join(spark: S, d: str) -> DataFrame:
    p = V.px(spark, d)
    return U.background(p, [p.where("prob >= 0.9"), V.peat(p, 11, 2), p.where("lin % 5 = 0")]).select("lin")


def water(spark: S, d: str) -> DataFrame:
    return V.px(spark, d).where("lin % 97 = 0")


@query(sql("SELECT px.lin, round(coalesce(min(dd),60.0),6)::DOUBLE AS dist FROM px LEFT JOIN (SELECT a.lin, sqrt((a.row-b.row)*(a.row-b.row)+(a.col-b.col)*(a.col-b.col))*10 AS dd FROM px a JOIN s b ON b.row BETWEEN a.row-6 AND a.row+6 AND b.col BETWEEN a.col-6 AND a.col+6) j ON j.lin=px.lin AND dd<=60 GROUP BY 1", "px", s=SEEDS))
def distance_capped(spark: S, d: str) -> DataFrame:
    p = V.px(spark, d)
    return D.distance_capped(p, water(spark, d), spec(spark, d), 60.0).selectExpr("cast(row as bigint) * 100 + col as lin", "round(dist, 6) as dist")


FULL = "SELECT a.lin, a.row, a.col, a.prob, sqrt(min((a.row-b.row)*(a.row-b.row)+(a.col-b.col)*(a.col-b.col)))*10 AS dist FROM px a, s b GROUP BY ALL"


@query(sql("SELECT lin, round(dist,6) AS dist FROM f", "px", s=SEEDS, f=FULL))
def distance_full(spark: S, d: str) -> DataFrame:
    return D.distance_full(V.px(spark, d), water(spark, d), spec(spark, d)).selectExpr("cast(row as bigint) * 100 + col as lin", "round(dist, 6) as dist")


@query(sql("SELECT count(*) AS n, round(avg(dist),6) AS mean, round(min(dist),6) AS min, round(max(dist),6) AS max, round(quantile_cont(dist,0.5),6) AS p50, round(100.0*avg((dist<=50)::INTEGER),6) AS within_pct FROM f WHERE prob>=0.5", "px", s=SEEDS, f=FULL))
def distance_summary(spark: S, d: str) -> DataFrame:
    f = cut(D.distance_full(V.px(spark, d).where("prob >= 0.5"), water(spark, d), spec(spark, d)))
    return _rounded(f.agg(F.count("*").alias("n"), F.avg("dist").alias("mean"), F.min("dist").alias("min"), F.max("dist").alias("max"), (100.0 * F.avg((F.col("dist") <= 50).cast("int"))).alias("within_pct")).crossJoin(F.broadcast(percentiles(f, "dist", [0.5]).select(F.col("q")[0].alias("p50")))))


@query(sql("SELECT (row//10)::INTEGER AS brow, (col//10)::INTEGER AS bcol, round(min(dist),6) AS dist FROM f GROUP BY 1,2", "px", s=SEEDS, f=FULL))
def cross_resolution_distance(spark: S, d: str) -> DataFrame:
    return _rounded(I.downsample(D.distance_full(V.px(spark, d), water(spark, d), spec(spark, d)), 10, {"dist": ("min", "dist")}))


GRAD = f"SELECT lin, row, col, CASE WHEN pc IS NULL THEN (nc-e)/10 WHEN nc IS NULL THEN (e-pc)/10 ELSE (nc-pc)/20 END AS gx, CASE WHEN pr IS NULL THEN (nr-e)/10 WHEN nr IS NULL THEN (e-pr)/10 ELSE (nr-pr)/20 END AS gy FROM (SELECT *, lag(e) OVER (PARTITION BY row ORDER BY col) AS pc, lead(e) OVER (PARTITION BY row ORDER BY col) AS nc, lag(e) OVER (PARTITION BY col ORDER BY row) AS pr, lead(e) OVER (PARTITION BY col ORDER BY row) AS nr FROM (SELECT lin, row, col, ({ELEV})::DOUBLE AS e FROM px))"


def graded(spark: S, d: str) -> DataFrame:
    return H.gradient(elev(V.px(spark, d)), "elev", 10.0)


@query(sql("SELECT lin, round(gx,6)+0.0 AS gx, round(gy,6)+0.0 AS gy, round(sqrt(gx*gx+gy*gy),6) AS slope FROM g", "px", g=GRAD))
def slope(spark: S, d: str) -> DataFrame:
    return graded(spark, d).select("lin", (F.round("gx", 6) + 0.0).alias("gx"), (F.round("gy", 6) + 0.0).alias("gy"), F.round("slope", 6).alias("slope"))


@query(sql("SELECT lin, round(ln(greatest(lin%500+1,10)/CASE WHEN sqrt(gx*gx+gy*gy)<=1e-6 THEN 1e-3 ELSE sqrt(gx*gx+gy*gy) END),6) AS twi FROM g", "px", g=GRAD))
def twi_given_flow(spark: S, d: str) -> DataFrame:
    return graded(spark, d).select("lin", F.round(H.wetness_index((F.col("lin") % 500 + 1).cast("double"), F.col("slope"), 10.0), 6).alias("twi"))


HORN = f"SELECT a.row, a.col, sum(b.e*o.dc*(CASE WHEN o.dr=0 THEN 2 ELSE 1 END))/80 AS gx, sum(b.e*o.dr*(CASE WHEN o.dc=0 THEN 2 ELSE 1 END))/80 AS gy FROM el a, (SELECT r.dr, c.dc FROM (VALUES (-1),(0),(1)) r(dr), (VALUES (-1),(0),(1)) c(dc)) o, el b WHERE b.row=a.row+o.dr AND b.col=a.col+o.dc GROUP BY 1,2 HAVING count(*)=9"


@query(sql("SELECT row, col, round(degrees(atan(sqrt(gx*gx+gy*gy))),5) AS slope_deg, CASE WHEN abs(gx)>1e-12 OR abs(gy)>1e-12 THEN round((degrees(atan2(-gx,gy))+360.0)%360.0,5)::DOUBLE END AS aspect_deg FROM h", "px", el=f"SELECT row, col, ({ELEV})::DOUBLE AS e FROM px", h=HORN))
def horn_slope(spark: S, d: str) -> DataFrame:
    h = H.horn(elev(V.px(spark, d)), "elev", 10.0)
    return h.select("row", "col", F.round("slope_deg", 5).alias("slope_deg"), F.round("aspect_deg", 5).alias("aspect_deg"))


@query(sql("SELECT brow, bcol, CASE WHEN sqrt(s*s+c*c)>1e-6 THEN round((degrees(atan2(s,c))+360.0)%360.0,4)::DOUBLE END AS aspect_deg FROM (SELECT (row//5)::INTEGER AS brow, (col//5)::INTEGER AS bcol, avg(sin(radians(raw*3.6))) AS s, avg(cos(radians(raw*3.6))) AS c FROM px GROUP BY 1,2)", "px"))
def aspect_circular_mean(spark: S, d: str) -> DataFrame:
    p = V.px(spark, d).selectExpr("cast(row div 5 as int) as brow", "cast(col div 5 as int) as bcol", "raw * 3.6D as aspect")
    return H.circular_mean(p, "aspect", ["brow", "bcol"]).withColumn("aspect_deg", F.round("aspect_deg", 4))


@query(sql("SELECT px.lin, round(coalesce(px.prob, m, (SELECT quantile_cont(prob,0.5) FROM px)),6) AS prob FROM px LEFT JOIN (SELECT a.lin, quantile_cont(b.prob,0.5) AS m FROM px a JOIN px b ON abs(a.row-b.row)<=1 AND b.row BETWEEN a.row-1 AND a.row+1 AND b.col BETWEEN a.col-1 AND a.col+1 WHERE a.prob IS NULL AND b.prob IS NOT NULL GROUP BY 1) n ON n.lin=px.lin", "px"))
def neighbour_median_fill(spark: S, d: str) -> DataFrame:
    return H.fill_median(V.px(spark, d), "prob").select("lin", F.round("prob", 6).alias("prob"))


SHADE = "SELECT lin, (" + "+".join(f"(sin(radians(45.0))*cos(s)+cos(radians(45.0))*sin(s)*cos(radians({a})-a))" for a in (315.0, 45.0, 225.0, 135.0)) + ")/4 AS shade FROM (SELECT lin, atan(sqrt(gx*gx+gy*gy)) AS s, atan2(-gx,gy) AS a FROM g)"


@query(sql("SELECT lin, round(shade,5) AS shade, round(pow(greatest(least((shade-q[1])/(q[2]-q[1]),1),0),0.8),4) AS stretched FROM sh, (SELECT quantile_cont(shade,[0.02,0.98]) AS q FROM sh)", "px", g=GRAD, sh=SHADE))
def hillshade(spark: S, d: str) -> DataFrame:
    h = graded(spark, d).select("lin", H.hillshade(F.col("gx"), F.col("gy")).alias("shade"))
    return H.stretch(h, "shade", gamma=0.8).select("lin", F.round("shade", 5).alias("shade"), F.round("stretched", 4).alias("stretched"))


@query(sql("SELECT a.lin, round(sum(b.prob*exp(-((a.row-b.row)*(a.row-b.row)+(a.col-b.col)*(a.col-b.col))/2.0))/sum(exp(-((a.row-b.row)*(a.row-b.row)+(a.col-b.col)*(a.col-b.col))/2.0)),5) AS smooth FROM px a JOIN px b ON b.row BETWEEN a.row-4 AND a.row+4 AND b.col BETWEEN a.col-4 AND a.col+4 WHERE b.prob IS NOT NULL GROUP BY 1", "px"))
def gaussian_smooth(spark: S, d: str) -> DataFrame:
    return H.gaussian(V.px(spark, d), "prob", 1.0).selectExpr("cast(row as bigint) * 100 + col as lin", "round(smooth, 5) as smooth")


@query(sql("SELECT lin, round(greatest(least((raw-q[1])/(q[2]-q[1]),1),0),5) AS stretched FROM px, (SELECT quantile_cont(raw,[0.02,0.98]) AS q FROM px)", "px"))
def percentile_stretch(spark: S, d: str) -> DataFrame:
    return H.stretch(V.px(spark, d), "raw").select("lin", F.round("stretched", 5).alias("stretched"))


@query(sql("SELECT row, round(mean,6) AS mean, round(avg(mean) OVER (ORDER BY row ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING),6) AS smooth FROM (SELECT row, avg(prob) AS mean FROM px GROUP BY 1)", "px"))
def row_profile(spark: S, d: str) -> DataFrame:
    return _rounded(H.row_profile(V.px(spark, d), "prob", 4))


@query(sql("SELECT lin, CASE WHEN prob IS NULL THEN NULL WHEN prob>0 THEN round((u-1)/(n-1),6) ELSE 0.0 END::DOUBLE AS scaled FROM px LEFT JOIN (SELECT lin AS l, count(*) OVER (ORDER BY prob RANGE UNBOUNDED PRECEDING) AS u, count(*) OVER () AS n FROM px WHERE prob>0) ON l=lin", "px"))
def rank_scale(spark: S, d: str) -> DataFrame:
    return H.rank_scale(V.px(spark, d), "prob").select("lin", F.round("scaled", 6).alias("scaled"))


@query(sql("SELECT lin, round(0.6*greatest(least((raw-a[1])/(a[2]-a[1]),1),0)+0.4*greatest(least((e-b[1])/(b[2]-b[1]),1),0),5) AS wetness FROM el, (SELECT quantile_cont(raw,[0.05,0.95]) AS a, quantile_cont(e,[0.05,0.95]) AS b FROM el)", "px", el=f"SELECT lin, raw, ({ELEV})::DOUBLE AS e FROM px"))
def wetness_composite(spark: S, d: str) -> DataFrame:
    return H.wetness_composite(elev(V.px(spark, d)), {"raw": 0.6, "elev": 0.4}).select("lin", F.round("wetness", 5).alias("wetness"))


@query(sql("SELECT id, floor((lon+180)/360*1024)::INTEGER AS tx, floor((1-ln(tan(radians(lat))+1/cos(radians(lat)))/pi())/2*1024)::INTEGER AS ty FROM (SELECT id, x/1000-6 AS lon, 50+y/2000 AS lat FROM pts)", "pts"))
def web_tiles(spark: S, d: str) -> DataFrame:
    x, y = H.web_tile(F.col("x") / 1000 - 6, 50 + F.col("y") / 2000, 10)
    return V.pts(spark, d).select("id", x.alias("tx"), y.alias("ty"))


@query()
def terrain_hydrology(spark: S, d: str) -> DataFrame:
    """Depression filling, D8 flow and CTI by haloed tile: iterative, tested against a brute-force version."""
    t = H.terrain_tiles(elev(V.px(spark, d)), "elev", 10.0, 25, 5)
    return t.select("row", "col", F.round("filled", 6).alias("filled"), F.round("depth", 6).alias("depth"), "flow", F.round("cti", 6).alias("cti"))


@query(sql("SELECT t.row::INTEGER AS row, t.col::INTEGER AS col, px.raw FROM (SELECT r.row, c.col FROM (SELECT DISTINCT row//3 AS row FROM px) r, (SELECT DISTINCT col//3 AS col FROM px) c) t LEFT JOIN px ON px.row=t.row*3+1 AND px.col=t.col*3+1", "px"))
def resample_nearest(spark: S, d: str) -> DataFrame:
    g = spec(spark, d)
    t = GridSpec(g.ox, g.oy, 30.0, 34, -(-g.height // 3))
    cells = V.px(spark, d).selectExpr("cast(row div 3 as int) as row", "cast(col div 3 as int) as col").distinct()
    return I.nearest(V.px(spark, d), g, cells, t, ["raw"])


@query(sql("SELECT (row//4)::INTEGER AS brow, (col//4)::INTEGER AS bcol, round(avg(prob),6) AS mean, round(sum(prob),6) AS total, max(prob) AS top, min(prob) AS least FROM px GROUP BY 1,2", "px"))
def resample_blocks(spark: S, d: str) -> DataFrame:
    return _rounded(I.downsample(V.px(spark, d), 4, {"mean": ("avg", "prob"), "total": ("sum", "prob"), "top": ("max", "prob"), "least": ("min", "prob")}))


@query(sql("SELECT t.row, t.col, round(sum(px.prob*0.25)/sum(CASE WHEN px.prob IS NOT NULL THEN 0.25 END),6)::DOUBLE AS prob FROM (SELECT DISTINCT (row//2)::INTEGER AS row, (col//2)::INTEGER AS col FROM px) t JOIN px ON px.row//2=t.row AND px.col//2=t.col GROUP BY 1,2", "px"))
def bilinear_aligned(spark: S, d: str) -> DataFrame:
    g = spec(spark, d)
    t = GridSpec(g.ox, g.oy, 20.0, 50, -(-g.height // 2))
    cells = V.px(spark, d).selectExpr("cast(row div 2 as int) as row", "cast(col div 2 as int) as col").distinct()
    return _rounded(I.bilinear(V.px(spark, d), g, cells, t, "prob"))


@query(sql("SELECT px.row, px.col, round(m,6) AS m FROM px LEFT JOIN (SELECT row//10 AS br, col//10 AS bc, avg(raw) AS m FROM px GROUP BY 1,2) c ON br=floor(row*((SELECT max(row)+1 FROM px)//10)/(SELECT max(row)+1 FROM px)) AND bc=floor(col*10/100)", "px"))
def upsample_blocky(spark: S, d: str) -> DataFrame:
    g = spec(spark, d)
    c = I.downsample(V.px(spark, d), 10, {"m": ("avg", "raw")})
    return _rounded(I.upsample(c, V.px(spark, d), g.height, g.width, g.height // 10, 10, "m"))


@query(sql("SELECT CASE WHEN (row+col)%11<2 THEN 'urban' WHEN (row+col)%7<3 THEN 'forest' WHEN lin%5=0 THEN 'clip' END AS reason, count(*) AS n, round(sum(prob),5) AS total FROM px WHERE prob IS NOT NULL GROUP BY 1", "px"))
def mask_cascade_counts(spark: S, d: str) -> DataFrame:
    p = V.px(spark, d).where("prob is not null").withColumn("v", F.col("prob"))
    m = I.mask_cascade(p, "v", {"urban": "(row + col) % 11 < 2", "forest": "(row + col) % 7 < 3", "clip": "lin % 5 = 0"})
    return m.groupBy("reason").agg(F.count("*").alias("n"), F.round(F.sum("prob"), 5).alias("total"))


GRID = GridSpec(0.0, 1000.0, 1.0, 1000, 1000)
CELLS = "SELECT r.row::INTEGER AS row, c.col::INTEGER AS col, max(id)::BIGINT AS id FROM b, LATERAL (SELECT unnest(range(greatest(0, floor(998-y1))::BIGINT, least(1000, ceil(1002-y0))::BIGINT)) AS row) r, LATERAL (SELECT unnest(range(greatest(0, floor(x0-2))::BIGINT, least(1000, ceil(x1+2))::BIGINT)) AS col) c WHERE {} GROUP BY 1,2"


@query(sql(CELLS.format("c.col+0.5>=x0 AND c.col+0.5<x1 AND 1000-(r.row+0.5)>=y0 AND 1000-(r.row+0.5)<y1"), b=RECT))
def rasterize_rect_center(spark: S, d: str) -> DataFrame:
    return I.burn_rectangles(rects(spark, d), GRID)


@query(sql(CELLS.format("c.col+1>x0 AND c.col<x1 AND 1000-r.row>y0 AND 1000-(r.row+1)<y1"), b=RECT))
def rasterize_rect_touched(spark: S, d: str) -> DataFrame:
    return I.burn_rectangles(rects(spark, d), GRID, True)


@query(sql(CELLS.format("c.col+1>x0 AND c.col<x1 AND 1000-r.row>y0 AND 1000-(r.row+1)<y1"), b=RECT2))
def dual_resolution_burn(spark: S, d: str) -> DataFrame:
    return I.dual_burn(big_rects(spark, d), GRID)


@query("SELECT p_partkey AS id, dense_rank() OVER (ORDER BY g, t)::INTEGER AS code FROM (SELECT p_partkey, CASE WHEN p_size%10=0 THEN 'NA' ELSE p_type END AS g, CASE WHEN p_size%7=0 THEN 'NA' ELSE p_brand END AS t FROM part)")
def soil_codes(spark: S, d: str) -> DataFrame:
    p = V.table(spark, d, "part").selectExpr("p_partkey as id", "case when p_size % 10 = 0 then '' else p_type end as g", "case when p_size % 7 <> 0 then p_brand end as t")
    return I.category_codes(p, ["g", "t"]).select("id", "code")


@query(sql(f"SELECT a.row, a.col, a.prob, round({ELEV.replace('row','a.row').replace('col','a.col').replace('raw','a.raw')},6)::DOUBLE AS elev, CASE WHEN a.lin%3=0 THEN a.raw END AS third FROM px a", "px"))
def stack_assembly(spark: S, d: str) -> DataFrame:
    p = elev(V.px(spark, d))
    return _rounded(I.stack(p.select("row", "col", "prob"), [p.select("row", "col", "elev"), p.where("lin % 3 = 0").select("row", "col", F.col("raw").alias("third"))]))


@query(sql("SELECT row, col, max(code) AS code FROM (SELECT row, col, 1 AS code FROM px WHERE prob>=0.3 UNION ALL SELECT row, col, 2 FROM px WHERE (row+col)%7<3 UNION ALL SELECT row, col, 3 FROM px WHERE lin%5=0) GROUP BY 1,2", "px"))
def max_merge_burn(spark: S, d: str) -> DataFrame:
    p = V.px(spark, d)
    return U.merge_greatest([(p.where("prob >= 0.3"), 1), (V.peat(p), 2), (p.where("lin % 5 = 0"), 3)])


@query(sql("SELECT lin FROM px WHERE prob>=0.5 AND (row+col)%7<3 AND NOT lin%5=0 UNION SELECT lin FROM px WHERE prob>=0.95", "px"))
def mask_algebra(spark: S, d: str) -> DataFrame:
    p = V.px(spark, d)
    return U.mask_algebra(p.where("prob >= 0.5"), V.peat(p), p.where("lin % 5 = 0"), p.where("prob >= 0.95"), "lin")
