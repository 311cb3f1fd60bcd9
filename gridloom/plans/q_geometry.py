"""Queries of polygons in general: diamonds, whose joins, areas and pixels have closed forms in rotated coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import GridSpec
from ..operators import geometry as G
from ..operators import resample as R
from ..sources import views as V
from ..sources.views import sql
from .base import query, spec

S = SparkSession
#: |x - cx| + |y - cy| <= r, of two families of centres.
DIAMONDS = {
    "da": "SELECT c_custkey AS id, ((c_custkey*7919)%10007)::DOUBLE AS cx, ((c_custkey*6271)%10009)::DOUBLE AS cy, 20.0+c_custkey%90 AS r FROM customer",
    "db": "SELECT s_suppkey AS id, ((s_suppkey*7907)%10007)::DOUBLE AS cx, ((s_suppkey*6257)%10009)::DOUBLE AS cy, 150.0+s_suppkey%400 AS r FROM supplier",
}


def diamonds(spark: S, d: str, kind: str, more: float = 0.0) -> DataFrame:
    t, k, m, n, r = ("customer", "c_custkey", 7919, 6271, "20.0D + c_custkey % 90") if kind == "da" else ("supplier", "s_suppkey", 7907, 6257, "150.0D + s_suppkey % 400")
    c = V.table(spark, d, t).selectExpr(f"{k} as poly_id", f"cast(({k} * {m}) % 10007 as double) as cx", f"cast(({k} * {n}) % 10009 as double) as cy", f"{r} + {more}D as r")
    return c.select("poly_id", F.expr("array(named_struct('x', cx + r, 'y', cy), named_struct('x', cx, 'y', cy + r), named_struct('x', cx - r, 'y', cy), named_struct('x', cx, 'y', cy - r))").cast(G.RING).alias("ring"))


@query(sql("SELECT da.id AS a_id, db.id AS b_id FROM da, db WHERE abs(da.cx-db.cx)+abs(da.cy-db.cy)<=da.r+db.r", **DIAMONDS))
def polygons_intersecting(spark: S, d: str) -> DataFrame:
    return G.intersecting(diamonds(spark, d, "da"), diamonds(spark, d, "db"), 400.0)


@query(sql("SELECT (SELECT count(*) FROM da WHERE EXISTS (SELECT 1 FROM db WHERE abs(da.cx-db.cx)+abs(da.cy-db.cy)<=da.r+db.r)) AS touching, (SELECT count(*) FROM da WHERE NOT EXISTS (SELECT 1 FROM db WHERE abs(da.cx-db.cx)+abs(da.cy-db.cy)<=da.r+db.r)) AS apart", **DIAMONDS))
def polygons_split(spark: S, d: str) -> DataFrame:
    a = diamonds(spark, d, "da")
    hit = G.touching(a, diamonds(spark, d, "db"), 400.0)
    n = a.join(hit, a.poly_id == hit.a_id, "left").agg(F.count("a_id").alias("touching"), F.count("*").alias("n"))
    return n.select("touching", (F.col("n") - F.col("touching")).alias("apart"))


ROTATED = "SELECT da.id AS a_id, db.id AS b_id, (least(da.cx+da.cy+da.r,db.cx+db.cy+db.r)-greatest(da.cx+da.cy-da.r,db.cx+db.cy-db.r))*(least(da.cx-da.cy+da.r,db.cx-db.cy+db.r)-greatest(da.cx-da.cy-da.r,db.cx-db.cy-db.r))/2 AS a, least(da.cx+da.cy+da.r,db.cx+db.cy+db.r)>greatest(da.cx+da.cy-da.r,db.cx+db.cy-db.r) AND least(da.cx-da.cy+da.r,db.cx-db.cy+db.r)>greatest(da.cx-da.cy-da.r,db.cx-db.cy-db.r) AS ok FROM da, db"


@query(sql(f"SELECT a_id, b_id, round(a,4) AS intersection_area FROM ({ROTATED}) WHERE ok AND a>1e-10", **DIAMONDS))
def polygon_intersection_area(spark: S, d: str) -> DataFrame:
    """Squares turned by 45 degrees: in the coordinates x + y and x - y they are upright."""
    return G.intersection_areas(diamonds(spark, d, "da"), diamonds(spark, d, "db"), 400.0).withColumn("intersection_area", F.round("intersection_area", 4))


GRID = GridSpec(0.0, 10009.0, 25.0, 401, 401)
CELL = "SELECT r.i AS row, c.i AS col, c.i*25.0 AS xl, 10009.0-r.i*25.0 AS yt FROM (SELECT unnest(range(401))::INTEGER AS i) r, (SELECT unnest(range(401))::INTEGER AS i) c"


@query(sql("SELECT db.id AS poly_id, row, col FROM db JOIN c ON row BETWEEN floor((10009-cy-r)/25)-1 AND floor((10009-cy+r)/25)+1 AND col BETWEEN floor((cx-r)/25)-1 AND floor((cx+r)/25)+1 WHERE abs(xl+12.5-cx)+abs(yt-12.5-cy)<r", c=CELL, **DIAMONDS))
def polygon_pixels(spark: S, d: str) -> DataFrame:
    """Centre rule. Offsets of centres end in .5, so that their sums are whole and centres do lie on edges: those are outside."""
    return G.burn(diamonds(spark, d, "db"), GRID)


@query(sql("SELECT row, col, max(id) AS poly_id FROM (SELECT id, row, col FROM db JOIN c ON row BETWEEN floor((10009-cy-r)/25)-1 AND floor((10009-cy+r)/25)+1 AND col BETWEEN floor((cx-r)/25)-1 AND floor((cx+r)/25)+1 WHERE greatest(xl-cx,0,cx-xl-25)+greatest(yt-25-cy,0,cy-yt)<r) GROUP BY 1,2", c=CELL, **(DIAMONDS | {"db": DIAMONDS["db"].replace("150.0", "150.3")})))
def polygons_touched(spark: S, d: str) -> DataFrame:
    """Any touch, the greatest id on top; radii that aren't whole, so that no edge meets just a pixel's corner."""
    return G.burn_last(diamonds(spark, d, "db", 0.3), GRID, True)


@query(sql("SELECT db.id AS poly_id, row, col FROM db JOIN c ON row BETWEEN floor((10009-cy-r)/25)-1 AND floor((10009-cy+r)/25)+1 AND col BETWEEN floor((cx-r)/25)-1 AND floor((cx+r)/25)+1 WHERE abs(xl-cx)+abs(yt-cy)<r-0.25", c=CELL, **(DIAMONDS | {"db": DIAMONDS["db"].replace("150.0", "150.25")})))
def polygon_pixels_by_corner(spark: S, d: str) -> DataFrame:
    """Upper left corners (C16); a corner on an edge is outside."""
    p = diamonds(spark, d, "db")
    return G.burn(p, GRID, at=(0.0, 0.0))


ZD = "SELECT zone_id AS id, 400000.0+(cmin+10)*10.0+3 AS cx, 300000.0-(zone_id*17%8+2)*10.0-3 AS cy, 71.5+zone_id AS r FROM zones"


@query(sql("SELECT zd.id AS poly_id, count(*) AS pixels, count(prob) AS valid, round(avg(prob),6) AS mean_prob, count(*) FILTER (WHERE prob>=0.5) AS wet FROM px JOIN zd ON abs(px.x-cx)+abs(px.y-cy)<r GROUP BY 1", "px", "zones", zd=ZD))
def masked_polygon_read(spark: S, d: str) -> DataFrame:
    z = V.zones(spark, d).selectExpr("zone_id as poly_id", "400000.0D + (cmin + 10) * 10.0D + 3 as cx", "300000.0D - (zone_id * 17 % 8 + 2) * 10.0D - 3 as cy", "71.5D + zone_id as r")
    p = z.select("poly_id", F.expr("array(named_struct('x', cx + r, 'y', cy), named_struct('x', cx, 'y', cy + r), named_struct('x', cx - r, 'y', cy), named_struct('x', cx, 'y', cy - r))").cast(G.RING).alias("ring"))
    return G.read_polygons(V.px(spark, d), p, spec(spark, d)).groupBy("poly_id").agg(F.count("*").alias("pixels"), F.count("prob").alias("valid"), F.round(F.avg("prob"), 6).alias("mean_prob"), F.count(F.when(F.col("prob") >= 0.5, 1)).alias("wet"))


@query("SELECT id AS poly_id, round(abs(w*h)::DOUBLE,6) AS area FROM (SELECT c_custkey AS id, c_custkey%9 AS w, c_custkey%7 AS h FROM customer) WHERE w*h<>0")
def repaired_polygons(spark: S, d: str) -> DataFrame:
    """Rectangles with repeated and closing vertices, some of them of no width or height."""
    c = V.table(spark, d, "customer").selectExpr("c_custkey as poly_id", "cast(c_custkey % 9 as double) as w", "cast(c_custkey % 7 as double) as h")
    p = c.select("poly_id", F.expr("array(named_struct('x', 0D, 'y', 0D), named_struct('x', w, 'y', 0D), named_struct('x', w, 'y', 0D), named_struct('x', w, 'y', h), null, named_struct('x', 0D, 'y', h), named_struct('x', 0D, 'y', 0D))").cast(G.RING).alias("ring"))
    return G.repair(p).select("poly_id", F.round(G.area(F.col("ring")), 6).alias("area"))


@query(
    sql(
        "SELECT etype, count(DISTINCT region) AS regions, count(*) AS cells FROM (SELECT b.etype, b.lin, min(l.region) AS region FROM b JOIN l USING (lin) GROUP BY 1,2) GROUP BY 1",
        "px",
        b="SELECT * FROM px WHERE row<12 AND col<20 AND etype<>'error'",
        l="SELECT lin, lin AS region FROM b UNION SELECT n.lin, l.region FROM l JOIN b o ON o.lin=l.lin JOIN b n ON n.etype=o.etype AND abs(n.row-o.row)+abs(n.col-o.col)=1",
    )
)
def vectorised_regions(spark: S, d: str) -> DataFrame:
    """4-connected regions of equal class in the upper left corner of the raster, as a window read."""
    window = V.px(spark, d).where("row < 12 and col < 20").select("row", "col", "lin", "etype")
    return G.vectorise(window, "etype", ("error",)).groupBy("etype").agg(F.countDistinct("region_id").alias("regions"), F.count("*").alias("cells"))


@query(sql("SELECT cells, CASE WHEN cells>most THEN greatest(2, ceil(sqrt(cells/most)))::INTEGER ELSE 1 END AS factor FROM (SELECT count(*) AS cells FROM px), (SELECT 1000.0 AS most)", "px"))
def coarsening(spark: S, d: str) -> DataFrame:
    """The factor by which a raster over 1,000 cells is made coarser."""
    n = V.px(spark, d).count()
    return spark.createDataFrame([(n, R.coarsening_factor(n, 1000))], "cells long, factor int")
