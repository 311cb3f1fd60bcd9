"""Adapter views: pixel grids, zones, points and samples made of the given tables by formulas that Spark and SQL share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, lin, raw, prob, valid, etype, x, y): prob is null where the pixel isn't valid."""
    return table(spark, sf_dir, "events").selectExpr(
        "cast(event_id div 100 as int) as row", "cast(event_id % 100 as int) as col", "event_id as lin", "value as raw",
        "case when event_type <> 'error' then least(value / 100.0D, 1.0D) end as prob", "event_type <> 'error' as valid", "event_type as etype",
        "400000.0D + (event_id % 100 + 0.5D) * 10.0D as x", "300000.0D - ((event_id div 100) + 0.5D) * 10.0D as y",
    )


def px_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px(spark, sf_dir).withColumn("label", F.expr("case etype when 'view' then 0 when 'click' then 1 when 'purchase' then 2 when 'signup' then 3 end"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr("n_nationkey + 1 as zone_id", "n_name as zone_name", "4 * n_nationkey as cmin", "4 * n_nationkey + 3 as cmax")


def zone_columns(z: DataFrame, pad: int = 0) -> DataFrame:
    """`z` with a row for each column `zcol` of a zone, `pad` more on either side: what turns a join by extent into an equi-join."""
    return z.withColumn("zcol", F.explode(F.sequence(F.col("cmin") - pad, F.col("cmax") + pad)))


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "cast((c_custkey * 7919) % 10007 as double) as x", "cast((c_custkey * 6271) % 10009 as double) as y", "abs(c_acctbal) / 1000.0D as area_ha", "c_nationkey as region")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id as sample_id", "embedding as features", "label % 4 as label", "cast((vec_id * 7919) % 20011 as double) as x", "cast((vec_id * 6271) % 20021 as double) as y")


def oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px_label(spark, sf_dir).where("label is not null").selectExpr("lin as sample_id", "cast(lin % 5 as int) as fold", "cast(label >= 2 as int) as y", "label as y_original", "prob as p")


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("user_id % 50 as cell", "date_trunc('day', ts) as slice_id", "value")


def species(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey as id", "case when p_size % 10 = 0 then '' else p_name end as pri", "p_type as sec", "p_brand as code", "p_name as name", "p_size as size")


SQL = {
    "px": "SELECT (event_id//100)::INTEGER AS row, (event_id%100)::INTEGER AS col, event_id AS lin, value AS raw, CASE WHEN event_type<>'error' THEN least(value/100.0::DOUBLE,1.0::DOUBLE) END AS prob, event_type<>'error' AS valid, event_type AS etype, 400000.0::DOUBLE+(event_id%100+0.5::DOUBLE)*10.0::DOUBLE AS x, 300000.0::DOUBLE-((event_id//100)+0.5::DOUBLE)*10.0::DOUBLE AS y FROM events",
    "px_label": "SELECT *, CASE etype WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 END AS label FROM px",
    "zones": "SELECT n_nationkey+1 AS zone_id, n_name AS zone_name, 4*n_nationkey AS cmin, 4*n_nationkey+3 AS cmax FROM nation",
    "pts": "SELECT c_custkey AS id, ((c_custkey*7919)%10007)::DOUBLE AS x, ((c_custkey*6271)%10009)::DOUBLE AS y, abs(c_acctbal)/1000.0::DOUBLE AS area_ha, c_nationkey AS region FROM customer",
    "samples": "SELECT vec_id AS sample_id, embedding AS features, label%4 AS label, ((vec_id*7919)%20011)::DOUBLE AS x, ((vec_id*6271)%20021)::DOUBLE AS y FROM embeddings",
    "oof": "SELECT lin AS sample_id, (lin%5)::INTEGER AS fold, (label>=2)::INTEGER AS y, label AS y_original, prob AS p FROM px_label WHERE label IS NOT NULL",
    "slices": "SELECT user_id%50 AS cell, date_trunc('day', ts) AS slice_id, value FROM events",
    "species": "SELECT p_partkey AS id, CASE WHEN p_size%10=0 THEN '' ELSE p_name END AS pri, p_type AS sec, p_brand AS code, p_name AS name, p_size AS size FROM part",
}
_NEEDS = {"px_label": ["px"], "oof": ["px", "px_label"]}


def sql(body: str, *views: str, **more: str) -> str:
    """A query over views, and over further named selects."""
    names = dict.fromkeys(n for v in views for n in [*_NEEDS.get(v, []), v])
    parts = [f"{n} AS ({SQL[n]})" for n in names] + [f"{n} AS ({q})" for n, q in more.items()]
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body


def peat(df: DataFrame, modulus: int = 7, below: int = 3) -> DataFrame:
    return df.where((F.col("row") + F.col("col")) % modulus < below)
