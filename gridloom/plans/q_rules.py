"""Queries of section J."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..sources import views as V
from ..sources.views import sql
from .base import query

S = SparkSession
NAMES = ["ring", "rod", "gear", "bolt", "widget"]
TARGET = ["ring", "rod", "gear"]


def _has(c: str, n: str) -> str:
    return f"regexp_matches(lower(trim({c})), '\\b{n}\\b')"


def _any(c: str, names: list[str]) -> str:
    return "(" + " OR ".join(_has(c, n) for n in names) + ")"


@query(sql("SELECT id, concat_ws(',', " + ", ".join(f"CASE WHEN {_has('pri', n)} THEN '{n}' END" for n in NAMES) + ") AS hits FROM species", "species"))
def species_hits(spark: S, d: str) -> DataFrame:
    return V.species(spark, d).select("id", F.array_join(R.word_hits(F.col("pri"), NAMES), ",").alias("hits"))


@query(sql("SELECT id, code IN ('BRAND#1','BRAND#7') OR regexp_matches(lower(pri), '\\bbolt\\b') AS birch FROM (SELECT id, pri, upper(trim(code)) AS code FROM species)", "species"))
def birch_rule(spark: S, d: str) -> DataFrame:
    return V.species(spark, d).select("id", R.is_birch(F.col("pri"), F.col("code"), ("BRAND#1", "BRAND#7"), "bolt").alias("birch"))


ONLY = f"CASE WHEN pri IN ('','nan','none','n/a') THEN true WHEN NOT {_any('pri', NAMES)} THEN false ELSE NOT {_any('pri', ['bolt', 'widget'])} END"


@query(sql(f"SELECT id, {ONLY} AS ok FROM species", "species"))
def only_allowed_species(spark: S, d: str) -> DataFrame:
    return V.species(spark, d).select("id", R.only_allowed(F.col("pri"), TARGET, NAMES).alias("ok"))


@query(sql(f"SELECT id, {_any('name', TARGET)} AND ({_has('name', 'ring')} OR {_has('pri', 'ring')}) AND NOT ({_has('name', 'red')} OR {_has('pri', 'red')}) AS off_peat FROM species", "species"))
def off_peat_rule(spark: S, d: str) -> DataFrame:
    return V.species(spark, d).select("id", R.off_peat(F.col("name"), [F.col("pri")], TARGET, "ring", "red", True).alias("off_peat"))


@query(sql(f"SELECT id, {_any('name', TARGET)} AND {ONLY} AS on_peat FROM species", "species"))
def on_peat_rule(spark: S, d: str) -> DataFrame:
    return V.species(spark, d).select("id", R.on_peat(F.col("name"), [F.col("pri")], TARGET, NAMES).alias("on_peat"))


DEC, EVG = ["ring", "rod", "an"], ["gear", "bolt", "mo"]


def _n(c: str, names: list[str]) -> str:
    return "(" + "+".join(f"contains(lower({c}),'{n}')::INTEGER" for n in names) + ")"


@query(sql(f"SELECT id, CASE WHEN d>0 AND e=0 THEN 1 WHEN e>0 AND d=0 THEN 2 ELSE 0 END AS type FROM (SELECT id, {_n('pri', DEC)}+{_n('sec', DEC)} AS d, {_n('pri', EVG)}+{_n('sec', EVG)} AS e FROM species)", "species"))
def functional_type(spark: S, d: str) -> DataFrame:
    return V.species(spark, d).select("id", R.functional_type([F.col("pri"), F.col("sec")], DEC, EVG).alias("type"))


@query(sql(f"SELECT id, CASE WHEN d>e THEN 1 WHEN e>d THEN 0 WHEN {_n('pri', EVG)}>{_n('pri', DEC)} THEN 0 ELSE 1 END AS label FROM (SELECT id, pri, {_n('pri', DEC)}+{_n('sec', DEC)} AS d, {_n('pri', EVG)}+{_n('sec', EVG)} AS e FROM species)", "species"))
def dry_functional_type(spark: S, d: str) -> DataFrame:
    return V.species(spark, d).select("id", R.dry_type(F.col("pri"), [F.col("sec")], DEC, EVG).alias("label"))


@query(sql(f"SELECT id FROM species WHERE (pri='' OR {_any('pri', TARGET)})", "species"))
def species_filter(spark: S, d: str) -> DataFrame:
    return V.species(spark, d).where(R.species_filter([F.col("pri")], TARGET)).select("id")


@query("SELECT CASE WHEN max(c)>0 THEN 'code' WHEN max(s)>0 THEN 'sec' WHEN max(n)>0 THEN 'name' END AS col FROM (" + sql(f"SELECT {_any('code', NAMES)}::INTEGER AS c, {_any('sec', NAMES)}::INTEGER AS s, {_any('name', NAMES)}::INTEGER AS n FROM species", "species") + ")")
def species_column(spark: S, d: str) -> DataFrame:
    found = R.species_column(V.species(spark, d).select("code", "sec", "name"), ["code", "missing"], NAMES)
    return spark.createDataFrame([(found,)], "col string")


LAB = f"SELECT id, CASE WHEN size%7<3 AND {_any('name', TARGET)} AND {ONLY} THEN 2 WHEN size%7>=3 AND {_any('name', TARGET)} AND {_has('name', 'ring')} THEN 3 ELSE CASE WHEN d>e THEN 1 WHEN e>d THEN 0 WHEN {_n('name', EVG)}>{_n('name', DEC)} THEN 0 ELSE 1 END END AS label FROM (SELECT *, {_n('name', DEC)}+{_n('sec', DEC)} AS d, {_n('name', EVG)}+{_n('sec', EVG)} AS e FROM species)"


@query(sql("SELECT id, label, CASE label WHEN 0 THEN 'evergreen' WHEN 1 THEN 'deciduous' WHEN 2 THEN 'target_on_peat' ELSE 'target_off_peat' END AS name FROM l", "species", l=LAB))
def label_classes(spark: S, d: str) -> DataFrame:
    s = V.species(spark, d)
    on = F.col("size") % 7 < 3
    label = F.when(on & R.on_peat(F.col("name"), [F.col("pri")], TARGET, NAMES), 2).when(~on & R.off_peat(F.col("name"), [], TARGET, "ring", "red"), 3).otherwise(R.dry_type(F.col("name"), [F.col("sec")], DEC, EVG))
    return s.select("id", label.alias("label")).withColumn("name", R.class_name(F.col("label"), {0: "evergreen", 1: "deciduous", 2: "target_on_peat", 3: "target_off_peat"}))


GRADES = ["Grade 1", "grade_2", " Grade-3a ", "Non_Agricultural", "Urban", "Exclusion 4", "5.0", "", "4"]
GRADE_SQL = "CASE " + " ".join(f"WHEN k={i} THEN '{g}'" for i, g in enumerate(GRADES)) + " END"


@query(sql("SELECT id, CASE k WHEN 0 THEN '1-2' WHEN 1 THEN '1-2' WHEN 2 THEN '3' WHEN 3 THEN '4-6' WHEN 6 THEN '4-6' WHEN 8 THEN '4-6' ELSE 'unknown' END AS grp FROM (SELECT id, size%10 AS k FROM species)", "species"))
def grade_groups(spark: S, d: str) -> DataFrame:
    g = V.species(spark, d).withColumn("g", F.expr(GRADE_SQL.replace("k=", "size % 10=")))
    return g.select("id", R.grade_group(F.col("g")).alias("grp"))


@query(sql("SELECT id, CASE lower(sec) WHEN 'economy' THEN 1 WHEN 'standard' THEN 2 WHEN 'promo' THEN 3 ELSE 0 END AS code, 4 AS none FROM species", "species"))
def woodland_type_code(spark: S, d: str) -> DataFrame:
    return V.species(spark, d).select("id", R.encode_type(F.col("sec"), {"Economy": 1, "STANDARD": 2, "Promo": 3}).alias("code"), R.encode_type(None, {}).alias("none"))


@query("SELECT id, CASE WHEN k=1 THEN b ELSE b || '_' || k END AS safe FROM (SELECT id, b, row_number() OVER (PARTITION BY b ORDER BY id) AS k FROM (SELECT p_partkey AS id, regexp_replace(regexp_replace('-' || p_name || '/' || p_brand || ' ', '[^0-9A-Za-z]+', '_', 'g'), '^_+|_+$', '', 'g') AS b FROM part))")
def safe_labels(spark: S, d: str) -> DataFrame:
    p = V.table(spark, d, "part").selectExpr("p_partkey as id", "concat('-', p_name, '/', p_brand, ' ') as label")
    return R.safe_labels(p, "label", "id").select("id", "safe")


@query("SELECT p_partkey AS id, p_name || '|' || p_type AS items FROM part WHERE p_name<>p_type")
def parse_lists(spark: S, d: str) -> DataFrame:
    p = V.table(spark, d, "part").where("p_name <> p_type").selectExpr("p_partkey as id", "concat(' ', p_name, ', ', p_type, ' ,,', p_name) as csv")
    return p.select("id", F.array_join(R.parse_list(F.col("csv")), "|").alias("items"))


@query("SELECT arg_max('m_' || p_size || '.json', p_size*1000000 + p_partkey) AS path FROM part")
def newest_model(spark: S, d: str) -> DataFrame:
    p = V.table(spark, d, "part").selectExpr("concat('m_', p_size, '.json') as path", "p_partkey as mtime")
    return R.newest(p, "path", "mtime")


@query(sql("SELECT CASE WHEN n>0 THEN 'split_bg_0123' ELSE 'legacy_012' END AS schema, CASE WHEN n>0 THEN '2,3' ELSE '2' END AS positive FROM (SELECT count(*) FILTER (WHERE label=3) AS n FROM px_label)", "px_label"))
def label_schema(spark: S, d: str) -> DataFrame:
    return R.label_schema(V.px_label(spark, d), "label")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_inspection(spark: S, d: str) -> DataFrame:
    return V.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query(sql("SELECT lin, round(CASE WHEN raw<=10 THEN 0 WHEN raw<40 THEN (raw-10)/30*100 WHEN raw<80 THEN 100+(raw-40)/40*155 ELSE 255 END,5)::DOUBLE AS shade FROM px", "px"))
def colour_ramp(spark: S, d: str) -> DataFrame:
    return V.px(spark, d).select("lin", F.round(R.ramp(F.col("raw"), [(10.0, 0.0), (40.0, 100.0), (80.0, 255.0)]), 5).alias("shade"))
