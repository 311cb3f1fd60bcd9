"""Queries of sections G, K, L and M, and of the evaluation rows of F."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.quantiles import percentiles
from ..operators import evaluate as E
from ..operators import models as M
from ..operators import sampling as K
from ..operators import summaries as U
from ..sources import views as V
from ..sources.views import sql
from .base import query
from .q_patches import _rounded

S = SparkSession
BLOCK = {
    "e": "SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, greatest(10, floor((max(x)-min(x))/2000)) AS nx, greatest(10, floor((max(y)-min(y))/2000)) AS ny FROM pts",
    "bl": "SELECT pts.*, pts.id%4 AS label, least(floor((x-x0)/(x1-x0)*nx), nx-1)::INTEGER AS bx, least(floor((y-y0)/(y1-y0)*ny), ny-1)::INTEGER AS by, (least(floor((x-x0)/(x1-x0)*nx), nx-1)*ny+least(floor((y-y0)/(y1-y0)*ny), ny-1))::BIGINT AS block FROM pts, e",
    "fo": "SELECT block, ((row_number() OVER (ORDER BY md5(block::VARCHAR), block)-1)%5)::INTEGER AS fold FROM (SELECT DISTINCT block FROM bl)",
    "bf": "SELECT bl.*, fold FROM bl JOIN fo USING (block)",
    "dr": "SELECT *, row_number() OVER (PARTITION BY block, label ORDER BY md5(id::VARCHAR), id) AS t FROM bl",
}


def blocked(spark: S, d: str) -> DataFrame:
    return K.spatial_blocks(V.pts(spark, d).withColumn("label", F.col("id") % 4))


@query(sql("SELECT id, bx, \"by\", block FROM bl", "pts", **BLOCK))
def spatial_blocks(spark: S, d: str) -> DataFrame:
    return blocked(spark, d).select("id", "bx", "by", "block")


@query(sql("SELECT id, block, fold FROM bf", "pts", **BLOCK))
def spatial_folds(spark: S, d: str) -> DataFrame:
    return K.assign_folds(blocked(spark, d), 5).select("id", "block", "fold")


@query(sql("SELECT id FROM bf WHERE fold<>2 AND NOT EXISTS (SELECT 1 FROM bf t WHERE t.fold=2 AND abs(t.bx-bf.bx)<=1 AND abs(t.by-bf.by)<=1)", "pts", **BLOCK))
def buffer_exclusion(spark: S, d: str) -> DataFrame:
    return K.buffer_exclusion(K.assign_folds(blocked(spark, d), 5), 2).select("id")


REB = "SELECT id, np>0 AND n0+n1>0 AND (label>=2 OR (label=0 AND t<=k0) OR (label=1 AND t<=k1)) AS kept FROM dr JOIN (SELECT *, least(n1, w1+greatest(0, w0-n0)) AS k1, least(n0, w0+greatest(0, w1-n1)) AS k0 FROM (SELECT *, floor(q*0.6) AS w1, q-floor(q*0.6) AS w0 FROM (SELECT *, least(floor(np*0.5), n0+n1) AS q FROM (SELECT block, count(*) FILTER (WHERE label>=2) AS np, count(*) FILTER (WHERE label=0) AS n0, count(*) FILTER (WHERE label=1) AS n1 FROM bl GROUP BY 1)))) USING (block)"


@query(sql("SELECT id FROM r WHERE kept", "pts", **BLOCK, r=REB))
def rebalance_kept(spark: S, d: str) -> DataFrame:
    return K.rebalance(blocked(spark, d), 0.5, 0.6).where("kept").select("id")


@query(sql("SELECT id FROM r WHERE NOT kept", "pts", **BLOCK, r=REB))
def rebalance_discarded(spark: S, d: str) -> DataFrame:
    return K.rebalance(blocked(spark, d), 0.5, 0.6).where("not kept").select("id")


@query(sql("SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY region ORDER BY md5(id::VARCHAR), id) AS t FROM pts) WHERE t<=5", "pts"))
def balanced_sample(spark: S, d: str) -> DataFrame:
    return K.balanced(V.pts(spark, d), 5, "region").select("id")


@query(sql("SELECT id, r<=n AS held FROM bl JOIN (SELECT block, row_number() OVER (ORDER BY md5(block::VARCHAR), block) AS r, greatest(1, floor(count(*) OVER ()*0.2)) AS n FROM (SELECT DISTINCT block FROM bl)) USING (block)", "pts", **BLOCK))
def block_holdout(spark: S, d: str) -> DataFrame:
    return K.block_holdout(blocked(spark, d)).select("id", "held")


@query(sql("SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY region, label ORDER BY md5(id::VARCHAR), id) AS t, count(*) OVER (PARTITION BY region) AS n, count(*) OVER (PARTITION BY region, label) AS c FROM bl) WHERE n<=5 OR t<=floor(5.0::DOUBLE*c/n)", "pts", **BLOCK))
def proportional_sample(spark: S, d: str) -> DataFrame:
    return K.proportional(blocked(spark, d), 5, "region").select("id")


STRAT = "SELECT id, md5(id::VARCHAR) AS h, t<=q AS picked FROM (SELECT id, region, row_number() OVER (PARTITION BY region ORDER BY md5(id::VARCHAR), id) AS t FROM pts) JOIN (SELECT region, 130//count(*) OVER ()+((row_number() OVER (ORDER BY region)-1)<130%count(*) OVER ())::INTEGER AS q FROM pts GROUP BY region) USING (region)"


@query(sql("SELECT id FROM (SELECT id FROM z WHERE picked) UNION ALL SELECT id FROM (SELECT id, row_number() OVER (ORDER BY h, id) AS rn FROM z WHERE NOT picked) WHERE rn <= 130-(SELECT count(*) FROM z WHERE picked)", "pts", z=STRAT))
def stratified_sample(spark: S, d: str) -> DataFrame:
    return K.stratified(V.pts(spark, d), 130, "region").select("id")


@query(sql("SELECT id FROM (SELECT lin AS id, row_number() OVER (PARTITION BY zone_id ORDER BY md5(lin::VARCHAR), lin) AS t FROM px JOIN zones ON col BETWEEN cmin AND cmax) WHERE t<=20", "px", "zones"))
def polygon_capped_sample(spark: S, d: str) -> DataFrame:
    from .q_patches import zoned

    return K.balanced(zoned(spark, d).withColumn("id", F.col("lin")), 20, "zone_id").select("id")


@query(sql("SELECT id FROM (SELECT lin AS id, p, row_number() OVER (PARTITION BY p ORDER BY md5(lin::VARCHAR), lin) AS t, count(*) FILTER (WHERE p) OVER () AS a, count(*) FILTER (WHERE NOT p) OVER () AS b FROM (SELECT lin, (row+col)%7<3 AS p FROM px WHERE prob>=0.97)) WHERE t <= CASE WHEN p THEN least(a, 40+greatest(0,40-b)) ELSE least(b, 40+greatest(0,40-a)) END", "px"))
def peat_balanced_sample(spark: S, d: str) -> DataFrame:
    p = V.px(spark, d).where("prob >= 0.97").selectExpr("lin as id", "(row + col) % 7 < 3 as p")
    return K.split_strata(p, 80, "p").select("id")


@query(sql("SELECT id FROM pts ORDER BY md5(id::VARCHAR), id LIMIT 100", "pts"))
def uniform_sample(spark: S, d: str) -> DataFrame:
    return K.uniform(V.pts(spark, d), 100).select("id")


@query(sql("SELECT lin AS id, prob FROM (SELECT *, row_number() OVER (PARTITION BY col//10 ORDER BY md5(lin::VARCHAR), lin) AS t FROM px_label WHERE label IN (0,1) AND NOT EXISTS (SELECT 1 FROM zones WHERE zone_id%5=0 AND col BETWEEN cmin-1 AND cmax+1)) WHERE t<=8 AND prob IS NOT NULL", "px_label", "zones"))
def negative_calibration_sample(spark: S, d: str) -> DataFrame:
    p, z = V.px_label(spark, d).where("label in (0, 1)"), V.zone_columns(V.zones(spark, d).where("zone_id % 5 = 0"), 1)
    free = p.join(z, F.col("col") == F.col("zcol"), "left_anti").selectExpr("lin as id", "prob", "col div 10 as cell")
    return K.balanced(free, 8, "cell").where("prob is not null").select("id", "prob")


@query(sql("SELECT fold FROM (SELECT fold, count(*) AS n, sum(y) AS p FROM oof GROUP BY 1), (SELECT count(*) AS tn, sum(y) AS tp FROM oof) WHERE n>=100 AND tn-n>=100 AND p>0 AND p<n AND tp>p AND tn-n>tp-p ORDER BY n DESC, fold LIMIT 1", "oof"))
def validation_fold(spark: S, d: str) -> DataFrame:
    return K.validation_fold(V.oof(spark, d), 100)


CONF = "SELECT fold, count(*) FILTER (WHERE p>0.5 AND y=1) AS tp, count(*) FILTER (WHERE p>0.5 AND y=0) AS fp, count(*) FILTER (WHERE p<=0.5 AND y=1) AS fn, count(*) FILTER (WHERE p<=0.5 AND y=0) AS tn FROM oof GROUP BY 1"
MET = "SELECT *, tp/(tp+fp) AS precision, tp/(tp+fn) AS recall, 2*tp/(2*tp+fp+fn) AS f1, (tp/(tp+fn)+tn/(tn+fp))/2 AS balanced_accuracy FROM c"


@query(sql("SELECT fold, tp, fp, fn, tn, round(precision,6) AS precision, round(recall,6) AS recall, round(f1,6) AS f1, round(balanced_accuracy,6) AS balanced_accuracy FROM m", "oof", c=CONF, m=MET))
def confusion_metrics(spark: S, d: str) -> DataFrame:
    return _rounded(E.metrics(V.oof(spark, d), 0.5, ["fold"]))


@query(sql("SELECT round(avg(f1),6) AS f1_mean, round(stddev_pop(f1),6) AS f1_std, round(avg(recall),6) AS recall_mean, round(stddev_pop(recall),6) AS recall_std FROM m", "oof", c=CONF, m=MET))
def metric_spread(spark: S, d: str) -> DataFrame:
    m = E.metrics(V.oof(spark, d), 0.5, ["fold"])
    return m.agg(*[F.round(f(c), 6).alias(f"{c}_{n}") for c in ("f1", "recall") for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


@query(sql("SELECT round((sum(CASE WHEN y=1 THEN mr END)-np*(np+1)/2)/(np*(n-np)),6) AS auroc FROM (SELECT y, rank() OVER (ORDER BY p)+(count(*) OVER (PARTITION BY p)-1)/2.0::DOUBLE AS mr, sum(y) OVER () AS np, count(*) OVER () AS n FROM oof) GROUP BY np, n", "oof"))
def auroc(spark: S, d: str) -> DataFrame:
    return _rounded(E.auroc(V.oof(spark, d)))


@query(sql("SELECT round(sum(pos*tp/seen)/sum(pos),6) AS ap FROM (SELECT pos, sum(pos) OVER (ORDER BY p DESC)::DOUBLE AS tp, sum(n) OVER (ORDER BY p DESC)::DOUBLE AS seen FROM (SELECT p, sum(y)::DOUBLE AS pos, count(*) AS n FROM oof GROUP BY 1))", "oof"))
def average_precision(spark: S, d: str) -> DataFrame:
    return _rounded(E.average_precision(V.oof(spark, d)))


@query(sql("SELECT y_original, count(*) AS n, count(*) FILTER (WHERE p>0.7) AS fp, round(100.0*count(*) FILTER (WHERE p>0.7)/count(*),6) AS fp_pct FROM oof WHERE y=0 GROUP BY 1", "oof"))
def fp_by_class(spark: S, d: str) -> DataFrame:
    return _rounded(U.false_positives(V.oof(spark, d), "y_original", 0.7))


GRID = [k / 100.0 for k in range(1, 100)]
SW = "SELECT t.i/100.0::DOUBLE AS threshold, count(*) FILTER (WHERE p>=t.i/100.0::DOUBLE AND y=1) AS tp, count(*) FILTER (WHERE p>=t.i/100.0::DOUBLE AND y=0) AS fp, count(*) FILTER (WHERE p<t.i/100.0::DOUBLE AND y=1) AS fn, count(*) FILTER (WHERE p<t.i/100.0::DOUBLE AND y=0) AS tn FROM oof, (SELECT unnest(range(1,100)) AS i) t GROUP BY t.i"
ADJ = "SELECT threshold, tp*0.05/(tp+fn) AS a, fn*0.05/(tp+fn) AS f, fp*0.95/(fp+tn) AS b FROM sw"


@query(sql("SELECT threshold, tp, fp, fn, tn FROM sw", "oof", sw=SW))
def threshold_sweep(spark: S, d: str) -> DataFrame:
    return E.sweep(V.oof(spark, d), GRID)


@query(sql("SELECT threshold, round(a/nullif(a+b,0),6) AS precision, round(a/(a+f),6) AS recall, round(coalesce(5*a/nullif(5*a+4*f+b,0),0),6) AS fbeta FROM ad", "oof", sw=SW, ad=ADJ))
def prevalence_sweep(spark: S, d: str) -> DataFrame:
    return _rounded(E.adjusted(E.sweep(V.oof(spark, d), GRID), 0.05, 2.0))


@query(sql("SELECT threshold, fbeta FROM (SELECT threshold, round(coalesce(5*a/nullif(5*a+4*f+b,0),0),6) AS fbeta FROM ad) ORDER BY fbeta DESC, threshold LIMIT 1", "oof", sw=SW, ad=ADJ))
def best_threshold(spark: S, d: str) -> DataFrame:
    return E.best_threshold(_rounded(E.adjusted(E.sweep(V.oof(spark, d), GRID), 0.05, 2.0)), "fbeta")


SWF = SW.replace("SELECT t.i", "SELECT fold, t.i", 1).replace("GROUP BY t.i", "GROUP BY fold, t.i")
POL = "SELECT threshold, round(quantile_cont(ppv,0.25),9) AS precision_q, round(avg(tpr),9) AS recall FROM (SELECT threshold, tp/(tp+fn) AS tpr, (tp/(tp+fn)*0.1)/nullif(tp/(tp+fn)*0.1+fp/(fp+tn)*0.9,0) AS ppv FROM sf) GROUP BY 1"


@query(sql("SELECT threshold, precision_q, recall, 0 AS feasible FROM po WHERE precision_q IS NOT NULL ORDER BY precision_q DESC, recall DESC, threshold DESC LIMIT 1", "oof", sf=SWF, po=POL))
def policy_threshold(spark: S, d: str) -> DataFrame:
    return E.policy(E.sweep(V.oof(spark, d), GRID, ["fold"]), 0.1, 0.25, 0.9)


@query(sql("SELECT threshold, precision_q, recall, 1 AS feasible FROM po WHERE precision_q >= 0.095 ORDER BY recall DESC, precision_q DESC, threshold DESC LIMIT 1", "oof", sf=SWF, po=POL))
def policy_threshold_feasible(spark: S, d: str) -> DataFrame:
    return E.policy(E.sweep(V.oof(spark, d), GRID, ["fold"]), 0.1, 0.25, 0.095)


@query("SELECT seed, ratio, round(greatest(0.01, least(seed*ratio, seed-0.01)),6)::DOUBLE AS low FROM (SELECT unnest([0.05, 0.3, 0.5]::DOUBLE[]) AS seed), (SELECT unnest([0.5, 0.67, 0.75]::DOUBLE[]) AS ratio)")
def expand_thresholds(spark: S, d: str) -> DataFrame:
    s = spark.range(1).select(F.explode(F.array(*map(F.lit, (0.05, 0.3, 0.5)))).alias("seed")).select("seed", F.explode(F.array(*map(F.lit, (0.5, 0.67, 0.75)))).alias("ratio"))
    return s.withColumn("low", F.round(U.expanded(F.col("seed"), F.col("ratio")), 6))


HALF = [k / 100.0 for k in range(1, 51)]
FPR = "SELECT t.i/100.0::DOUBLE AS threshold, count(*) FILTER (WHERE p>=t.i/100.0::DOUBLE) AS fp_total, count(*) FILTER (WHERE p>=t.i/100.0::DOUBLE)/count(*) AS fpr FROM (SELECT pow(p,3) AS p FROM oof WHERE y=0), (SELECT unnest(range(1,51)) AS i) t GROUP BY t.i"


def fpr_curve(spark: S, d: str) -> DataFrame:
    s = E.sweep(V.oof(spark, d).where("y = 0").withColumn("p", F.pow("p", F.lit(3.0))), HALF)
    return cut(s.select("threshold", F.col("fp").alias("fp_total"), (F.col("fp") / (F.col("fp") + F.col("tn"))).alias("fpr")))


@query(sql("SELECT threshold, fp_total, round(fpr,6) AS fpr FROM c", "oof", c=FPR))
def discarded_fpr_sweep(spark: S, d: str) -> DataFrame:
    return _rounded(fpr_curve(spark, d))


@query(sql("SELECT count(*) AS n, round(avg(p),6) AS mean, round(quantile_cont(p,0.95),6) AS q95, round(quantile_cont(p,0.99),6) AS q99, max(p) AS top FROM oof WHERE y=0", "oof"))
def discarded_summary(spark: S, d: str) -> DataFrame:
    o = V.oof(spark, d).where("y = 0")
    s = o.agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean"), F.max("p").alias("top")).crossJoin(F.broadcast(percentiles(o, "p", [0.95, 0.99])))  # one row each
    return s.select("n", "mean", F.round(F.col("q")[0], 6).alias("q95"), F.round(F.col("q")[1], 6).alias("q99"), "top")


@query(sql("SELECT target, max(CASE WHEN fpr>=target THEN threshold END) AS threshold FROM c, (SELECT unnest([0.1, 0.5, 0.999]::DOUBLE[]) AS target) GROUP BY 1", "oof", c=FPR))
def fpr_crossings(spark: S, d: str) -> DataFrame:
    return E.crossings(fpr_curve(spark, d), [0.1, 0.5, 0.999])


@query(sql("SELECT checkpoint, threshold, round(fpr,6) AS fpr FROM (SELECT *, row_number() OVER (PARTITION BY checkpoint ORDER BY round(abs(threshold-checkpoint),9), threshold DESC) AS rn FROM c, (SELECT unnest([0.155, 0.3, 0.9]::DOUBLE[]) AS checkpoint)) WHERE rn=1", "oof", c=FPR))
def fpr_checkpoints(spark: S, d: str) -> DataFrame:
    return _rounded(E.checkpoints(fpr_curve(spark, d), [0.155, 0.3, 0.9]))


@query(sql("SELECT threshold, round(fpr,6) AS fpr FROM c WHERE round(threshold,2) BETWEEN 0.15 AND 0.30", "oof", c=FPR))
def sweep_slice(spark: S, d: str) -> DataFrame:
    return _rounded(fpr_curve(spark, d).where(F.round("threshold", 2).between(0.15, 0.30)).select("threshold", "fpr"))


@query(
    sql(
        "SELECT round(t,6) AS threshold, round(sl+sr,6) AS sse, round(1-(sl+sr)/(SELECT regr_syy(ly,threshold)-regr_sxy(ly,threshold)*regr_sxy(ly,threshold)/regr_sxx(ly,threshold) FROM l),6) AS improvement FROM sp ORDER BY round(sl+sr,9), t LIMIT 1",
        "oof",
        c=FPR,
        l="SELECT threshold, log10(greatest(fpr,1e-8)) AS ly FROM c",
        sp="SELECT a.t, (SELECT regr_syy(ly,threshold)-regr_sxy(ly,threshold)*regr_sxy(ly,threshold)/regr_sxx(ly,threshold) FROM l WHERE threshold<=a.t) AS sl, (SELECT regr_syy(ly,threshold)-regr_sxy(ly,threshold)*regr_sxy(ly,threshold)/regr_sxx(ly,threshold) FROM l WHERE threshold>=a.t) AS sr FROM (SELECT threshold AS t FROM l) a WHERE a.t BETWEEN 0.045 AND 0.465",
    )
)
def fpr_breakpoint(spark: S, d: str) -> DataFrame:
    return _rounded(E.breakpoint(fpr_curve(spark, d)))


SC = "SELECT y, CASE WHEN y=1 THEN 1-p ELSE p END AS s FROM oof"
CQ = "SELECT y, n, min(s) AS q FROM (SELECT y, s, row_number() OVER (PARTITION BY y ORDER BY s) AS rn, count(*) OVER (PARTITION BY y) AS n FROM sc) WHERE rn=least(greatest(ceil((n+1)*(1-0.2::DOUBLE)-1e-9),1),n) GROUP BY 1,2"


def quantiles(spark: S, d: str) -> DataFrame:
    o = V.oof(spark, d).select("y", F.when(F.col("y") == 1, 1 - F.col("p")).otherwise(F.col("p")).alias("s"))
    return E.conformal_quantile(o, 0.2, ["y"])


@query(sql("SELECT y, n, round(q,6) AS q FROM cq", "oof", sc=SC, cq=CQ))
def conformal_quantile(spark: S, d: str) -> DataFrame:
    return _rounded(quantiles(spark, d))


CLS = "SELECT lin, prob, CASE WHEN prob IS NULL THEN NULL WHEN 1-prob<=qp AND NOT prob<=qn THEN 2 WHEN prob<=qn AND NOT 1-prob<=qp THEN 0 ELSE 1 END AS cls, prob>=1-qp AS wet_other, prob>=qn AS wet_fpr FROM px, (SELECT max(CASE WHEN y=1 THEN q END) AS qp, max(CASE WHEN y=0 THEN q END) AS qn FROM cq)"


def classified(spark: S, d: str) -> DataFrame:
    q = quantiles(spark, d).agg(F.max(F.when(F.col("y") == 1, F.col("q"))).alias("qp"), F.max(F.when(F.col("y") == 0, F.col("q"))).alias("qn"))
    p = V.px(spark, d).crossJoin(F.broadcast(q))  # one row
    return p.select("lin", "prob", E.conformal_class(F.col("prob"), F.col("qp"), F.col("qn")).alias("cls"), (F.col("prob") >= 1 - F.col("qp")).alias("wet_other"), (F.col("prob") >= F.col("qn")).alias("wet_fpr"))


@query(sql("SELECT lin, cls FROM k", "px", "oof", sc=SC, cq=CQ, k=CLS))
def conformal_classes(spark: S, d: str) -> DataFrame:
    return classified(spark, d).select("lin", "cls")


@query(sql("SELECT count(*) FILTER (WHERE wet_other) AS n_other, count(*) FILTER (WHERE wet_fpr) AS n_fpr, round(100.0*count(*) FILTER (WHERE wet_fpr)/count(prob),6) AS fpr_pct FROM k", "px", "oof", sc=SC, cq=CQ, k=CLS))
def confident_mask(spark: S, d: str) -> DataFrame:
    n = lambda c: F.count(F.when(F.col(c), 1))
    return classified(spark, d).agg(n("wet_other").alias("n_other"), n("wet_fpr").alias("n_fpr"), F.round(100.0 * n("wet_fpr") / F.count("prob"), 6).alias("fpr_pct"))


@query(sql("SELECT sample_id, list_position(features, list_max(features))-1 AS cls FROM samples", "samples").replace("-1 AS cls", "::INTEGER-1 AS cls"))
def argmax_class(spark: S, d: str) -> DataFrame:
    return V.samples(spark, d).select("sample_id", M.argmax_class(F.col("features")).alias("cls"))


@query(sql("SELECT sample_id, round(p,6) AS p, (p>0.5)::INTEGER AS pred FROM (SELECT sample_id, 1/(1+exp(-(features[1]::DOUBLE*3-features[2]::DOUBLE*2+0.1))) AS p FROM samples)", "samples"))
def batch_predict(spark: S, d: str) -> DataFrame:
    p = M.predict_linear(V.samples(spark, d), [3.0, -2.0] + [0.0] * 62, 0.1, 0.5)
    return p.select("sample_id", F.round("p", 6).alias("p"), "pred")


@query(sql("SELECT sample_id, round(m/k,6) AS weight FROM (SELECT sample_id, count(*) OVER (PARTITION BY floor(x/3000), floor(y/3000)) AS k, (SELECT count(*)/count(DISTINCT (floor(x/3000), floor(y/3000))) FROM samples) AS m FROM samples)", "samples"))
def distance_weights(spark: S, d: str) -> DataFrame:
    return M.distance_weights(V.samples(spark, d), 3000.0).select("sample_id", F.round("weight", 6).alias("weight"))


def training(spark: S, d: str) -> DataFrame:
    return V.samples(spark, d).selectExpr("sample_id", "transform(features, x -> cast(x as double)) as features", "cast(label >= 2 as int) as y", "cast(sample_id % 3 as int) as fold")


@query()
def gbt_oof_scores(spark: S, d: str) -> DataFrame:
    return M.gbt_oof(cut(training(spark, d)), [0, 1, 2], trees=5).withColumn("p", F.round("p", 6))


@query()
def gbt_tuning(spark: S, d: str) -> DataFrame:
    return M.tune(cut(training(spark, d)), [{"maxIter": 3, "maxDepth": 2}, {"maxIter": 3, "maxDepth": 3}], 0)


def presence(spark: S, d: str) -> DataFrame:
    return cut(V.px(spark, d).where("valid").selectExpr("lin as sample_id", "cast(row as double) as a", "cast(col as double) as b", "cast((row + 2 * col) % 50 < 12 and prob > 0.5 as int) as y"))


@query()
def maxent_suitability(spark: S, d: str) -> DataFrame:
    return M.maxent(presence(spark, d), ["a", "b"]).select("sample_id", "y", F.round("suitability", 6).alias("suitability"))


@query()
def permutation_importance(spark: S, d: str) -> DataFrame:
    p = presence(spark, d)
    score = lambda df: df.withColumn("p", 1 / (1 + F.exp(-(F.col("b") - 50) / 25)))
    return M.permutation_importance(p, score, ["a", "b"], lambda df: E.auroc(df.select("p", "y")).first()[0])


@query()
def crf_refinement(spark: S, d: str) -> DataFrame:
    p = V.px(spark, d).select("row", "col", "prob", (F.col("raw") / 100.0).alias("guide"))
    return M.crf(p, 25, 4).withColumn("p", F.round("p", 6))
