"""Evaluation, thresholds, calibration (sections F16-F23, G5-G10, L)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.prefix import running_totals


def confusion(pred: Column, y: Column) -> list[Column]:
    n = lambda c: F.sum(c.cast("long"))
    return [n(pred & (y == 1)).alias("tp"), n(pred & (y == 0)).alias("fp"), n(~pred & (y == 1)).alias("fn"), n(~pred & (y == 0)).alias("tn")]


def metrics(df: DataFrame, threshold: float, by: list[str]) -> DataFrame:
    """Confusion counts and the usual ratios, NULL where they have no denominator; p > threshold is positive."""
    c = df.groupBy(*by).agg(*confusion(F.col("p") > threshold, F.col("y")))
    r = lambda a, b: F.try_divide(a, b)
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    return c.select("*", r(tp, tp + fp).alias("precision"), r(tp, tp + fn).alias("recall"), r(2 * tp, 2 * tp + fp + fn).alias("f1"), ((r(tp, tp + fn) + r(tn, tn + fp)) / 2).alias("balanced_accuracy"))


def auroc(df: DataFrame) -> DataFrame:
    """Area under the ROC curve by mid-ranks, from counts by score and range-partitioned running totals."""
    s = df.where("p is not null").groupBy("p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    r = running_totals(s, [F.col("p")], {"nc": "neg"})
    return r.agg((F.sum(F.col("pos") * (F.col("nc") - F.col("neg") / 2.0)) / (F.sum("pos") * F.sum("neg"))).alias("auroc"))


def average_precision(df: DataFrame) -> DataFrame:
    """Sum of (R_i - R_(i-1)) * P_i over distinct scores from the top."""
    s = df.where("p is not null").groupBy("p").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    r = running_totals(s, [F.col("p").desc()], {"tp": "pos", "seen": "n"})
    return r.agg((F.sum(F.col("pos") * F.col("tp") / F.col("seen")) / F.sum("pos")).alias("ap"))


def thresholds(spark: SparkSession, values: list[float]) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(float(v),) for v in values], "threshold double"))


def sweep(df: DataFrame, grid: list[float], by: list[str] | None = None) -> DataFrame:
    """Confusion counts of p >= threshold for every threshold of an ascending grid.

    Rows are counted by the number of thresholds that they reach, so the table is read once and nothing grows with
    rows x thresholds.
    """
    by, spark, k = by or [], df.sparkSession, len(grid)
    step = (grid[-1] - grid[0]) / max(1, k - 1)
    steps = F.array(*[F.lit(float(t)) for t in grid])
    if step > 0 and all(abs(grid[0] + i * step - t) < step / 4 for i, t in enumerate(grid)):
        # an even grid: the place follows from the value, and is put right by a step where rounding moved it
        near = F.greatest(F.lit(0), F.least(F.lit(k), F.floor((F.col("p") - grid[0]) / step).cast("int") + 1))
        at = lambda i: F.get(steps, i)
        reach = near + F.when((near < k) & (F.col("p") >= at(near)), 1).when((near > 0) & (F.col("p") < at(near - 1)), -1).otherwise(0)
    else:
        reach = F.size(F.filter(steps, lambda t: t <= F.col("p")))
    h = df.where("p is not null").groupBy(*by, reach.alias("k")).agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    keys = h.groupBy(*by).agg(F.sum("pos").alias("tp_all"), F.sum("n").alias("n_all"))
    t = F.broadcast(spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(grid)], "i int, threshold double"))
    full = keys.crossJoin(t)
    hh = h.select(*[F.col(c).alias(f"h_{c}") for c in by], "k", "pos", "n")
    cond = F.col("k") >= F.col("i")
    for c in by:
        cond &= F.col(c).eqNullSafe(F.col(f"h_{c}"))
    # at most groups x thresholds rows on either side
    c = full.join(F.broadcast(hh), cond, "left").groupBy(*by, "threshold", "tp_all", "n_all").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("n"), F.lit(0)).alias("pp"))
    return c.select(*by, "threshold", "tp", (F.col("pp") - F.col("tp")).alias("fp"), (F.col("tp_all") - F.col("tp")).alias("fn"), (F.col("n_all") - F.col("tp_all") - F.col("pp") + F.col("tp")).alias("tn"))


def adjusted(sweep_df: DataFrame, prevalence: float, beta: float) -> DataFrame:
    """Precision, recall and F-beta of a sweep at another prevalence: counts scaled by target / observed rates (L1)."""
    p, n = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    tp, fn = F.col("tp") * prevalence / p, F.col("fn") * prevalence / p
    fp = F.col("fp") * (1 - prevalence) / n
    b2 = beta * beta
    return sweep_df.select("threshold", F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), F.coalesce(F.try_divide((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp), F.lit(0.0)).alias("fbeta"))


def deployment_target(curve: DataFrame, target: float, eps: float = 1e-9) -> DataFrame:
    """(threshold, precision, recall, met): the first threshold whose precision reaches the target, else that of the greatest precision, the first of ties (L1)."""
    ok = F.col("precision") >= target - eps
    best = F.struct(ok.cast("int"), F.when(ok, 0.0).otherwise(F.col("precision")), -F.col("threshold"))
    return curve.where("precision is not null").agg(F.max_by(F.struct("threshold", "precision", "recall"), best).alias("s"), F.max(ok).alias("met")).select("s.*", "met")


def best_threshold(curve: DataFrame, score: str) -> DataFrame:
    """The first threshold of the greatest score (L1)."""
    return curve.agg(F.max_by(F.struct("threshold", score), F.struct(F.col(score), -F.col("threshold"))).alias("b")).select("b.threshold", f"b.{score}")


def policy(by_fold: DataFrame, prevalence: float, quantile: float, target: float) -> DataFrame:
    """The seed threshold (L2, G10): by fold TPR and FPR give the precision at a prevalence; its quantile over folds by threshold; if any
    threshold reaches the target the greatest (recall, precision, threshold) of those, else the greatest (precision, recall, threshold)."""
    tpr, fpr = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.try_divide(F.col("fp"), F.col("fp") + F.col("tn"))
    ppv = F.try_divide(tpr * prevalence, tpr * prevalence + fpr * (1 - prevalence))
    q = by_fold.select("threshold", tpr.alias("tpr"), ppv.alias("ppv")).groupBy("threshold").agg(F.round(F.percentile("ppv", F.lit(quantile)), 9).alias("precision_q"), F.round(F.avg("tpr"), 9).alias("recall"))
    ok = F.col("precision_q") >= target
    s = q.where("precision_q is not null").agg(F.max_by(F.struct("threshold", "precision_q", "recall"), F.when(ok, F.struct(F.lit(1).alias("f"), F.col("recall").alias("a"), F.col("precision_q").alias("b"), F.col("threshold").alias("c"))).otherwise(F.struct(F.lit(0).alias("f"), F.col("precision_q").alias("a"), F.col("recall").alias("b"), F.col("threshold").alias("c")))).alias("s"), F.max(ok.cast("int")).alias("feasible"))
    return s.select("s.*", "feasible")


def crossings(curve: DataFrame, targets: list[float]) -> DataFrame:
    """(target, threshold): the highest threshold whose FPR is at least the target."""
    t = F.broadcast(curve.sparkSession.createDataFrame([(float(v),) for v in targets], "target double"))
    return t.crossJoin(curve).groupBy("target").agg(F.max(F.when(F.col("fpr") >= F.col("target"), F.col("threshold"))).alias("threshold"))


def checkpoints(curve: DataFrame, at: list[float]) -> DataFrame:
    """(checkpoint, threshold, fpr): the nearest threshold of the curve; ties: the larger."""
    t = F.broadcast(curve.sparkSession.createDataFrame([(float(v),) for v in at], "checkpoint double"))
    d = F.round(F.abs(F.col("threshold") - F.col("checkpoint")), 9)
    return t.crossJoin(curve).groupBy("checkpoint").agg(F.min_by(F.struct("threshold", "fpr"), F.struct(d, -F.col("threshold"))).alias("s")).select("checkpoint", "s.threshold", "s.fpr")


def breakpoint(curve: DataFrame, least: int = 5) -> DataFrame:
    """(threshold, sse, improvement): the split of log10(max(fpr, 1e-8)) over the threshold into two regressions that share the boundary point,
    each of at least `least` points, with the least error (G9). A curve has as many rows as a sweep: it is small."""
    p = curve.select("threshold", F.log10(F.greatest(F.col("fpr"), F.lit(1e-8))).alias("ly"))
    w = Window.orderBy("threshold")
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    def sse(frame) -> Column:
        n, x, y = F.count("*").over(frame), F.avg("threshold").over(frame), F.avg("ly").over(frame)
        sxx = F.avg(F.col("threshold") * F.col("threshold")).over(frame) - x * x
        sxy = F.avg(F.col("threshold") * F.col("ly")).over(frame) - x * y
        syy = F.avg(F.col("ly") * F.col("ly")).over(frame) - y * y
        return F.greatest(F.lit(0.0), n * (syy - F.when(F.abs(sxx) < 1e-15, 0.0).otherwise(sxy * sxy / F.when(F.abs(sxx) < 1e-15, 1.0).otherwise(sxx))))
    s = p.select("threshold", F.count("*").over(up).alias("nl"), F.count("*").over(down).alias("nr"), sse(up).alias("sl"), sse(down).alias("sr"), sse(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("s1"))
    best = s.where((F.col("nl") >= least) & (F.col("nr") >= least)).agg(F.min_by(F.struct("threshold", (F.col("sl") + F.col("sr")).alias("sse"), "s1"), F.struct(F.round(F.col("sl") + F.col("sr"), 9), "threshold")).alias("b"))
    return best.select("b.threshold", "b.sse", (F.lit(1.0) - F.try_divide(F.col("b.sse"), F.col("b.s1"))).alias("improvement"))


def conformal_quantile(scores: DataFrame, alpha: float, by: list[str]) -> DataFrame:
    """(by, n, q): the score of rank ceil((n + 1)(1 - alpha)), clamped to 1..n (G5). Scores are counted by value before they are ranked."""
    n = scores.groupBy(*by).agg(F.count("*").alias("n"))
    c = scores.groupBy(*by, "s").agg(F.count("*").alias("k"))
    w = Window.partitionBy(*by).orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    rank = F.least(F.greatest(F.ceil((F.col("n") + 1) * F.lit(1 - alpha) - 1e-9), F.lit(1)), F.col("n"))
    return c.withColumn("upto", F.sum("k").over(w)).join(n, by).where(F.col("upto") >= rank).groupBy(*by, "n").agg(F.min("s").alias("q"))


def conformal_class(p: Column, q_pos: Column, q_neg: Column) -> Column:
    """2 if only the positive class is accepted, 0 if only the negative, else 1: both, or neither (L4)."""
    pos, neg = (1 - p) <= q_pos, p <= q_neg
    return F.when(p.isNull(), None).when(pos & ~neg, 2).when(neg & ~pos, 0).otherwise(1)
