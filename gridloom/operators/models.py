"""Models (section M) on pyspark.ml, and what surrounds them."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gbt_oof(df: DataFrame, folds: list[int], trees: int = 10, depth: int = 3, seed: int = 42) -> DataFrame:
    """(sample_id, fold, y, p): one boosted model a fold, trained on the others, scores its rows (M1). Rows: features, y, fold."""
    v = df.withColumn("v", array_to_vector("features")).withColumn("label", F.col("y").cast("double"))
    def one(k: int) -> DataFrame:
        model = GBTClassifier(featuresCol="v", labelCol="label", maxIter=trees, maxDepth=depth, seed=seed).fit(v.where(F.col("fold") != k))
        return model.transform(v.where(F.col("fold") == k)).select("sample_id", "fold", "y", vector_to_array("probability")[1].alias("p"))
    return reduce(DataFrame.unionByName, [one(k) for k in folds])


def tune(df: DataFrame, grid: list[dict], val_fold: int, seed: int = 42) -> DataFrame:
    """(params, auprc) of a random grid on one validation fold (M2)."""
    v = df.withColumn("v", array_to_vector("features")).withColumn("label", F.col("y").cast("double"))
    train, val = v.where(F.col("fold") != val_fold), v.where(F.col("fold") == val_fold)
    ev = BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderPR")
    rows = [(str(sorted(g.items())), float(ev.evaluate(GBTClassifier(featuresCol="v", labelCol="label", seed=seed, **g).fit(train).transform(val)))) for g in grid]
    return df.sparkSession.createDataFrame(rows, "params string, auprc double")


def predict_linear(df: DataFrame, weights: list[float], bias: float, threshold: float) -> DataFrame:
    """Scores of a linear model by built-in expressions; missing features give NULL, > threshold is 1 (M3)."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    dot = F.aggregate(F.zip_with(F.col("features"), w, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    p = 1 / (1 + F.exp(-(dot + F.lit(bias))))
    ok = F.forall("features", lambda x: x.isNotNull() & ~F.isnan(x))
    return df.withColumn("p", F.when(ok, p)).withColumn("pred", (F.col("p") > threshold).cast("int"))


def fit_logistic(df: DataFrame, ridge: float = 0.01, steps: int = 8) -> tuple[list[float], float]:
    """(weights, intercept) of a ridge logistic regression on (features, y), by Newton steps of one aggregation each: what is collected is as wide as the features, squared."""
    k = len(df.select("features").first()[0]) + 1
    w = np.zeros(k)
    x = df.select(F.concat(F.transform("features", lambda v: v.cast("double")), F.array(F.lit(1.0))).alias("x"), F.col("y").cast("double").alias("y")).where("y is not null and forall(x, v -> v is not null and not isnan(v))")
    for _ in range(steps):
        def sums(batches, w=w):
            grad, hess = np.zeros(k), np.zeros((k, k))
            for pdf in batches:
                if len(pdf):
                    m = np.stack(pdf.x.to_numpy())
                    p = 1 / (1 + np.exp(-m @ w))
                    grad += m.T @ (pdf.y.to_numpy() - p)
                    hess += (m * (p * (1 - p))[:, None]).T @ m
            yield pd.DataFrame({"i": np.arange(k + k * k), "v": np.append(grad, hess.ravel())})

        total = np.zeros(k + k * k)
        for r in x.mapInPandas(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            total[r.i] = r.v
        reg = np.diag(np.append(np.full(k - 1, ridge), 1e-9))
        step = np.linalg.solve(total[k:].reshape(k, k) + reg, total[:k] - reg @ w)
        w = w + step
        if np.abs(step).max() < 1e-10:
            break
    return w[:-1].tolist(), float(w[-1])


def geographic_folds(df: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """`df` with `fold`: k-means clusters of (x, y), numbered by their centres."""
    from pyspark.ml.clustering import KMeans

    v = VectorAssembler(inputCols=["x", "y"], outputCol="__gl_v").transform(df)
    model = KMeans(k=k, seed=seed, featuresCol="__gl_v", predictionCol="__gl_c").fit(v)
    order = {c: i for i, (_, c) in enumerate(sorted((tuple(float(z) for z in m), c) for c, m in enumerate(model.clusterCenters())))}
    number = F.create_map(*[F.lit(z) for kv in order.items() for z in kv])
    return model.transform(v).withColumn("fold", number[F.col("__gl_c")]).drop("__gl_v", "__gl_c")


def near_distance_weights(df: DataFrame, cell: float, id_col: str = "id") -> DataFrame:
    """(id, weight): the distance to the nearest other sample over the mean of all, so that crowded samples weigh less."""
    from ..functions.lineage import cut
    from .spatial_join import nearest_other

    nn = cut(nearest_other(df.select(F.col(id_col).alias("id"), "x", "y"), cell))
    return nn.crossJoin(F.broadcast(nn.agg(F.avg("nn").alias("__gl_m")))).select("id", F.try_divide(F.col("nn"), F.col("__gl_m")).alias("weight"))  # one row


def argmax_class(scores: Column) -> Column:
    """The first class of the greatest score (M4)."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def maxent_features(df: DataFrame, bands: list[str], knots: int = 4) -> tuple[DataFrame, list[str]]:
    """Linear, quadratic, product and hinge features of bands scaled to [0, 1]; knots at percentiles (M6)."""
    qs = [i / (knots + 1) for i in range(1, knots + 1)]
    row = df.agg(*[F.min(b).alias(f"{b}_lo") for b in bands], *[F.max(b).alias(f"{b}_hi") for b in bands], *[F.percentile(b, F.array(*map(F.lit, qs))).alias(f"{b}_q") for b in bands]).first()
    cols: dict[str, Column] = {}
    unit = {}
    for b in bands:
        lo, width = row[f"{b}_lo"], (row[f"{b}_hi"] - row[f"{b}_lo"]) or 1.0
        unit[b] = F.greatest(F.least((F.col(b) - lo) / width, F.lit(1.0)), F.lit(0.0))
        cols[f"f_{b}"], cols[f"f_{b}_sq"] = unit[b], unit[b] * unit[b]
        for i, q in enumerate(row[f"{b}_q"]):
            k = (q - lo) / width
            cols[f"f_{b}_h{i}"] = F.greatest(unit[b] - k, F.lit(0.0)) / (1 - k if k < 1 else 1.0)
    for i, a in enumerate(bands):
        for b in bands[i + 1 :]:
            cols[f"f_{a}_{b}"] = unit[a] * unit[b]
    return df.withColumns(cols), list(cols)


def maxent(df: DataFrame, bands: list[str], reg: float = 1e-5, weight: float = 100.0) -> DataFrame:
    """`suitability` of all rows by infinitely weighted logistic regression of presence (y = 1) against background (Fithian and Hastie, 2013) (M6)."""
    f, names = maxent_features(df, bands)
    v = VectorAssembler(inputCols=names, outputCol="v", handleInvalid="skip").transform(f).withColumn("w", F.when(F.col("y") == 1, 1.0).otherwise(weight))
    model = LogisticRegression(featuresCol="v", labelCol="y", weightCol="w", regParam=reg, elasticNetParam=0.5, maxIter=50).fit(v.withColumn("y", F.col("y").cast("double")))
    out = model.transform(v)
    # the cloglog of the relative rate, whose intercept makes its mean over background 1
    scored = out.withColumn("eta", vector_to_array("rawPrediction")[1])
    mean = scored.where("y = 0").agg(F.avg(F.exp("eta")).alias("m"))
    return scored.crossJoin(F.broadcast(mean)).withColumn("suitability", 1 - F.exp(-F.exp("eta") / F.col("m"))).drop("v", "w", "m", "eta", "rawPrediction", "probability", "prediction", *names)


def permutation_importance(df: DataFrame, score, bands: list[str], metric, id_col: str = "sample_id") -> DataFrame:
    """(band, drop): what a metric loses when a band's values are dealt anew, by the next value in md5 order within 1,024 hash groups (M7)."""
    from pyspark.sql import Window

    base = metric(score(df))
    rows = []
    for b in bands:
        w = Window.partitionBy(F.pmod(F.xxhash64(id_col), F.lit(1024))).orderBy(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(b))))
        moved = df.withColumn(b, F.coalesce(F.lag(b).over(w), F.col(b)))
        rows.append((b, float(base - metric(score(moved)))))
    return df.sparkSession.createDataFrame(rows, "band string, drop double")


def distance_weights(df: DataFrame, cell: float) -> DataFrame:
    """Sample weights by local density: one over the rows in a row's cell, scaled to a mean of 1."""
    c = df.groupBy(F.floor(F.col("x") / cell).alias("i"), F.floor(F.col("y") / cell).alias("j")).agg(F.count("*").alias("k"))
    n = c.agg((F.sum("k") / F.count("*")).alias("mean"))
    return df.withColumns({"i": F.floor(F.col("x") / cell), "j": F.floor(F.col("y") / cell)}).join(c, ["i", "j"]).crossJoin(F.broadcast(n)).withColumn("weight", F.col("mean") / F.col("k")).drop("i", "j", "k", "mean")


def crf(df: DataFrame, size: int, halo: int, rounds: int = 5, spread: float = 2.0, colour: float = 0.3, weight: float = 1.5) -> DataFrame:
    """(row, col, p): mean-field refinement of a probability by Gaussian and bilateral neighbours within the halo, tile by tile (M5)."""
    o = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    t = df.select("row", "col", "prob", "guide", o.alias("a")).select("*", o.alias("b")).withColumns({"tr": F.expr(f"row div {size}") + F.col("a"), "tc": F.expr(f"col div {size}") + F.col("b")})
    near = F.col("row").between(F.col("tr") * size - halo, (F.col("tr") + 1) * size - 1 + halo) & F.col("col").between(F.col("tc") * size - halo, (F.col("tc") + 1) * size - 1 + halo) & (F.col("tr") >= 0) & (F.col("tc") >= 0)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["row"].min()), int(pdf["col"].min())
        shape = (int(pdf["row"].max()) - r0 + 1, int(pdf["col"].max()) - c0 + 1)
        p, g = np.full(shape, np.nan), np.zeros(shape)
        p[pdf["row"] - r0, pdf["col"] - c0] = pdf["prob"]
        g[pdf["row"] - r0, pdf["col"] - c0] = pdf["guide"]
        have = ~np.isnan(p)
        unary = np.log(np.clip(np.nan_to_num(p, nan=0.5), 1e-6, 1 - 1e-6))
        unary = unary - np.log(1 - np.exp(unary))
        q = np.where(have, np.nan_to_num(p, nan=0.5), 0.5)
        k = min(halo, int(3 * spread))
        for _ in range(rounds):
            msg, norm = np.zeros(shape), np.zeros(shape)
            for a in range(-k, k + 1):
                for b in range(-k, k + 1):
                    if (a or b) and abs(a) < shape[0] and abs(b) < shape[1]:
                        dst = (slice(max(0, a), shape[0] + min(0, a)), slice(max(0, b), shape[1] + min(0, b)))
                        src = (slice(max(0, -a), shape[0] + min(0, -a)), slice(max(0, -b), shape[1] + min(0, -b)))
                        w = np.exp(-(a * a + b * b) / (2 * spread**2)) * (0.5 + 0.5 * np.exp(-((g[dst] - g[src]) ** 2) / (2 * colour**2))) * have[src]
                        msg[dst] += w * (2 * q[src] - 1)
                        norm[dst] += w
            q = 1 / (1 + np.exp(-(unary + weight * msg / np.maximum(norm, 1e-9))))
        own = pdf[(pdf["row"] // size == int(key[0])) & (pdf["col"] // size == int(key[1])) & pdf["prob"].notna()]
        return pd.DataFrame({"row": own["row"], "col": own["col"], "p": q[own["row"] - r0, own["col"] - c0]})

    return t.where(near).groupBy("tr", "tc").applyInPandas(run, "row int, col int, p double")
