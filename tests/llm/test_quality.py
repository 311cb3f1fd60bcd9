import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridloom.llm import quality as Q


def test_features_are_normed_counts():
    place, value, ends = Q.features(pa.array(["a b a b", None, "b b b", "!?", "  "]), 18)
    assert list(np.diff(ends)) == [4, 0, 4, 1, 0]  # a b "a b" "b a"; b = "b =" "= ="
    for i in (0, 2, 3):
        assert np.isclose((value[ends[i] : ends[i + 1]] ** 2).sum(), 1)


def test_ftrl_against_the_plain_update():
    rng = np.random.default_rng(0)
    samples = [(np.unique(rng.integers(0, 8, 3)), None, int(rng.integers(2))) for _ in range(40)]
    samples = [(p, np.ones(len(p)), y) for p, _, y in samples]
    z, n = [0.0] * 9, [0.0] * 9
    a, b, l1, l2 = 0.3, 1.0, 0.002, 0.02
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((b + n[i] ** 0.5) / a + l2)
    for p, _, y in samples * 2:
        at = [*p, 8]
        w = {i: weight(i) for i in at}
        g = 1 / (1 + np.exp(-sum(w.values()))) - y
        for i in at:
            s = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / a
            z[i] += g - s * w[i]
            n[i] += g * g
    assert np.allclose(Q.ftrl(samples, 3, epochs=2), [weight(i) for i in range(9)])


def test_held_out_accuracy(spark, data):
    d = data.replace("sf0.001", "sf0.01")  # the smallest scale has too few labels
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    w = Q.train(docs, labels, max_labelled=250)
    used = labels.orderBy(F.expr("xxhash64(doc_id, 17)"), "doc_id").limit(250).select("doc_id")
    rest = Q.score(docs, w).join(labels.join(used, "doc_id", "left_anti"), "doc_id").collect()
    good, bad = [r.keep for r in rest if r.quality], [not r.keep for r in rest if not r.quality]
    assert len(rest) > 100
    assert np.mean(good) >= 0.97
    assert np.mean(bad) >= 0.8


def test_keep_good_keeps_what_score_says(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    w = Q.train(docs, labels)
    kept = Q.keep_good(docs, w)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in Q.score(docs, w).where("keep").collect()}


def test_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (5, None), (7, 0), (6, 3)], "doc_id long, quality int")
    w = Q.train(awkward, labels)
    rows = Q.score(awkward, w).collect()
    assert len(rows) == 9
    assert not any(r.keep for r in rows if r.doc_id in (2, 3, 4))
    assert Q.keep_good(awkward, w).columns == awkward.columns
    assert Q.score(nothing, w).count() == Q.keep_good(nothing, w).count() == 0
    assert not Q.train(awkward, labels.limit(0)).any()


def test_integer_ids(spark, awkward):
    labels = spark.createDataFrame([(1, 1), (7, 0)], "doc_id int, quality int")
    docs = awkward.withColumn("doc_id", awkward.doc_id.cast("int"))
    w = Q.train(docs, labels)
    assert Q.score(docs, w).count() == 9
