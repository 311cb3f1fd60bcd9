import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import toxicity as T
from gridloom.llm.text import Chunk


def plain(s, t, n, d):
    out = 0.0
    for a in itertools.combinations(range(len(s)), n):
        for b in itertools.combinations(range(len(t)), n):
            if all(s[x] == t[y] for x, y in zip(a, b, strict=True)):
                out += d ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return out


@pytest.mark.parametrize(("n", "d"), [(3, 0.5), (4, 0.7), (2, 0.9)])
def test_kernel_against_all_subsequences(n, d):
    words = ["idiot", "idxiot", "abab", "tidi", "ab", "ébéa"]
    s, _ = T._codes(words)
    assert np.allclose(T.kernel(s, s, n, d), [[plain(a, b, n, d) for b in words] for a in words], rtol=1e-4)
    assert np.allclose(T.kernel(s, s[:, None, :], n, d)[:, 0], [plain(a, a, n, d) for a in words], rtol=1e-4)


def test_units_join_spelt_words():
    words, unit, doc = T.units(Chunk(pa.array(["an i d i o t here", "a b", None, "x y z"])))
    got = {(words[u], int(d)) for u, d in zip(unit, doc, strict=True)}
    assert ("idiot", 0) in got
    assert ("xyz", 3) in got
    assert ("ab", 1) not in got


def test_joins():
    names, unit, doc = T.joins(Chunk(pa.array(["a stu pid one", None, "stu", "pid stu pid", "i d i o t", "wonderfully id iot"])))
    got = {(names.to_pylist()[u], int(d)) for u, d in zip(unit, doc, strict=True)}
    assert {("stupid", 0), ("astupid", 0), ("stupid", 3), ("pidstupid", 3), ("idiot", 5)} <= got
    assert not any(d in (1, 2, 4) for _, d in got)
    assert not any("wonderfully" in w for w, _ in got)


def test_filtered_joins_are_those_that_may(trained):
    docs, _, model = trained
    texts = [r.text for r in docs.orderBy("doc_id").limit(60).collect()] + ["a b c stu p id i d iot x pathe tic", "mo r on lo ser id io t"]
    chunk = Chunk(pa.array(texts))
    names, unit, doc = T.joins(chunk)
    may = set(model.may(names).tolist())
    want = {(names[int(u)].as_py(), int(d)) for u, d in zip(unit, doc, strict=True) if int(u) in may}
    few, unit, doc = T.joins(chunk, model.trigrams)
    assert {(few[int(u)].as_py(), int(d)) for u, d in zip(unit, doc, strict=True)} == want
    assert want


def test_split_short_and_mislabelled_insults(spark):
    """Insults in pieces, of three letters, and in a text that is labelled clean by mistake."""
    rng = random.Random(5)
    syllables = ["the", "on", "er", "ti", "an", "re", "st", "ou", "in", "ea", "wh", "nd"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    bad = ["grumblix", "vontzeer", "skrabbok", "qux"]
    bags = [([word() for _ in range(30)] + ([bad[i % 4]] if i % 3 == 0 else []), int(i % 3 == 0)) for i in range(900)]
    bags += [([word() for _ in range(20)] + ["grumblix"], 0)]
    joined = sorted({a + b for words, y in bags if not y for a, b in zip(words[:29], words[1:30], strict=False) if len(a + b) <= 11} - set(bad))
    model = T.fit(bags, joined)
    texts = [("whole", f"the {b} there") for b in bad] + [("split", f"wonderfully {b[:k]} {b[k:]} wonderfully") for b in bad[:3] for k in range(2, len(b) - 1)] + [("clean", " ".join(word() for _ in range(40))) for _ in range(100)] + [("clean", "quxx qu x")]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    hit = {r.doc_id for r in T.toxic_documents(df, model).collect()}
    share = {k: np.mean([i in hit for i, (x, _) in enumerate(texts) if x == k]) for k in ("whole", "split", "clean")}
    assert share["whole"] == 1
    assert share["split"] >= 0.9
    assert share["clean"] <= 0.01


def test_whole_query_against_scoring_one_text_at_a_time(spark, trained):
    docs, _, model = trained
    rows = docs.orderBy("doc_id").limit(150).collect()
    want = {}
    for r in rows:
        chunk = Chunk(pa.array([r.text]))
        own = [w for w in T.units(chunk)[0] if len(w) > 1]
        scored = [(-round(float(s), 5), w) for w, s in zip(own, model.score(own), strict=True) if s > 0] if own else []
        for w in set(T.joins(chunk)[0].to_pylist()):
            grams = [T._trigrams(T._codes([w[i : i + 3]])[0])[0, 0] for i in range(len(w) - 2)]
            hits = sum(bool(model.trigrams[g]) for g in grams)
            if hits >= 2 and 2 * hits > len(w) - 2 and (s := float(model.score([w])[0])) > model.extra:
                scored.append((-round(s, 5), w))
        if scored:
            want[r.doc_id] = min(scored)[1]
    got = {r.doc_id: r.unit for r in T.toxic_documents(docs.where(docs.doc_id.isin([r.doc_id for r in rows])), model).collect()}
    assert got == want
    assert want


def test_integer_ids(spark, awkward):
    labels = spark.createDataFrame([(1, 1), (7, 0)], "doc_id int, toxic int")
    docs = awkward.withColumn("doc_id", awkward.doc_id.cast("int"))
    assert T.toxic_documents(docs, T.train(docs, labels)).count() == 0


@pytest.fixture(scope="module")
def trained(request):
    spark, data = request.getfixturevalue("spark"), request.getfixturevalue("data").replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    return docs, labels, T.train(docs, labels, max_labelled=300)


def test_held_out_accuracy(trained):
    """The labels that training did not see."""
    docs, labels, model = trained
    used = {r[0] for r in labels.orderBy(__import__("pyspark.sql.functions", fromlist=["x"]).expr("xxhash64(doc_id, 17)"), "doc_id").limit(300).collect()}
    hit = {r.doc_id for r in T.toxic_documents(docs, model).collect()}
    rest = [(r.doc_id, r.toxic) for r in labels.collect() if r.doc_id not in used]
    toxic = [i for i, t in rest if t]
    clean = [i for i, t in rest if not t]
    assert sum(i not in hit for i in clean) >= 0.97 * len(clean)
    if len(toxic) >= 5:
        assert sum(i in hit for i in toxic) >= 0.6 * len(toxic)


def test_gapped_and_inserted_characters(spark):
    """Trained on plain insults, the SVM knows them with a character put in, and leaves other words alone."""
    rng = random.Random(4)
    syllables = ["the", "on", "er", "ti", "an", "re", "st", "ou", "in", "ea", "wh", "nd"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    bad = ["grumblix", "vontzeer", "skrabbok", "quilpuzz"]
    bags = [([word() for _ in range(30)] + ([rng.choice(bad)] if i % 3 == 0 else []), int(i % 3 == 0)) for i in range(600)]
    model = T.fit(bags)
    texts = [("plain", f"the {b} there") for b in bad] + [("dots", f"the {'.'.join(b)} there") for b in bad] + [("spelt", f"the {' '.join(b)} there") for b in bad]
    for b in bad:
        texts += [("inserted", f"the {b[:k] + 'x' + b[k:]} there") for k in range(2, len(b) - 1)]
    texts += [("clean", " ".join(word() for _ in range(40))) for _ in range(100)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    hit = {r.doc_id for r in T.toxic_documents(df, model).collect()}
    share = {k: np.mean([i in hit for i, (x, _) in enumerate(texts) if x == k]) for k in ("plain", "dots", "spelt", "inserted", "clean")}
    assert share["plain"] == share["dots"] == share["spelt"] == 1
    assert share["inserted"] >= 0.8
    assert share["clean"] <= 0.01


def test_slices_give_the_same(spark, trained):
    docs, _, model = trained
    docs = docs.unionByName(docs)  # repeated rows count as often as they occur
    one = sorted(tuple(r) for r in T.toxic_documents(docs, model).collect())
    assert sorted(tuple(r) for r in T.toxic_documents(docs, model, limit=3).collect()) == one


def test_awkward(awkward, nothing, trained):
    _, labels, model = trained
    assert T.toxic_documents(awkward, model).count() == 0
    assert T.toxic_documents(nothing, model).count() == 0
    empty = T.train(awkward.selectExpr("doc_id", "text"), labels.limit(0))
    assert T.toxic_documents(awkward, empty).count() == 0
    assert T.toxic_documents(awkward.selectExpr("doc_id", "concat('x ', text) as text"), model).count() == 0
