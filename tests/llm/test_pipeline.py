"""The pipeline against a brute-force version of every stage, on the smallest tables."""

import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from gridloom.llm import quality
from gridloom.llm.mixing import fit
from gridloom.llm.substring import cut_words
from gridloom.llm.text import words_of

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(request, tmp_path_factory):
    """(name, rows before, rows after) of each stage, written and read again."""
    spark, d = request.getfixturevalue("spark"), request.getfixturevalue("data")
    base, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in P.STAGES:
        before = docs.collect()
        stage(spark, docs, d).write.parquet(str(base / name))
        docs = spark.read.parquet(str(base / name))
        out.append((name, before, docs.collect(), docs.columns))
    return out


def test_names_and_columns(stages):
    assert [s[0] for s in stages] == ["quality", "near_duplicates", "substring", "mixing", "packing"]
    for s in stages[:-1]:
        assert s[3] == COLUMNS
    assert P.ORACLE_SQL is None


def test_quality(spark, data, stages):
    """Dense weights, one document at a time, with n-grams counted by hand."""
    import re

    from gridloom.llm.text import hash_strings, mix

    _, before, after, _ = stages[0]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    w = quality.train(docs, spark.read.parquet(f"{data}/labels.parquet"))
    g = 0x9E3779B97F4A7C15

    def keep(text):
        tokens, last = [], None
        for run in (text or "").lower().split():
            word, marks = "".join(re.findall(r"[^\W_]+", run)), "".join(dict.fromkeys(re.sub(r"[^\W_]", "", run)))
            if word:
                h = int(hash_strings([word])[0])
                tokens.append(0x3D if word == last else h)
            if marks:
                tokens.append(int(hash_strings([marks])[0]) ^ g)
            last = word
        if not tokens:
            return False
        at = lambda v: int(mix(np.array([v % 2**64], np.uint64))[0]) >> 46
        counts = Counter([at(t) for t in tokens] + [at(a * g + b) for a, b in zip(tokens, tokens[1:], strict=False)])
        norm = math.sqrt(sum(v * v for v in counts.values()))
        return sum(np.float32(w[k]) * v / norm for k, v in counts.items()) + np.float32(w[-1]) >= 0

    assert {r.doc_id for r in after} == {r.doc_id for r in before if keep(r.text)}


def test_near_duplicates(stages):
    _, before, after, _ = stages[1]
    sets = {}
    for r in before:
        w = words_of(r.text)
        if w:
            sets[r.doc_id] = {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if 2 * min(len(x), len(y)) >= max(len(x), len(y)) and 2 * len(x & y) >= len(x | y):
            up[max(root(a), root(b))] = min(root(a), root(b))
    want = {r.doc_id for r in before if root(r.doc_id) == r.doc_id}
    got = {r.doc_id for r in after}
    assert want <= got
    assert len(got - want) <= 0.02 * len(before)  # pairs at the threshold that banding may miss


def test_substring(stages):
    _, before, after, _ = stages[2]
    n, words = Counter(), {r.doc_id: words_of(r.text) for r in before}
    for w in words.values():
        n.update(tuple(w[k : k + 50]) for k in range(len(w) - 49))
    want = {}
    for r in before:
        w, spans = words[r.doc_id], []
        for k in range(len(w) - 49):
            if n[tuple(w[k : k + 50])] > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + 50
                else:
                    spans.append([k, k + 50])
        text = cut_words(r.text, spans) if spans else r.text
        if text.strip() or not spans:
            want[r.doc_id] = text
    assert {r.doc_id: r.text for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after if r.text != next(b.text for b in before if b.doc_id == r.doc_id))


def test_mixing(spark, stages):
    _, before, after, _ = stages[3]
    groups = defaultdict(list)
    for r in before:
        if k := len(r.text.split()):
            groups[r.source, k].append(r.doc_id)
    tokens = Counter()
    for (s, k), ids in groups.items():
        tokens[s] += k * len(ids)
    budget = math.floor(min(tokens.values()) + 1e-6)
    ids = spark.createDataFrame([(r.doc_id,) for r in before], "doc_id long").select("doc_id", F.xxhash64("doc_id", F.lit(17)).alias("h")).collect()
    h = {r.doc_id: r.h for r in ids}
    want = set()
    for s in tokens:
        lengths = sorted(k for x, k in groups if x == s)
        for k, t in zip(lengths, fit(np.array(lengths), np.array([len(groups[s, k]) for k in lengths]), budget, 1 << 14), strict=True):
            want |= set(sorted(groups[s, k], key=lambda i: (h[i], i))[:t])
    assert {r.doc_id for r in after} == want
    assert {r.doc_id: r.text for r in after}.items() <= {r.doc_id: r.text for r in before}.items()


def test_packing(stages):
    _, before, after, _ = stages[4]
    spans, windows = defaultdict(list), defaultdict(list)
    for r in after:
        spans[r.doc_id].append((r.start_word, r.end_word))
        windows[r.window].append(r)
    for r in before:
        at = 0
        for a, b in sorted(spans[r.doc_id]):
            assert a == at
            at = b
        assert at == len(words_of(r.text))
    text = {r.doc_id: r.text for r in before}
    for w in windows.values():
        assert sum(r.end_word - r.start_word for r in w) <= 2048
        w.sort(key=lambda r: r.position)
        if w[0].window[0] == "r":  # what no seed took
            assert {r.score for r in w} == {0.0}
            continue
        assert w[0].doc_id % 50 == 0
        assert [r.score for r in w[1:]] == sorted((r.score for r in w[1:]), reverse=True)
        seed = set(words_of(text[w[0].doc_id]))
        assert all(seed & set(words_of(text[r.doc_id])) for r in w[1:])


def test_run_gives_the_last_stage(spark, data, stages):
    key = lambda r: (r.window, r.position, r.doc_id, r.start_word, r.end_word)
    assert sorted(map(key, P.run(spark, data).collect())) == sorted(map(key, stages[4][2]))


def awkward_rows(spark):
    """Nulls in any column, blanks, a very long text, repeated rows and ties, and good and bad labels among them."""
    good = [(i, f"the words of number {i} are {i * 7} and {i * 11} with some more of them here", "en", f"s{i % 3}", 60) for i in range(40)]
    rows = good + good[:3] + [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, "  \n", "en", "s1", 3), (None, "a row without a number but words", "en", "s2", 32), (None, None, None, None, None), (103, "word " * 30_000, "en", "s0", 150_000), (104, "same text twice over", None, None, 20), (105, "same text twice over", None, "s1", 20)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("kind", ["awkward", "empty", "clashing"])
def test_stages_on_awkward_tables(spark, tmp_path, kind):
    docs = awkward_rows(spark)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(103, 0, 0), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    if kind == "empty":
        docs, labels = docs.limit(0), labels.limit(0)
    if kind == "clashing":
        docs = docs.withColumns({c: F.lit("clash") for c in ("id", "label", "name", "n", "node", "component", "rank", "take", "window", "position", "range", "part", "turn", "later", "a", "x")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (name, stage) in enumerate(P.STAGES):
        before = now.collect()
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        after = now.collect()
        if i < len(P.STAGES) - 1:
            assert now.columns == docs.columns
            assert {r.doc_id for r in after} <= {r.doc_id for r in before}
        if name == "near_duplicates":
            ids = Counter(r.doc_id for r in after if r.doc_id is not None)
            assert not ids or max(ids.values()) == 1
        if name == "mixing":
            assert all(r.source is not None and r.text.strip() for r in after)
    assert (len(after) > 0) == (kind != "empty")
    assert P.run(spark, str(tmp_path)).count() == len(after)


def test_workers_give_back_what_their_task_used():
    """Spark keeps Python workers that have nothing to do. Here a task of the quality stage runs in a process of its own."""
    import subprocess
    import sys
    from pathlib import Path

    code = """
import re
from types import SimpleNamespace as N
import numpy as np, pyarrow as pa
from gridloom.llm import quality

def held():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

context = N(broadcast=lambda v: N(value=v))
docs = N(sparkSession=N(sparkContext=context), schema=None, mapInArrow=lambda run, schema: run)
task = quality.keep_good(docs, np.full((1 << 18) + 1, 0.1))
rng = np.random.default_rng(7)
batch = lambda n: pa.RecordBatch.from_pydict({"doc_id": range(n), "text": [" ".join(f"w{x}" for x in rng.integers(0, 300_000, 500)) for _ in range(n)]})
list(task(iter([batch(50)])))
before = held()
for out in task(batch(3000) for _ in range(3)):
    pass
del out
print(held() - before)
"""
    root = Path(__file__).resolve().parents[2]
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(root), "OMP_NUM_THREADS": "1"})
    assert out.returncode == 0, out.stderr
    assert float(out.stdout) < 25, out.stdout
