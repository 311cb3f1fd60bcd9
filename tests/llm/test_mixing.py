import itertools
import re
from collections import Counter

import numpy as np
import pytest

from gridloom.llm.mixing import fit, length, mix


def best(lengths, counts, budget):
    return max(s for t in itertools.product(*[range(c + 1) for c in counts]) if (s := sum(a * b for a, b in zip(t, lengths, strict=True))) <= budget)


def test_fit_against_all_choices():
    rng = np.random.default_rng(0)
    for _ in range(60):
        lengths = np.unique(rng.integers(3, 40, 4))
        counts = rng.integers(1, 5, len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum() + 5))
        take = fit(lengths, counts, budget)
        got = int((take * lengths).sum())
        assert (take <= counts).all()
        assert (take >= 0).all()
        assert got <= budget
        total = int((lengths * counts).sum())
        base = [int(c) * budget // total if total > budget else int(c) for c in counts]
        rest = budget - sum(a * b for a, b in zip(base, lengths.tolist(), strict=True))
        want = (budget - rest + best(lengths, counts - base, rest)) if total > budget else total
        assert got == want


def test_fit_large_budgets_exactly():
    lengths, counts = np.arange(1, 3000), np.full(2999, 50)
    budget = 100_000_007
    assert int((fit(lengths, counts, budget) * lengths).sum()) == budget
    assert int((fit(lengths, counts, budget, table=64) * lengths).sum()) == budget


@pytest.mark.parametrize("weights", [None, {"src0": 3.0, "src1": 1.0, "none": 0.0}])
def test_shares(spark, data, weights):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = mix(docs, weights).collect()
    tokens = Counter()
    for r in docs.collect():
        tokens[r.source] += len(r.text.split())
    w = {k: v for k, v in (weights or dict.fromkeys(tokens, 1.0)).items() if v > 0}
    least = min(tokens[k] / v for k, v in w.items())
    got = Counter()
    for r in rows:
        got[r.source] += r.n_tokens
    assert set(got) == set(w)
    for k, v in w.items():
        want = int(least * v + 1e-6)
        assert want - 60 <= got[k] <= want
    assert len({r.doc_id for r in rows}) == len(rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix(docs.repartition(3), weights).collect()))


def test_awkward(awkward, nothing):
    rows = mix(awkward, share=1.0).collect()
    # the least source has 3 words (c has one document); nulls, blanks and wordless texts are never drawn
    assert all(r.source in ("a", "c") and r.n_tokens > 0 for r in rows)
    whole = mix(awkward, {"a": 1.0}, share=1.0, whole_rows=True)
    assert whole.columns == awkward.columns
    assert Counter(r.doc_id for r in whole.collect()) == {1: 2, None: 1, 5: 1}
    assert mix(nothing).count() == 0
    assert mix(awkward, {}).count() == 0


def test_all_lengths_share_the_budget():
    # a source whose floors are nearly all 0: what is drawn follows the source, not the longest documents
    rng = np.random.default_rng(3)
    lengths, counts = np.unique(np.minimum(rng.lognormal(5.5, 0.8, 1000).astype(int) + 5, 5000), return_counts=True)
    budget = int((lengths * counts).sum()) // 4
    take = fit(lengths, counts, budget, table=1 << 14)
    assert int((take * lengths).sum()) == budget
    assert (take <= counts).all()
    mean, got = (lengths * counts).sum() / counts.sum(), budget / take.sum()
    assert 0.75 * mean < got < 1.25 * mean


def test_remainders_above_the_table_are_fitted_exactly():
    rng = np.random.default_rng(9)
    for _ in range(60):
        lengths = np.unique(rng.integers(3000, 20_000, 8))
        counts = rng.integers(1, 3, len(lengths))
        budget = int((lengths * counts).sum() * rng.uniform(0.2, 0.9))
        got = [int((fit(lengths, counts, budget, table) * lengths).sum()) for table in (1, 1 << 14, 1 << 22)]
        total = int((lengths * counts).sum())
        base = np.array([int(c) * budget // total for c in counts])
        want = int((base * lengths).sum()) + best(lengths, counts - base, budget - int((base * lengths).sum()))
        assert got == [want] * 3


def test_lengths(spark):
    texts = ["", " ", "a", " a", "a ", "\ta\r\n b\n", "a\n\nb", "\n", "a  ", None, "x" * 5]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r.n for r in df.select(length().alias("n")).collect()] == [len(re.findall("[^ \t\n\x0b\f\r]+", t or "")) for t in texts]


def test_ranges_take_what_a_rank_would(spark):
    """Against ranking all documents of a source and length: many of one length, ids that are null, repeated rows."""
    rng = np.random.default_rng(4)
    rows = [(int(i), "a b c", "s") for i in range(3000)] + [(None, f"a b {i}", "s") for i in range(50)] + [(7, "a b c", "s")] * 5 + [(10_000 + i, "w " * int(n), "s") for i, n in enumerate(rng.integers(1, 9, 500))] + [(20_000 + i, "q r", "t") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hashed = df.selectExpr("doc_id", "text", "source", "if(doc_id is null, xxhash64(text, 17), xxhash64(doc_id, 17)) h", "xxhash64(text) x").collect()
    groups = {}
    for r in hashed:
        groups.setdefault((r.source, len(r.text.split())), []).append((r.h, -1 if r.doc_id is None else r.doc_id, r.x, r.text))
    budget = min(sum(k * len(v) for (s, k), v in groups.items() if s == z) for z in "st")
    want = Counter()
    for z in "st":
        lengths = sorted(k for s, k in groups if s == z)
        for k, n in zip(lengths, fit(np.array(lengths), np.array([len(groups[z, k]) for k in lengths]), budget, 1 << 14), strict=True):
            want.update((i, text) for _, i, _, text in sorted(groups[z, k])[:n])
    assert Counter((-1 if r.doc_id is None else r.doc_id, r.text) for r in mix(df, whole_rows=True).collect()) == want
