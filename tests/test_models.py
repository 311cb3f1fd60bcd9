"""Models that SQL can't express, against brute force and on data whose answer is known."""

import numpy as np
import pytest

from gridloom.operators import models as M


def test_out_of_fold_scores_come_from_the_other_folds(spark):
    """Two folds of opposite labels: a model that had seen a row's own fold would be right, one that hasn't is wrong."""
    rows = [(i, [float(i % 20), 1.0], int((i % 20 >= 10) == (i % 2 == 0)), i // 200 % 2) for i in range(400)]
    rows = [(i, f, int((f[0] >= 10) == (k == 0)), k) for i, f, _, k in rows]
    df = spark.createDataFrame(rows, "sample_id long, features array<double>, y int, fold int")
    got = M.gbt_oof(df, [0, 1], trees=2, depth=2).collect()
    assert sorted(r.sample_id for r in got) == list(range(400))
    assert all((r.p > 0.5) != (r.y == 1) for r in got)


def test_tuning_scores_each_setting_on_the_validation_fold(spark):
    rows = [(i, [float(i % 20)], int(i % 20 >= 10), i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "sample_id long, features array<double>, y int, fold int")
    got = M.tune(df, [{"maxIter": 1, "maxDepth": 1}, {"maxIter": 2, "maxDepth": 2}], 0).collect()
    assert len({r.params for r in got}) == 2
    assert [r.auprc for r in got] == pytest.approx([1, 1])


def test_permutation_importance_against_plain_python(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))]
    df = spark.createDataFrame(rows, "sample_id long, a double, b double")
    score = lambda d: d.selectExpr("sample_id", "a", "a + 0.0 * b as s")
    truth = {i: a for i, a, _ in rows}
    metric = lambda d: -float(np.mean([abs(r.s - truth[r.sample_id]) for r in d.collect()]))
    groups = {r.sample_id: (r.g, r.h) for r in df.selectExpr("sample_id", "pmod(xxhash64(sample_id), 1024) g", "md5(concat(cast(sample_id as string), 'a')) h").collect()}
    order = sorted(truth, key=groups.get)
    before = dict(zip(order[1:], order[:-1], strict=True))
    moved = {i: truth[before[i]] if i in before and groups[before[i]][0] == groups[i][0] else truth[i] for i in truth}
    got = {r.band: r.drop for r in M.permutation_importance(df, score, ["a", "b"], metric).collect()}
    assert got["a"] == pytest.approx(np.mean([abs(moved[i] - truth[i]) for i in truth]))
    assert got["a"] > 0
    assert got["b"] == 0


def test_refinement_against_a_loop_over_pixels(spark):
    rng = np.random.default_rng(2)
    size, halo, rounds, spread, colour, weight = 4, 3, 2, 1.0, 0.3, 1.5
    p, g = rng.uniform(0.05, 0.95, (7, 9)), rng.uniform(size=(7, 9))
    p[2, 3] = np.nan
    df = spark.createDataFrame([(r, c, None if np.isnan(p[r, c]) else float(p[r, c]), float(g[r, c])) for r in range(7) for c in range(9)], "row int, col int, prob double, guide double")
    want = {}
    for tr in range(2):
        for tc in range(3):
            own = [(r, c) for r in range(max(0, tr * size - halo), min(7, (tr + 1) * size + halo)) for c in range(max(0, tc * size - halo), min(9, (tc + 1) * size + halo))]
            q = {x: 0.5 if np.isnan(p[x]) else p[x] for x in own}
            for _ in range(rounds):
                new = {}
                for r, c in own:
                    msg = norm = 0.0
                    for y in own:
                        a, b = r - y[0], c - y[1]
                        if (a or b) and max(abs(a), abs(b)) <= min(halo, int(3 * spread)) and not np.isnan(p[y]):
                            w = np.exp(-(a * a + b * b) / (2 * spread**2)) * (0.5 + 0.5 * np.exp(-((g[r, c] - g[y]) ** 2) / (2 * colour**2)))
                            msg, norm = msg + w * (2 * q[y] - 1), norm + w
                    x = 0.5 if np.isnan(p[r, c]) else p[r, c]
                    new[r, c] = 1 / (1 + np.exp(-(np.log(x / (1 - x)) + weight * msg / max(norm, 1e-9))))
                q = new
            want |= {(r, c): q[r, c] for r, c in own if r // size == tr and c // size == tc and not np.isnan(p[r, c])}
    got = {(r.row, r.col): r.p for r in M.crf(df, size, halo, rounds, spread, colour, weight).collect()}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
