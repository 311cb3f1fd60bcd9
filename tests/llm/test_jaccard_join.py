import itertools
import random
from collections import Counter

import pytest

from gridloom.llm.common import components
from gridloom.llm.jaccard_join import choose_bands, drop_near_duplicates, jaccard_join, similar_pairs
from gridloom.llm.text import words_of


def grams(text, n=3):
    w = words_of(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def pairs_of(df, **how):
    """All pairs of documents that the join finds: copies by their class, others by pairs of classes."""
    members, out = {}, {}
    rows = jaccard_join(df, **how).collect()
    for r in rows:
        members.setdefault(r.class_id, set()).add(r.doc_id)
    for c in members.values():
        out |= {p: 1.0 for p in itertools.combinations(sorted(c), 2)}
    links = Counter()
    for r in similar_pairs(df, **how).collect():
        links.update((r.class_a, r.class_b))
        for a, b in itertools.product(members[r.class_a], members[r.class_b]):
            if a != b:
                out[min(a, b), max(a, b)] = r.jaccard
    for r in rows:
        assert r.n_links == links[r.class_id]
        assert r.n_copies == len(members[r.class_id])
    return out


def brute(rows, threshold=0.5):
    sets = [(i, grams(t)) for i, t in rows]
    out = {}
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and a != b and len(x & y) / len(x | y) >= threshold:
            out[min(a, b), max(a, b)] = len(x & y) / len(x | y)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    word = lambda: "w" + str(rng.randrange(400))
    out, k = [], 0
    for _ in range(60):
        base = [word() for _ in range(rng.randrange(20, 120))]
        for _ in range(rng.choice([1, 1, 2, 4, 12])):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(copy) // 25) + 1)):
                copy[rng.randrange(len(copy))] = word()
            out.append((k, " ".join(copy)))
            k += 1
    return out


def test_bands_reach_the_recall():
    for t, r in ((0.5, 0.9), (0.7, 0.98), (0.8, 0.95), (0.95, 0.99)):
        bands, n = choose_bands(t, r)
        assert 1 - (1 - t**n) ** bands >= r - 1e-9
        assert bands * n <= 96


@pytest.mark.parametrize(("tile", "bucket"), [(512, 4096), (3, 2)])
def test_against_brute_force(spark, rows, tile, bucket):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got, want = pairs_of(df, tile=tile, bucket=bucket), brute(rows)
    assert want
    assert set(got) <= set(want)
    assert len(got) >= 0.97 * len(want)
    for k, v in got.items():
        assert abs(v - want[k]) < 1e-12


def test_drop_keeps_the_least_of_each_group(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in drop_near_duplicates(df).collect()}
    pairs, up = pairs_of(df), {}
    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x
    for a, b in pairs:
        up[max(root(a), root(b))] = min(root(a), root(b))
    assert left == {i for i, _ in rows if root(i) == i}
    for r in jaccard_join(df).collect():
        assert r.group_id == root(r.doc_id)


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (5, 4), (7, 7), (None, 1)] + [(100 + i, 101 + i) for i in range(40)], "a long, b long")
    got = {r.node: r.component for r in components(e).collect()}
    assert {k: v for k, v in got.items() if k < 100} == {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 4, 7: 7}
    assert {got[100 + i] for i in range(41)} == {100}
    assert components(e.limit(0)).count() == 0


def test_awkward(awkward, nothing):
    assert jaccard_join(awkward).count() == 0
    assert jaccard_join(nothing).count() == 0
    out = drop_near_duplicates(awkward)
    assert out.columns == awkward.columns
    ids = [r.doc_id for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 6, 7]
    assert ids.count(None) == 1
    assert drop_near_duplicates(nothing).count() == 0


def test_short_texts_and_same_number_with_other_text(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "A b!"), (3, "a c"), (3, "q r s t"), (4, "q r s t")], "doc_id long, text string")
    assert {(r.doc_id, r.class_id) for r in jaccard_join(df).collect()} == {(1, 1), (2, 1), (3, 3), (4, 3)}


def test_pairs_near_the_threshold_in_a_bucket_of_strangers(spark):
    """Pairs of J = .50 to .55 whose documents also share a passage, and so buckets, with hundreds of strangers of sizes between theirs."""
    rng = random.Random(11)
    word = lambda: "w" + str(rng.randrange(50_000))
    common = [word() for _ in range(60)]
    rows = []
    for k in range(150):
        a = common + [word() for _ in range(90)]
        b = a[: 60 + 42] + [word() for _ in range(rng.randrange(38, 44))]
        rows += [(3 * k, " ".join(a)), (3 * k + 1, " ".join(b)), (3 * k + 2, " ".join(common + [word() for _ in range(rng.randrange(60, 90))]))]
    pairs = brute(rows)
    near = {p for p, j in pairs.items() if j < 0.56}
    assert len(near) > 100
    got = {(r.class_a, r.class_b) for r in similar_pairs(spark.createDataFrame(rows, "doc_id long, text string"), bucket=64).collect()}
    assert got <= set(pairs)
    assert len(got & near) >= 0.98 * len(near) - 2


def test_hot_group(spark):
    """A third of all rows are near copies of one text, in more copies than a tile or a bucket holds: every link is counted."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(2000)}" for _ in range(60)]
    rows = [(i, " ".join(base[: 30 + i % 3] + [f"x{i}"] + base[31 + i % 3 :])) for i in range(120)] + [(1000 + i, " ".join(f"w{rng.randrange(2000)}" for _ in range(50))) for i in range(240)]
    want = Counter(itertools.chain.from_iterable(p for p, j in brute(rows).items()))
    got = {r.doc_id: r for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), tile=16, bucket=32).collect()}
    assert {k: v.n_links + v.n_copies - 1 for k, v in got.items()} == dict(want)
    assert {v.group_id for v in got.values()} == {0}
