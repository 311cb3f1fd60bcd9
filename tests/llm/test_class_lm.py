from collections import Counter

import numpy as np

from gridloom.llm import class_lm as L
from gridloom.llm.text import hash_strings, words_of


def objective(of, pairs):
    n = Counter()
    for (a, b), k in pairs.items():
        n[of[a], of[b]] += k
    left, right = Counter(), Counter()
    for (c, d), k in n.items():
        left[c] += k
        right[d] += k
    x = lambda k: k * np.log(k)
    return sum(map(x, n.values())) - sum(map(x, left.values())) - sum(map(x, right.values()))


def test_exchange_ends_where_no_single_move_helps():
    rng = np.random.default_rng(0)
    truth = np.arange(24) % 3  # words of one class are followed by words of the next
    pairs = Counter()
    for _ in range(4000):
        a = rng.integers(24)
        b = rng.choice(np.flatnonzero(truth == (truth[a] + 1) % 3))
        pairs[int(a), int(b)] += 1
    left, right, n = (np.array(x) for x in zip(*[(a, b, k) for (a, b), k in pairs.items()], strict=True))
    of = L.exchange(left, right, n, 24, 3, 20)
    best = objective(of, pairs)
    for w in range(24):
        for c in range(3):
            moved = of.copy()
            moved[w] = c
            assert objective(moved, pairs) <= best + 1e-6
    assert len({tuple(sorted(np.flatnonzero(of == c))) for c in range(3)} & {tuple(np.flatnonzero(truth == c)) for c in range(3)}) == 3


def brute(docs, core, classes, count, signed):
    """Log probabilities by plain counting: the core's classes by `exchange`, every other word's by trying all."""
    top = sorted(count, key=lambda w: (-count[w], signed(w)))[:core]
    rank = {w: i for i, w in enumerate(top)}
    inner = Counter()
    for d in docs:
        w = words_of(d)
        inner.update((rank[a], rank[b]) for a, b in zip(w, w[1:], strict=False) if a in rank and b in rank)
    left, right, n = (np.array(x) for x in zip(*[(a, b, k) for (a, b), k in sorted(inner.items())], strict=True))
    of = dict(zip(top, L.exchange(left, right, n, len(top), classes).tolist(), strict=True))
    k = max(of.values()) + 1
    table = Counter()
    for (a, b), v in inner.items():
        table[of[top[a]], of[top[b]]] += v

    def value(t):
        f = lambda v: v * np.log(v) if v else 0.0
        rows, cols = Counter(), Counter()
        for (a, b), v in t.items():
            rows[a] += v
            cols[b] += v
        return sum(map(f, t.values())) - sum(map(f, rows.values())) - sum(map(f, cols.values()))

    usual = max(range(k), key=lambda c: (sum(count[w] for w in top if of[w] == c), -c))
    after, before = {}, {}
    for d in docs:
        w = words_of(d)
        for a, b in zip(w, w[1:], strict=False):
            if a not in rank and b in rank:
                after.setdefault(a, Counter())[of[b]] += 1
            if a in rank and b not in rank:
                before.setdefault(b, Counter())[of[a]] += 1
    cls = dict(of)
    for w in count:
        if w not in rank:
            if w not in after and w not in before:
                cls[w] = usual
                continue
            gains = []
            for c in range(k):
                t = Counter(table)
                for d, v in after.get(w, {}).items():
                    t[c, d] += v
                for d, v in before.get(w, {}).items():
                    t[d, c] += v
                gains.append(value(t))
            cls[w] = next(c for c in range(k) if gains[c] >= max(gains) - 1e-7)
    edge, pairs, size = k + 1, Counter(), Counter()
    for d in docs:
        seq = [edge, *(cls[w] for w in words_of(d)), edge]
        pairs.update(zip(seq, seq[1:], strict=False))
    for w, v in count.items():
        size[cls[w]] += v
    total, row, col = sum(pairs.values()), Counter(), Counter()
    for (a, b), v in pairs.items():
        row[a] += v
        col[b] += v
    out = []
    for d in docs:
        lp, last = 0.0, edge
        for w in [*words_of(d), None]:
            c = edge if w is None else cls[w]
            uni = (col[c] + 1) / (total + k + 2)
            lp += np.log(0.9 * pairs[last, c] / row[last] + 0.1 * uni if row[last] else uni) + (0 if w is None else np.log(count[w] / size[c]))
            last = c
        out.append(lp)
    return out, cls


def test_scores_against_plain_counting(spark):
    rng = np.random.default_rng(1)
    docs = [" ".join(f"w{x}" for x in rng.zipf(1.6, rng.integers(0, 30)) % 90) for _ in range(120)] + [None, "", "alone"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(5)
    count = Counter(w for d in docs for w in words_of(d))
    h = {w: int(hash_strings([w]).view(np.int64)[0]) for w in count}
    want, cls = brute(docs, 20, 5, count, h.get)
    model, _ = L.fit(df, 20, 5)
    assert {r.key: (r.cls, r.n) for r in model.words.collect()} == {h[w]: (cls[w], n) for w, n in count.items()}
    got = {r.doc_id: r.log_prob for r in L.perplexity(df, core=20, classes=5).collect()}
    assert all(abs(got[i] - w) < 1e-3 for i, w in enumerate(want))
    again = {r.doc_id: r.log_prob for r in L.perplexity(df, model).collect()}
    assert again == got


def test_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([(1, "a b a c a b d e f g h"), (2, "b a b a q r s a")], "doc_id long, text string")
    m, _ = L.fit(df, 3, 2)
    assert np.allclose(np.exp(m.trans).sum(1), 1)
    n = Counter()
    for r in m.words.collect():
        n[r.cls] += r.n
    assert [n[c] for c in range(len(m.size))] == m.size.tolist()
    assert m.types == 12 - 1


def test_unknown_words_and_order(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    m, _ = L.fit(docs)
    text = docs.where("lang = 'en' and n_chars > 2000").orderBy("doc_id").first().text
    words = words_of(text)
    strange = [f"zq{i}" for i in range(len(words))]
    mixed = np.random.default_rng(0).permutation(words)
    s = {r.doc_id: r.log_prob for r in L.perplexity(spark.createDataFrame([(0, text), (1, " ".join(mixed)), (2, " ".join(strange))], "doc_id long, text string"), m).collect()}
    assert s[0] > s[1] > s[2]


def test_classes_of_rare_words_help(spark, data):
    """Against one class for all words outside the core: the classes lower the perplexity."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    many, one = (np.array([r.log_prob for r in L.perplexity(docs, core=500, classes=c).orderBy("doc_id").collect()]).sum() for c in (32, 1))
    assert many > one


def test_awkward(awkward, nothing):
    rows = {(r.doc_id, r.n_words) for r in L.perplexity(awkward).collect()}
    assert rows == {(1, 3), (2, 0), (3, 0), (4, 0), (None, 5), (5, 30_000), (6, 3), (7, 0)}
    assert all(r.perplexity > 0 for r in L.perplexity(awkward).collect())
    assert L.perplexity(nothing).count() == 0
