import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from gridloom.llm.packing import pack_documents
from gridloom.llm.text import Chunk, words_of


class Bm25:
    """An inverted index: postings of term t are docs[ends[t]:ends[t + 1]], with weights of the same places."""

    def __init__(self, codes: np.ndarray, offsets: np.ndarray, terms: int, k1: float = 1.2, b: float = 0.75):
        n = len(offsets) - 1
        counts = np.diff(offsets)
        doc = np.repeat(np.arange(n), counts)
        key, tf = np.unique(codes.astype(np.int64) * n + doc, return_counts=True)
        term, self.docs, self.n = key // n, key % n, n
        self.ends = np.searchsorted(term, np.arange(terms + 1))
        df = np.diff(self.ends)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = k1 * (1 - b + b * counts / max(1.0, counts.mean()))
        self.weights = idf[term] * tf * (k1 + 1) / (tf + norm[self.docs])
        order = np.lexsort((term, self.docs))
        self.own, self.own_tf = term[order], tf[order]
        self.own_ends = np.searchsorted(self.docs[order], np.arange(n + 1))

    def scores(self, query: int) -> np.ndarray:
        """Of all documents against document `query` as the query (a term asks as often as it occurs)."""
        a, b = self.own_ends[query], self.own_ends[query + 1]
        first, size = self.ends[self.own[a:b]], self.ends[self.own[a:b] + 1] - self.ends[self.own[a:b]]
        total = int(size.sum())
        if not total:
            return np.zeros(self.n)
        at = np.arange(total) + np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])), size)
        return np.bincount(self.docs[at], self.weights[at] * np.repeat(self.own_tf[a:b], size), self.n)


def pack(counts: np.ndarray, index: Bm25 | None, order: np.ndarray, window: int) -> list[list[tuple[int, int, int, float]]]:
    """Windows of (document, start, end, score), the seed first with score 0."""
    used, out = counts == 0, []
    for seed in order:
        if used[seed]:
            continue
        used[seed] = True
        whole, rest = divmod(int(counts[seed]), window)
        out += [[(int(seed), k * window, (k + 1) * window, 0.0)] for k in range(whole)]
        if not rest:
            continue
        items, room = [(int(seed), whole * window, int(counts[seed]), 0.0)], window - rest
        score = index.scores(seed)
        free = np.flatnonzero(~used & (score > 0))
        for d in free[np.argsort(-score[free], kind="stable")]:
            items.append((int(d), 0, min(int(counts[d]), room), float(score[d])))
            used[d] = True
            room -= min(int(counts[d]), room)
            if not room:
                break
        out.append(items)
    return out


def brute_scores(texts, query, k1=1.2, b=0.75):
    docs = [Counter(words_of(t)) for t in texts]
    n, avg = len(docs), max(1.0, sum(sum(d.values()) for d in docs) / len(docs))
    df = Counter(w for d in docs for w in d)
    out = []
    for d in docs:
        size = sum(d.values())
        out.append(sum(q * math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * d[w] * (k1 + 1) / (d[w] + k1 * (1 - b + b * size / avg)) for w, q in docs[query].items() if d[w]))
    return out


def test_scores_against_brute_force():
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.5, rng.integers(0, 40)) % 50) for _ in range(60)]
    c = Chunk(pa.array(texts))
    index = Bm25(c.codes, c.offsets, len(c.words))
    for q in (0, 7, 33):
        assert np.allclose(index.scores(q), brute_scores(texts, q))


def test_every_word_once(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = pack_documents(docs, window=300, shard_docs=50).collect()
    spans, fill = defaultdict(list), Counter()
    for r in rows:
        spans[r.doc_id].append((r.start_word, r.end_word))
        fill[r.window] += r.end_word - r.start_word
    for d in docs.collect():
        n, at = len(words_of(d.text)), 0
        for a, b in sorted(spans[d.doc_id]):
            assert a == at
            at = b
        assert at == n
    assert max(fill.values()) <= 300
    assert sum(fill.values()) / (300 * len(fill)) > 0.85
    assert all(n == 300 for w, n in fill.items() if w[0] == "s")


def test_awkward(awkward, nothing):
    rows = pack_documents(awkward, window=100).collect()
    assert Counter(r.doc_id for r in rows if r.doc_id != 5) == {1: 2, None: 1, 6: 1}
    assert sum(r.end_word - r.start_word for r in rows if r.doc_id == 5) == 30_000
    assert pack_documents(nothing).count() == 0


def test_many_shards_against_brute_force_over_the_whole_table(spark, monkeypatch):
    import gridloom.llm.packing as P

    monkeypatch.setattr(P, "SEEDS", 40, raising=False)  # several rounds
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, rng.integers(1, 60)) % 300) for _ in range(700)]
    df = spark.createDataFrame([(i, t, ["en", "de"][i % 2]) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    order = [r.doc_id for r in df.selectExpr("doc_id", "doc_id % 7 != 0 later", "xxhash64(doc_id, 17) h").orderBy("later", "h").collect()]
    c = Chunk(pa.array([texts[i] for i in order]))
    plain = Bm25(c.codes, c.offsets, len(c.words))

    class Rounded:
        def scores(self, q):
            return np.round(plain.scores(q), 6)

    want = {tuple((order[d], a, b) for d, a, b, _ in w) for w in pack(c.counts, Rounded(), np.arange(100), 120)}
    got, rest, words = defaultdict(list), defaultdict(list), Counter()
    for r in sorted(pack_documents(df, window=120, shard_docs=32, every=7).collect(), key=lambda r: r.position):
        (got if r.window[0] == "s" else rest)[r.window].append((r.doc_id, r.start_word, r.end_word))
        words[r.doc_id] += r.end_word - r.start_word
    assert {tuple(w) for w in got.values()} == want
    assert words == {i: len(words_of(t)) for i, t in enumerate(texts)}
    assert all(sum(b - a for _, a, b in w) <= 120 for w in rest.values())
    assert all(d % 7 or a for w in rest.values() for d, a, _ in w)  # of a seed, only what another one cut off


def test_seeds_of_one_group_share_it_out(spark, monkeypatch):
    """Seeds that all want the same documents: the lists must reach far enough."""
    import gridloom.llm.packing as P

    monkeypatch.setattr(P, "SLACK", 1)
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 500, 12)]
    texts = [" ".join([*base, f"v{x}"]) for x in rng.integers(0, 50, 300)] + [" ".join(f"w{x}" for x in rng.integers(0, 500, 13)) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    order = [r.doc_id for r in df.selectExpr("doc_id", "doc_id % 5 != 0 later", "xxhash64(doc_id, 17) h").orderBy("later", "h").collect()]
    c = Chunk(pa.array([texts[i] for i in order]))
    plain = Bm25(c.codes, c.offsets, len(c.words))

    class Rounded:
        def scores(self, q):
            return np.round(plain.scores(q), 6)

    want = {tuple((order[d], a, b) for d, a, b, _ in w) for w in pack(c.counts, Rounded(), np.arange(80), 60)}
    got = defaultdict(list)
    for r in sorted(pack_documents(df, window=60, shard_docs=64, every=5).where("window like 's%'").collect(), key=lambda r: r.position):
        got[r.window].append((r.doc_id, r.start_word, r.end_word))
    assert {tuple(w) for w in got.values()} == want


def test_lists_that_are_too_short_are_searched_again_alone(spark, monkeypatch):
    """Seeds that all want the same documents: the others of a round keep their lists, whatever the groups they are scored in."""
    import gridloom.llm.packing as P

    asked, numbers = [], P._numbers

    def counted(column, kind):
        asked.append(len(column))
        return numbers(column, kind)

    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 500, 12)]
    texts = [" ".join([*base, f"v{x}"]) for x in rng.integers(0, 50, 300)] + [" ".join(f"w{x}" for x in rng.integers(0, 500, 13)) for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(P, "SLACK", 64)
    want = sorted(pack_documents(docs, window=60, every=5).collect(), key=str)
    monkeypatch.setattr(P, "SLACK", 1)
    monkeypatch.setattr(P, "GROUP", 16, raising=False)
    monkeypatch.setattr(P, "_numbers", counted)
    assert sorted(pack_documents(docs, window=60, every=5).collect(), key=str) == want
    assert sum(asked) == 2 * 80  # terms and counts of every seed, once
    monkeypatch.setattr(P, "ROWS", 400, raising=False)  # the driver can't hold the lists of all seeds at once
    assert sorted(pack_documents(docs, window=60, every=5).collect(), key=str) == want


def test_best_of_scores_that_are_equal_once_rounded():
    from gridloom.llm.packing import _best

    rng = np.random.default_rng(6)
    for size, limit, least in ((5, 40, 0.0), (300, 90, 0.0), (300, 90, 0.00002), (300, 10_000, 0.0), (300, 10_000, 0.00003), (300, 400, 0.0)):
        own = rng.integers(0, 40, size) * 1e-6 + rng.uniform(-4e-7, 4e-7, size)
        own, counts = np.maximum(own, 0), rng.integers(1, 9, size)
        score = np.round(own, 6)
        order = [d for d in np.lexsort((np.arange(size), -score)) if score[d] > 0 and score[d] >= least]
        want = order[: int(np.searchsorted(np.cumsum(counts[order]), limit)) + 1]
        got, rounded = _best(own, counts, limit, least)
        assert got.tolist() == want and np.array_equal(rounded, score[want])
