from collections import Counter, defaultdict

from gridloom.llm.substring import cut_words, remove_repeats, repeated_intervals
from gridloom.llm.text import words_of


def brute(rows, w):
    n = Counter()
    docs = [(i, words_of(t)) for i, t in rows]
    for _, x in docs:
        n.update(tuple(x[k : k + w]) for k in range(len(x) - w + 1))
    out = []
    for i, x in docs:
        hit = [k for k in range(len(x) - w + 1) if n[tuple(x[k : k + w])] > 1]
        spans = []
        for k in hit:
            if spans and k <= spans[-1][1]:
                spans[-1][1] = k + w
            else:
                spans.append([k, k + w])
        out += [(i, a, b) for a, b in spans]
    return Counter(out)


def test_against_brute_force(spark):
    import random

    rng = random.Random(3)
    passages = [" ".join(f"p{k}x{i}" for i in range(rng.randrange(8, 30))) for k in range(5)]
    rows = []
    for i in range(60):
        parts = [" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 20))) for _ in range(3)]
        if i % 2:
            parts.insert(rng.randrange(3), rng.choice(passages))
        rows.append((i, " ".join(parts)))
    rows.append((99, "a b " * 20))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for buckets in (1, 7):
        got = Counter((r.doc_id, r.start_word, r.end_word) for r in repeated_intervals(df, 8, buckets).collect())
        assert got == brute(rows, 8)


def test_against_sql(spark, data, duck, same):
    from gridloom.llm.queries import oracle_sql, queries

    same(queries()["op9_substring"](spark, data), duck.execute(oracle_sql()["op9_substring"]))


def test_cut_words():
    assert cut_words("Keep, these -- two. Cut this out! And stay", [(3, 6)]) == "Keep, these -- two. And stay"
    assert cut_words("all gone", [(0, 2)]) == ""
    assert cut_words("a b c d", [(0, 1), (2, 4)]) == "b "


def test_remove(spark):
    p = " ".join(f"x{i}" for i in range(60))
    df = spark.createDataFrame([(1, "start " + p + " end", 7), (2, p, 8), (3, "alone in here", 9), (4, "b " + p, None), (None, p, 1), (5, None, 2)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in remove_repeats(df).collect()}
    assert got == {1: ("start end", 9), 3: ("alone in here", 9), 4: ("b ", 2), None: (p, 1), 5: (None, 2)}
    again = remove_repeats(spark.createDataFrame([(k, v[0], v[1]) for k, v in got.items() if k], "doc_id long, text string, n_chars long"))
    assert again.count() == 4


def test_awkward(awkward, nothing):
    rows = [(r.doc_id, r.start_word, r.end_word) for r in repeated_intervals(awkward).collect()]
    assert rows == [(5, 0, 30_000)]
    out = remove_repeats(awkward)
    assert out.columns == awkward.columns
    ids = defaultdict(int)
    for r in out.collect():
        ids[r.doc_id] += 1
    assert ids == {1: 2, 2: 1, 3: 1, 4: 1, None: 1, 6: 1, 7: 1}
    assert repeated_intervals(nothing).count() == 0
    assert remove_repeats(nothing).count() == 0


def test_null_numbers_and_repeated_rows(spark):
    t = " ".join(f"x{i}" for i in range(55))
    df = spark.createDataFrame([(None, t), (None, t), (1, t), (1, t)], "doc_id long, text string")
    got = Counter((r.doc_id, r.start_word, r.end_word) for r in repeated_intervals(df).collect())
    assert got == {(None, 0, 55): 2, (1, 0, 55): 2}
