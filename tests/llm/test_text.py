import numpy as np
import pyarrow as pa

from gridloom.llm.text import Chunk, hash_strings, ngrams, pieces, rolling, words_of

TEXTS = ["The cat, the CAT!", None, "", "  --- . ", "a b", "Ünï-cödé É 9", "x" * 300_000 + " y", "a b\tc\r\nd"]


def test_chunk_equals_the_plain_definition():
    c = Chunk(pa.array(TEXTS))
    words = c.words.to_pylist()
    for i, t in enumerate(TEXTS):
        assert [words[k] for k in c.codes[c.offsets[i] : c.offsets[i + 1]]] == words_of(t)
    assert list(c.counts) == [4, 0, 0, 0, 2, 3, 2, 4]


def test_chunk_of_a_slice_and_of_nothing():
    a = pa.array(["no", "one two", "three"]).slice(1, 2)
    c = Chunk(a)
    assert [c.words[k].as_py() for k in c.codes] == ["one", "two", "three"]
    assert len(Chunk(pa.array([], pa.string())).codes) == 0


def test_hashes_are_stable_and_distinct():
    words = [f"w{i}" for i in range(50_000)] + ["", "a", "aa", "aaa"]
    h = hash_strings(words)
    assert len(set(h.tolist())) == len(words)
    assert (hash_strings(pa.array(words).slice(100, 50)) == h[100:150]).all()


def test_rolling_against_the_sum():
    p, h = 0x9E3779B97F4A7C15, np.arange(1, 60, dtype=np.uint64) * np.uint64(7919)
    for n in (1, 2, 3, 7, 50, 59):
        r = rolling(h, n)
        for i in range(60 - n):
            want = 0
            for k in range(n):
                want = (want * p + int(h[i + k])) % 2**64
            assert int(r[i]) == want


def test_ngrams_stay_inside_documents():
    c = Chunk(pa.array(["a b c d", "a b c", "c d", None, "a b c d"]))
    g, e = ngrams(c.hashes, c.offsets, 3)
    assert list(np.diff(e)) == [2, 1, 1, 0, 2]
    assert g[0] == g[2] == g[4]
    assert list(np.diff(ngrams(c.hashes, c.offsets, 3, short=False)[1])) == [2, 1, 0, 0, 2]


def test_pieces_keep_all_rows():
    b = pa.RecordBatch.from_pydict({"text": ["x" * 10, None, "y" * 100, "", "z"]})
    parts = list(pieces(b, limit=15))
    assert sum((p.column("text").to_pylist() for p in parts), []) == b.column("text").to_pylist()
    assert len(parts) > 1
