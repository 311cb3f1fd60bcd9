"""Vectorised text units over Arrow batches.

A *word* is a white-space separated run of characters, lower-cased, with every character that is neither a letter nor a digit
removed; runs that keep nothing are no words.  Distinct runs of a chunk are normalised once (dictionary encoding), so the
Python cost follows the number of distinct runs, never the number of words.  Nulls count as empty texts.  A text of any
length is processed whole: chunks are cut between documents only.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
DROP = r"[^\p{L}\p{N}]+"
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser of an array of uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    """P^0 .. P^(n - 1) mod 2^64."""
    out = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS = _powers(64)


def hash_strings(words: pa.Array | list[str]) -> np.ndarray:
    """64-bit polynomial hashes of the UTF-8 bytes of strings without nulls, the same on every machine and in every run."""
    words = pa.array(words, pa.string()) if isinstance(words, list) else words
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
    sizes, first = np.diff(ends), int(ends[0])
    out = mix(sizes.astype(np.uint64) + np.uint64(0x51ED270B))
    if (some := np.flatnonzero(sizes)).size:
        data = np.frombuffer(words.buffers()[2], np.uint8)[first : int(ends[-1])].astype(np.uint64) + np.uint64(1)
        at = np.arange(len(data)) - np.repeat(ends[:-1] - first, sizes)
        powers = _POWERS
        if (longest := int(sizes.max())) > len(powers):
            powers = _powers(longest)
        out[some] += np.add.reduceat(data * powers[at], ends[:-1][some] - first)
    return mix(out)


def words_of(text: str | None) -> list[str]:
    """The plain definition of the words of a text, for tests and single strings."""
    runs = pa.array((text or "").split(), pa.string())
    return [w for w in pc.replace_substring_regex(pc.utf8_lower(runs), DROP, "").to_pylist() if w]


class Chunk:
    """Words of some documents: `codes` index `words`; document i has codes[offsets[i]:offsets[i + 1]]."""

    def __init__(self, texts: pa.Array):
        runs = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.fill_null(texts, "")))
        if isinstance(runs, pa.ChunkedArray):
            runs = runs.combine_chunks()
        offsets = runs.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0] if len(offsets) else 0
        coded = runs.flatten().dictionary_encode()
        words = pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), DROP, "").dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, np.int32)
        if len(empty := np.flatnonzero(pc.equal(words.dictionary, "").to_numpy(zero_copy_only=False))):
            keep = codes != empty[0]
            offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
            codes = codes[keep]
        self.words, self.codes, self.offsets = words.dictionary, codes, offsets
        self._hashes: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def word_hashes(self) -> np.ndarray:
        """Hashes of `words`, an Arrow array of the distinct words (it may hold an empty one that no code names)."""
        if self._hashes is None:
            self._hashes = hash_strings(self.words)
        return self._hashes

    @property
    def hashes(self) -> np.ndarray:
        """Hashes of all words in order."""
        return self.word_hashes[self.codes] if len(self.codes) else np.empty(0, np.uint64)

    @property
    def doc(self) -> np.ndarray:
        """The document's position, for each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def ngrams(hashes: np.ndarray, offsets: np.ndarray, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows that stay inside a document, and their offsets.

    With `short`, a document of 1 to n - 1 words has one window, all its words.
    """
    counts, m = np.diff(offsets), len(hashes)
    full = np.maximum(counts - n + 1, 0)
    starts = np.repeat(offsets[:-1] - np.concatenate(([0], np.cumsum(full)[:-1])), full) + np.arange(int(full.sum()))
    window = rolling(hashes, n)[starts] if len(starts) else np.empty(0, np.uint64)
    if short and n > 1 and ((counts > 0) & (counts < n)).any():
        few = np.flatnonzero((counts > 0) & (counts < n))
        alone = np.array([rolling(hashes[offsets[i] : offsets[i + 1]], int(counts[i]))[0] + np.uint64(counts[i]) for i in few], np.uint64)
        window = np.insert(window, np.cumsum(full)[few], alone)
        full[few] = 1
    return mix(window), np.concatenate(([0], np.cumsum(full)))


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Rabin-Karp hash (mod 2^64) of the n elements from each position; the last n - 1 positions hold no whole window.

    H(i, n) = sum of h[i + k] * P^(n - 1 - k), built by doubling: H(i, a + b) = H(i, a) * P^b + H(i + a, b).
    """
    p, m = 0x9E3779B97F4A7C15, len(hashes)
    out, done, power, width = np.zeros(m, np.uint64), 0, hashes.astype(np.uint64, copy=True), 1
    while True:
        if n & width:
            if done < m:
                out[: m - done] = out[: m - done] * np.uint64(pow(p, width, 1 << 64))
                out[: m - done] += power[done:]
            done += width
        if done >= n:
            return out
        if width < m:
            power[: m - width] = power[: m - width] * np.uint64(pow(p, width, 1 << 64)) + power[width:]
        width *= 2


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `limit` bytes of text; a longer document is a slice of its own."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start, total = np.cumsum(sizes), 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, total + limit, "right")))
        yield batch.slice(start, stop - start)
        total, start = int(ends[stop - 1]), stop


def give_back() -> None:
    """Memory that this process has freed goes back to the system: Arrow's pool and the C library keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def lean(run: Callable) -> Callable:
    """`run`, of batches, whose worker gives back what it freed when its task ends: Spark keeps idle workers, and as many as ever ran at once."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def lean_groups(run: Callable, least: int = 1 << 20) -> Callable:
    """The same of (key, table), after each group of at least so many bytes."""

    def whole(key: tuple, table: pa.Table) -> pa.Table:
        out, large = run(key, table), table.nbytes >= least
        del table
        if large:
            give_back()
        return out

    return whole
