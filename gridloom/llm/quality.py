"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Tokens of a text: for every white-space separated run its word (lower-cased letters and digits), then, if the run holds other
characters, a mark for each different one of them in order. A word equal to the word before it is written as the mark "=".
Features are the 1- and 2-grams of tokens, hashed to `2 ** bits` places; a document's vector holds their counts, its
norm 1. Training takes a bounded sample of the labelled documents (`max_labelled`, in seeded hash order): the only part that
does not read everything. Scoring reads every document whole; a score is a sparse dot product with the weights, an array of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import DROP, hash_strings, lean, mix, pieces

_G = np.uint64(0x9E3779B97F4A7C15)


def features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, value, offsets): the sparse vectors of some texts. A null text, or one without a token, has none."""
    runs = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.fill_null(texts, "")))
    offsets = runs.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0] if len(offsets) else 0
    coded = runs.flatten().dictionary_encode()
    if not len(coded):
        return np.empty(0, np.int64), np.empty(0), np.zeros(len(texts) + 1, np.int64)
    lower = pc.utf8_lower(coded.dictionary)
    words = hash_strings(pc.replace_substring_regex(lower, DROP, ""))
    none = hash_strings([""])[0]
    rest = pc.replace_substring_regex(lower, r"[\p{L}\p{N}]+", "")
    # marks: a run's other characters, each once; nearly all runs have none or one
    some = np.flatnonzero(pc.not_equal(rest, "").to_numpy(zero_copy_only=False))
    marks = np.zeros(len(lower), np.uint64)
    if len(some):
        marked = ["".join(dict.fromkeys(x)) for x in rest.take(pa.array(some)).to_pylist()]
        marks[some] = hash_strings(marked) ^ _G
    codes = coded.indices.to_numpy(zero_copy_only=False)
    word, mark = words[codes], marks[codes]
    begins = np.zeros(len(codes), bool)
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    same = np.zeros(len(codes), bool)
    same[1:] = (word[1:] == word[:-1]) & ~begins[1:]
    word[same] = np.uint64(0x3D)
    tokens = np.stack([word, mark], 1).ravel()
    real = np.stack([words[codes] != none, mark != 0], 1).ravel()
    counted = np.concatenate(([0], np.cumsum(real)))[2 * offsets]
    tokens = tokens[real]
    if not len(tokens):
        return np.empty(0, np.int64), np.empty(0), np.zeros(len(texts) + 1, np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(counted))
    two = mix(tokens[:-1] * _G + tokens[1:])[doc[:-1] == doc[1:]]
    shift = np.uint64(64 - bits)
    place = np.concatenate((mix(tokens) >> shift, two >> shift)).astype(np.int64)
    key, n = np.unique(np.concatenate((doc, doc[:-1][doc[:-1] == doc[1:]])) << bits | place, return_counts=True)
    owner = key >> bits
    ends = np.searchsorted(owner, np.arange(len(texts) + 1))
    value = n.astype(np.float64)
    norm = np.sqrt(np.bincount(owner, value * value, len(texts)))
    return key & ((1 << bits) - 1), value / norm[owner], ends


def ftrl(samples: list[tuple[np.ndarray, np.ndarray, int]], bits: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.002, l2: float = 0.02, epochs: int = 3) -> np.ndarray:
    """Weights, the last one the intercept, by per-coordinate FTRL-proximal (McMahan et al., 2013) over (places, values, label)."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    for _ in range(epochs):
        for place, value, label in samples:
            at, x = np.append(place, size), np.append(value, 1.0)
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            s = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at] = zi + g - s * w
            n[at] = ni + g * g
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def train(docs: DataFrame, labels: DataFrame, bits: int = 18, max_labelled: int = 4000, seed: int = 17, label_col: str = "quality") -> np.ndarray:
    """Weights from at most `max_labelled` documents with a label, the first in the order of xxhash64(doc_id, seed).

    Rows of null doc_id or label, or of a label other than 0 and 1, are left out; of documents labelled twice the greater label counts. Without a
    labelled document all weights are 0.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1))
        .groupBy(F.col("doc_id").cast("long").alias("__gl_id"))
        .agg(F.max(label_col).cast("int").alias("__gl_label"))
        .orderBy(F.xxhash64("__gl_id", F.lit(seed)), "__gl_id")
        .limit(max_labelled)
    )
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                place, value, ends = features(part.column("text"), bits)
                cells = [[place[a:b].astype(np.int32).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], [value[a:b].astype(np.float32).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("__gl_label"), pa.array(cells[0], pa.binary()), pa.array(cells[1], pa.binary())], ["doc_id", "label", "place", "value"])

    table = own.join(F.broadcast(chosen), own.doc_id == chosen["__gl_id"]).select("doc_id", "text", "__gl_label").mapInArrow(lean(vectors), "doc_id long, label int, place binary, value binary").toArrow()
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("doc_id", "place", "value", "label")), strict=True))
    order = np.random.default_rng(seed).permutation(len(rows))
    return ftrl([(np.frombuffer(rows[i][1], np.int32).astype(np.int64), np.frombuffer(rows[i][2], np.float32).astype(np.float64), rows[i][3]) for i in order], bits)


def _scores(texts: pa.Array, weights: np.ndarray, bits: int) -> np.ndarray:
    place, value, ends = features(texts, bits)
    sums = np.concatenate(([0.0], np.cumsum(weights[place] * value)))
    return 1 / (1 + np.exp(-np.clip(sums[ends[1:]] - sums[ends[:-1]] + weights[-1], -35, 35)))


def score(docs: DataFrame, weights: np.ndarray, bits: int = 18, threshold: float = 0.5) -> DataFrame:
    """(doc_id, p, keep) for every row: the probability of good quality, and whether it reaches `threshold`.

    A null text, or one without a token, has p of the intercept alone and keep false. Repeated rows are scored alike. Other columns
    are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for part in pieces(batch):
                p = _scores(part.column("text"), w, bits)
                blank = pc.equal(pc.utf8_trim_whitespace(pc.fill_null(part.column("text"), "")), "").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.round(p, 6)), pa.array((p >= threshold) & ~blank)], ["doc_id", "p", "keep"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, p double, keep boolean")


def keep_good(docs: DataFrame, weights: np.ndarray, bits: int = 18, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns, that `score` keeps; nothing is shuffled.

    Null, empty and blank texts go. Repeated rows are kept or dropped alike; a null doc_id doesn't matter. An empty table stays empty, and
    columns of any name pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for part in pieces(batch):
                blank = pc.equal(pc.utf8_trim_whitespace(pc.fill_null(part.column("text"), "")), "").to_numpy(zero_copy_only=False)
                yield part.filter(pa.array((_scores(part.column("text"), w, bits) >= threshold) & ~blank))

    return docs.mapInArrow(lean(run), docs.schema)
