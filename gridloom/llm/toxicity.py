"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

A sentence is a bag of units: its words (letters and digits only, so characters of other kinds inside a word don't count); every
run of three or more one-character words, joined ("i d i o t"); and pairs and triples of neighbouring short words, joined ("stu pid"), where
more than half of their runs of three letters, and two at least, occur in words that training found to be toxic. The kernel of two
units is the gap-weighted subsequence kernel of Lodhi et al. (2002), here of length 4 and decay 0.7, normalised: characters put into a word,
or left out, lower it a little and don't hide it. Words of two and three letters, which have no subsequence of length 4, are only
compared whole with the toxic words of training.
Units are mapped to the kernel's Nyström features over landmark strings, and a linear SVM scores them; a sentence scores as its highest unit, and
a text as its highest sentence (a multiple-instance SVM: labels say that some sentence of a text is toxic, not which). Every different unit of
the corpus is scored once.

Training takes a bounded sample of the labelled documents (`max_labelled`), the only part that does not read everything.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.graph import union

from .common import cut
from .text import Chunk, hash_strings, mix, pieces

LENGTH, DECAY, LANDMARKS, LONGEST = 4, 0.7, 40, 24
#: Most letters of each of two, and of each of three, words that are joined; of the joined unit.
PAIR, TRIPLE, JOINED = 6, 4, 11
#: Pairs of variants, of one and of two characters put in, that each insult is trained with.
NOISE = 4


def units(chunk: Chunk) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(units, unit, doc): the different units of a chunk, and where they occur."""
    words = chunk.words.to_pylist()
    if not len(chunk.codes):
        return words, chunk.codes, np.empty(0, np.int64)
    single = np.array([len(w) == 1 for w in words])[chunk.codes]
    unit, doc = chunk.codes.astype(np.int64), chunk.doc
    if single.any():
        edge = np.ones(len(unit), bool)
        edge[1:] = (single[1:] != single[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(edge)
        size = np.diff(np.append(first, len(unit)))
        more, where, index = [], [], {w: i for i, w in enumerate(words)}
        for a, n in zip(first[single[first] & (size >= 3)], size[single[first] & (size >= 3)], strict=True):
            joined = "".join(words[c] for c in chunk.codes[a : a + n])
            if joined not in index:
                index[joined] = len(words)
                words.append(joined)
            more.append(index[joined])
            where.append(doc[a])
        if more:
            unit, doc = np.append(unit, more), np.append(doc, where)
    return words, unit, doc


def _ends(chunk: Chunk, trigrams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word of a chunk: how many of its runs of three letters are in the table, and its first, second, last and last but one letter (0 if it has none)."""
    names = chunk.words.to_pylist()
    codes, sizes = _codes(names)
    codes = np.concatenate((codes, np.zeros((len(names), 2), codes.dtype)), 1)
    inner, at = np.zeros(len(names), np.int64), np.arange(len(names))
    for k in np.unique(sizes):
        if k >= 3:
            own = np.flatnonzero(sizes == k)
            inner[own] = trigrams[_trigrams(codes[own, :k])].sum(1)
    last = np.where(sizes > 0, codes[at, np.maximum(sizes - 1, 0)], 0)
    return inner, np.stack((np.where(sizes > 0, codes[:, 0], 0), np.where(sizes > 1, codes[:, 1], 0), last, np.where(sizes > 1, codes[at, np.maximum(sizes - 2, 0)], 0)))


def joins(chunk: Chunk, trigrams: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(units, unit, doc): the different joined pairs and triples of neighbouring short words of a document, and where they begin; with a table of trigrams, those that `may` lets through."""
    n, w = len(chunk.codes), max(1, len(chunk.words))
    lengths = pc.utf8_length(chunk.words).to_numpy(zero_copy_only=False).astype(np.int64)
    size, ends = lengths[chunk.codes] if n else np.empty(0, np.int64), None
    doc, code = chunk.doc, chunk.codes.astype(np.int64)
    strings, unit, where, done = [], [], [], 0
    for k, most in ((2, PAIR), (3, TRIPLE)):
        if n < k:
            continue
        m = n - k + 1
        ok = (doc[:m] == doc[k - 1 :]) & (sum(size[i : m + i] for i in range(k)) <= JOINED)
        for i in range(k):
            ok &= size[i : m + i] <= most
        ok &= sum((size[i : m + i] > 1).astype(np.int64) for i in range(k)) > 0  # all of one letter: a run, in `units`
        at = np.flatnonzero(ok)
        key = code[at]
        for i in range(1, k):
            key = key * w + code[at + i]
        key, place = np.unique(key, return_inverse=True)
        parts, rest = [], key
        for _ in range(k):
            parts.insert(0, rest % w)
            rest = rest // w
        if trigrams is not None:
            inner, (head, head2, tail, tail2) = ends = ends or _ends(chunk, trigrams)
            run = lambda a, b, c: trigrams[_trigrams(np.stack((a, b, c), 1))[:, 0]] & (a > 0) & (b > 0) & (c > 0)
            hits = sum(inner[x] for x in parts)
            for x, y in zip(parts[:-1], parts[1:], strict=True):
                hits = hits + run(tail2[x], tail[x], head[y]) + run(tail[x], head[y], head2[y])
            if k == 3:  # a middle word of one letter: the run over all three
                x, y, z = parts
                hits = hits + (run(tail[x], head[y], head[z]) & (head2[y] == 0))
            letters = sum(lengths[x] for x in parts)
            some = (hits >= 2) & (2 * hits > letters - 2)
            number = np.cumsum(some) - 1
            inside = some[place]
            at, place, parts = at[inside], number[place[inside]], [x[some] for x in parts]
            key = key[some]
        parts = [chunk.words.take(pa.array(x)) for x in parts]
        strings.append(pc.binary_join_element_wise(*parts, ""))
        unit.append(place + done)
        where.append(doc[at])
        done += len(key)
    if not strings:
        return pa.array([], pa.string()), np.empty(0, np.int64), np.empty(0, np.int64)
    return pa.concat_arrays(strings), np.concatenate(unit), np.concatenate(where)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, padded with 0, and lengths."""
    sizes = np.array([len(w) for w in words], np.int64)
    out = np.zeros((len(words), int(sizes.max()) if len(words) else 0), np.uint32)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(words)), sizes), at] = flat
    return out, sizes


def kernel(s: np.ndarray, t: np.ndarray, n: int = LENGTH, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted subsequence kernels (not normalised) of s (words, p) against t (words, q), or pair by pair if t is (words, 1, q).

    The sum over common subsequences of length n of decay ** (span in s + span in t). Padding is 0 and matches nothing.
    """
    t = t if t.ndim == 3 else t[None, :, :]
    p, q = s.shape[1], t.shape[2]
    shape = (s.shape[0], t.shape[1])
    if not p or not q:
        return np.zeros(shape, np.float32)
    d, d2 = np.float32(decay), np.float32(decay * decay)
    # before[r][j]: of order r, over starts before the current row and up to column j, decayed to (row - 1, j)
    before = [[np.zeros(shape, np.float32) for _ in range(q)] for _ in range(n)]
    total = np.zeros(shape, np.float32)
    for i in range(p):
        c = s[:, i : i + 1]
        new: list[list[np.ndarray]] = [[] for _ in range(n)]
        hits = [((c == t[..., j]) & (c != 0)).astype(np.float32) * d2 for j in range(q)]
        for r in range(1, n + 1):
            run = None
            for j in range(q):
                if r == 1:
                    here = hits[j]
                elif j == 0:
                    here = None
                else:
                    here = hits[j] * before[r - 1][j - 1]
                if r == n:
                    if here is not None:
                        total += here
                else:
                    run = (np.zeros(shape, np.float32) if here is None else here.copy()) if run is None else run * d + (here if here is not None else 0)
                    new[r].append(before[r][j] * d + run)
        for r in range(1, n):
            before[r] = new[r]
    return total


def _trigrams(codes: np.ndarray) -> np.ndarray:
    """Hashes below 2^16 of the runs of three characters of words; where a word has ended, 0."""
    if codes.shape[1] < 3:
        return np.zeros((len(codes), 0), np.int64)
    a, b, c = (codes[:, i : codes.shape[1] - 2 + i].astype(np.uint64) for i in range(3))
    return np.where(c > 0, (mix((a << np.uint64(42)) | (b << np.uint64(21)) | c) & np.uint64(0xFFFF)).astype(np.int64), 0)


class Svm:
    """Landmarks, Nyström map and linear weights, a column for each group of insults: score(units) > 0 is toxic. Joined units need `extra` more, short ones are toxic if they are in `short`."""

    def __init__(self, landmarks: list[str]):
        self.landmarks, self.trigrams, self.extra, self.short = landmarks, np.zeros(1 << 16, bool), 0.0, set()
        self.t, _ = _codes(landmarks)
        self.own = np.sqrt(np.diag(kernel(self.t, self.t)))
        k = kernel(self.t, self.t) / np.maximum(self.own[:, None] * self.own[None, :], 1e-30)
        value, vector = np.linalg.eigh(k.astype(np.float64))
        keep = value > 1e-4
        self.map = (vector[:, keep] / np.sqrt(value[keep])).astype(np.float32)
        self.w, self.b = np.zeros((keep.sum(), 1), np.float32), np.array([-1], np.float32)

    def may(self, joined: pa.Array) -> np.ndarray:
        """Places of the joined units of which more than half of the runs of three letters, and two at least, are those of witnesses."""
        sizes = pc.utf8_length(joined).to_numpy(zero_copy_only=False)
        out = [np.empty(0, np.int64)]
        for k in range(4, JOINED + 1):
            at = np.flatnonzero(sizes == k)
            if len(at):
                codes, _ = _codes(joined.take(pa.array(at)).to_pylist())
                hits = self.trigrams[_trigrams(codes)].sum(1)
                out.append(at[(hits >= 2) & (2 * hits > k - 2)])
        return np.sort(np.concatenate(out))

    def features(self, words: list[str], block: int = 8192) -> np.ndarray:
        """Nyström features. Words over LONGEST characters take part by every stretch of LONGEST, half overlapping: see `score`."""
        out = np.zeros((len(words), self.map.shape[1]), np.float32)
        sizes = np.array([len(w) for w in words], np.int64)
        by = np.argsort(sizes, kind="stable")
        start = int(np.searchsorted(sizes[by], LENGTH))  # shorter ones have no subsequence of that length
        while start < len(by):
            stop = min(len(by), start + block, int(np.searchsorted(sizes[by], sizes[by[start]], "right")))
            at = by[start:stop]
            s, _ = _codes([words[i] for i in at])
            own = np.sqrt(kernel(s, s[:, None, :])[:, 0])
            out[at] = (kernel(s, self.t) / np.maximum(own[:, None] * self.own[None, :], 1e-30)) @ self.map
            start = stop
        return out

    def score(self, words: list[str]) -> np.ndarray:
        """Decision values; of a word over LONGEST characters the greatest of its stretches' values."""
        parts, owner = [], []
        for i, w in enumerate(words):
            if len(w) <= LONGEST:
                parts.append(w)
                owner.append(i)
            else:
                for a in range(0, len(w) - LONGEST // 2, LONGEST // 2):
                    parts.append(w[a : a + LONGEST])
                    owner.append(i)
        out = np.full(len(words), -np.inf)
        np.maximum.at(out, np.array(owner, np.int64), (self.features(parts) @ self.w + self.b).max(1))
        for i in [i for i, w in enumerate(words) if w in self.short]:
            out[i] = 1.0
        return out


def _noisy(word: str, rng: np.random.Generator, letters: str) -> list[str]:
    """The word with one character put in, and with two."""
    a, b = sorted(rng.integers(1, max(2, len(word)), 2))
    x, y = (letters[i] for i in rng.integers(0, len(letters), 2))
    return [word[:a] + x + word[a:], word[:a] + x + word[a:b] + y + word[b:]]


def _alike(words: list[str], least: float = 0.25) -> list[list[str]]:
    """The words in groups: those of a normalised kernel of at least `least` are in one."""
    codes, _ = _codes(words)
    k = kernel(codes, codes)
    own = np.sqrt(np.diag(k))
    x, y = np.nonzero(k / np.maximum(own[:, None] * own[None, :], 1e-30) >= least)
    nodes, roots = union(np.concatenate((x, np.arange(len(words)))), np.concatenate((y, np.arange(len(words)))))
    return [[words[i] for i in nodes[roots == r]] for r in np.unique(roots)]


def fit(bags: list[tuple[list[str], int]], joined: list[str] | None = None, landmarks: int = LANDMARKS, seed: int = 17, negatives: int = 12_000, rounds: int = 3, chance: float = 0.2, stray: float = 0.05) -> Svm:
    """A multiple-instance SVM from (units of a text, label), and the joined units of negative texts.

    Texts that share their two least unit hashes count as copies of one, so copies lend no weight. A positive text's witnesses are at
    first its units that occur in n positive texts, and in at most `stray` as many negative ones (labels may be wrong), n so great that, were labels drawn by chance, `chance` of
    all units would be expected to do so; later, those of 2 texts that the SVM scores above the margin too. All units of negative texts are negative (`negatives` of them, the most frequent half and a seeded draw, plus
    all that come out above the margin). Landmarks are spread over the positive words by farthest-first traversal, a quarter over negative ones.
    Insults that are like one another share an SVM against all clean units, so insults that are near to clean words make no others strict; a unit scores as its highest.
    The threshold of each lies above all units of the negative texts; that of joined units above all joined units of negative texts too.
    """
    rng = np.random.default_rng(seed)
    pos, neg, seen, texts = Counter(), Counter(), set(), 0
    for words, label in bags:
        own = sorted(set(words))
        copy = (label, *np.sort(hash_strings(own))[:2].tolist())
        (pos if label else neg).update(own if copy not in seen else () if label else own)
        texts += label and copy not in seen
        seen.add(copy)
    share = texts / max(1, len(seen))  # of positive texts
    least = max(3, int(np.ceil(np.log(max(1, len(pos)) / chance) / -np.log(share)))) if 0 < share < 1 else 3
    ill = {w for w, n in pos.items() if n >= least and neg[w] <= stray * n and len(w) > 1}
    clean = sorted((w for w in neg if len(w) >= LENGTH and w not in ill), key=lambda w: (-neg[w], w))
    bad = sorted((w for w in ill if len(w) >= LENGTH), key=lambda w: (-pos[w], w))
    if not bad:
        model = Svm(clean[:2] or ["abc"])
        model.short = ill
        return model

    def spread(words: list[str], k: int) -> list[str]:
        sizes = np.array([len(w) for w in words])
        groups = [(at, _codes([words[i] for i in at])[0]) for at in (np.flatnonzero(sizes == k) for k in np.unique(sizes))]
        own = np.zeros(len(words))
        for at, s in groups:
            own[at] = np.sqrt(kernel(s, s[:, None, :])[:, 0])
        near, chosen = np.zeros(len(words)), [0]
        while len(chosen) < min(k, len(words)):
            i = chosen[-1]
            t, _ = _codes([words[i]])
            for at, s in groups:
                near[at] = np.maximum(near[at], kernel(s, t)[:, 0] / np.maximum(own[at] * own[i], 1e-30))
            near[chosen] = 2
            chosen.append(int(near.argmin()))
        return [words[i] for i in chosen]

    model = Svm(spread(bad, landmarks * 3 // 4) + spread([w for w in clean if len(w) <= LONGEST], landmarks - landmarks * 3 // 4))
    short = [w for w in clean if len(w) <= LONGEST]
    x_all = model.features(short)
    half = negatives // 2
    draw = np.concatenate((np.arange(min(half, len(short))), half + rng.permutation(max(0, len(short) - half))[: negatives - half]))
    letters = "".join(sorted({c for w in short for c in w}))
    for turn in range(rounds):
        xn, parts = x_all[draw], []
        for group in _alike(bad):
            xp = model.features(group + [v for w in group for _ in range(NOISE) for v in _noisy(w, rng, letters)])
            x = np.concatenate((xp, xn)).astype(np.float64)
            y = np.concatenate((np.ones(len(xp)), -np.ones(len(xn))))
            parts.append(_hinge(x, y, np.where(y > 0, len(y) / (2 * len(xp)), len(y) / (2 * len(xn)))))
        model.w, model.b = np.stack([w for w, _ in parts], 1), np.array([b for _, b in parts])
        known = set(bad)
        more = sorted({w for w in pos if neg[w] <= stray * pos[w] and pos[w] >= 2 and len(w) >= LENGTH and w not in known})
        if turn + 1 < rounds and more:
            bad += [w for w, s in zip(more, model.score(more), strict=True) if s > 1]
        draw = np.union1d(draw, np.flatnonzero((x_all @ model.w + model.b).max(1) > -0.5))
    top = np.maximum((x_all @ model.w + model.b).max(0), 0.0) if short else np.zeros(len(model.b))
    model.b = (model.b - top - 0.02).astype(np.float32)
    model.short = {w for w in ill if len(w) < LENGTH}
    for w in bad:
        model.trigrams[_trigrams(_codes([w])[0])] = True
    model.trigrams[0] = False
    ill |= set(bad)
    rest = pa.array([w for w in joined or [] if w not in ill], pa.string())
    if len(near := model.may(rest)):
        model.extra = max(0.0, float(model.score(rest.take(pa.array(near)).to_pylist()).max()) + 0.02)
    return model


def _hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, steps: int = 50) -> tuple[np.ndarray, np.float32]:
    """Squared-hinge SVM in the primal by Newton steps on the active set (Keerthi and DeCoste, 2005)."""
    z = np.concatenate((x, np.ones((len(x), 1))), 1)
    w = np.zeros(z.shape[1])
    ridge = np.eye(z.shape[1]) / c
    ridge[-1, -1] = 1e-6
    weight = weight / len(x)
    active = None
    for _ in range(steps):
        now = y * (z @ w) < 1
        if active is not None and (now == active).all():
            break
        active = now
        a = z[now] * weight[now, None]
        w = np.linalg.solve(a.T @ z[now] + ridge * 1e-3, a.T @ y[now])
    return w[:-1].astype(np.float32), np.float32(w[-1])


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 4000, seed: int = 17, label_col: str = "toxic") -> Svm:
    """An SVM from at most `max_labelled` labelled documents, the first in the order of xxhash64(doc_id, seed).

    Rows of null doc_id or label, or a label other than 0 and 1, are left out; the greater of two labels of a document counts.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1))
        .groupBy(F.col("doc_id").cast("long").alias("__gl_id"))
        .agg(F.max(label_col).cast("int").alias("__gl_label"))
        .orderBy(F.xxhash64("__gl_id", F.lit(seed)), "__gl_id")
        .limit(max_labelled)
    )
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(names: list[str], unit: np.ndarray, doc: np.ndarray, rows: int) -> pa.Array:
            pairs = np.unique(doc * max(1, len(names)) + unit)
            ends = np.searchsorted(pairs // max(1, len(names)), np.arange(rows + 1))
            return pa.array([" ".join(names[u] for u in pairs[a:b] % max(1, len(names))) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())

        for batch in batches:
            for part in pieces(batch):
                chunk = Chunk(part.column("text"))
                names, unit, doc = joins(chunk)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("__gl_label"), lists(*units(chunk), part.num_rows), lists(names.to_pylist(), unit, doc, part.num_rows)], ["doc_id", "label", "units", "joined"])

    table = own.join(F.broadcast(chosen), own.doc_id == chosen["__gl_id"]).select("doc_id", "text", "__gl_label").mapInArrow(bags, "doc_id long, label int, units string, joined string").toArrow()
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("doc_id", "units", "label", "joined")), strict=True))
    return fit([(u.split(), y) for _, u, y, _ in rows], sorted({w for _, _, y, j in rows if not y for w in j.split()}), seed=seed)


def toxic_units(docs: DataFrame, model: Svm) -> DataFrame:
    """(unit, joined, score): the different units of all texts that score above 0, joined ones above the model's `extra`.

    Null, empty and blank texts have no unit, repeated rows no further one. Other columns are ignored; an empty table gives an empty result.
    """

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = [pa.array([], pa.string())] * 2
        for batch in batches:
            for part in pieces(batch):
                chunk = Chunk(part.column("text"))
                new = pa.array([w for w in units(chunk)[0] if len(w) > 1], pa.string()), joins(chunk, model.trigrams)[0]
                held = [pc.unique(pa.concat_arrays([a, b])) for a, b in zip(held, new, strict=True)]
                if sum(h.nbytes for h in held) > 32 << 20:
                    yield from out(held)
                    held = [pa.array([], pa.string())] * 2
        yield from out(held)

    def out(held: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        for h, joined in zip(held, (False, True), strict=True):
            yield pa.RecordBatch.from_arrays([h, pa.array(np.full(len(h), joined))], ["unit", "joined"])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, joined = batch.column("unit").to_pylist(), batch.column("joined").to_numpy(zero_copy_only=False)
            score = model.score(words) if words else np.empty(0)
            hit = np.flatnonzero(score > np.where(joined, model.extra, 0))
            yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in hit], pa.string()), pa.array(joined[hit]), pa.array(np.round(score[hit], 5))], ["unit", "joined", "score"])

    return cut(docs.select("text").mapInArrow(collect, "unit string, joined boolean").distinct().mapInArrow(rate, "unit string, joined boolean, score double"))


def toxic_documents(docs: DataFrame, model: Svm, limit: int = 500_000) -> DataFrame:
    """(doc_id, score, unit): the toxic documents, with their highest unit (ties: the least string) and its score.

    Whole texts are read, and every unit of two letters and more is scored. Null, empty and blank texts are not toxic. Repeated rows are reported as often as they occur; null doc_ids stay null. Other columns are ignored. An
    empty table gives an empty result. Should the toxic units be more than `limit`, they are applied in slices of that size, one
    after the other, so that what the driver holds and the tasks get stays bounded; the result is the same.
    """
    spark = docs.sparkSession
    found = toxic_units(docs, model).orderBy(F.desc("score"), "unit")
    total = found.count()
    own, marks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), []
    slices = max(1, -(-total // limit))
    # repeated rows stay apart by a number, which must not change from slice to slice
    own = cut(own.withColumn("row", F.monotonically_increasing_id())) if slices > 1 else own.withColumn("row", F.lit(0).cast("long"))
    for i in range(slices):
        part = found if slices == 1 else found.where(F.pmod(F.xxhash64("unit"), F.lit(slices)) == i)
        table = part.toArrow()
        words, joined, score = table.column("unit").to_pylist(), table.column("joined").to_numpy(), table.column("score").to_numpy().astype(np.float64)
        order = np.lexsort((joined, np.array(words, dtype=object), -score)) if len(words) else np.empty(0, np.int64)
        ranked = [words[k] for k in order]
        h, second = hash_strings(ranked), joined[order].astype(bool)
        ranks = [np.flatnonzero(~second), np.flatnonzero(second)]
        ranks = [r[np.argsort(h[r])] for r in ranks]
        shared = spark.sparkContext.broadcast((h, ranks, ranked, score[order]))

        def mark(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known, ranks, names, scores = shared.value
            for batch in batches:
                for piece in pieces(batch):
                    chunk = Chunk(piece.column("text"))
                    best = np.full(piece.num_rows, len(names), np.int64)
                    for rank, (words, unit, doc) in zip(ranks, (units(chunk), joins(chunk, model.trigrams)), strict=True):
                        if len(rank) and len(words):
                            h = hash_strings(words)
                            k = np.minimum(np.searchsorted(known[rank], h), len(rank) - 1)
                            of = np.where(known[rank[k]] == h, rank[k], len(names))
                            hit = of[unit] < len(names)
                            np.minimum.at(best, doc[hit], of[unit[hit]])
                    some = np.flatnonzero(best < len(names))
                    yield pa.RecordBatch.from_arrays([piece.column("row").take(pa.array(some)), piece.column("doc_id").take(pa.array(some)), pa.array(scores[best[some]] if len(some) else np.empty(0)), pa.array([names[b] for b in best[some]], pa.string())], ["row", "doc_id", "score", "unit"])

        marked = own.mapInArrow(mark, "row long, doc_id long, score double, unit string")
        if slices == 1:
            return marked.drop("row")
        marks.append(cut(marked))
        shared.destroy()
    best = reduce(DataFrame.unionByName, marks).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.min(F.struct((-F.col("score")).alias("s"), "unit")).alias("m"))
    return best.select("doc_id", (-F.col("m.s")).alias("score"), "m.unit")
