"""Language-model scoring with Brown class-based n-grams.

The `core` most frequent words are put into `classes` classes by the exchange algorithm, which moves one word at a time to the class that
raises the bigram likelihood most. Every other word of the corpus, however rare, then makes one exchange move too: from its bigram counts with the core's
words to the class that raises the likelihood most, the core's table of class bigrams given. The model is
P(w | v) = P(class(w) | class(v)) * P(w | class(w)): class transitions interpolated with class frequencies, and word emissions from the
counts of all words. Beginning and end of a text are a class of their own.

Texts are coded once, as numbers of their chunk's different words, and written down. The table of words grows with the corpus: it is never collected
or sent to tasks, but joined with the different words of each chunk. Only the core's bigram counts and the class bigrams meet on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .text import Chunk, pieces

CORE, CLASSES = 2048, 64
#: Bytes of text of a chunk: the larger, the fewer different words there are in all chunks together.
CHUNK = 16 << 20
_CODED = "chunk long, ids binary, known binary, ends binary, codes binary, words binary"


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(left: np.ndarray, right: np.ndarray, n: np.ndarray, size: int, classes: int, rounds: int = 6) -> np.ndarray:
    """The class of each of `size` words (the most frequent first) from bigram counts n of (left, right); maximises
    sum N(c, d) ln N(c, d) - 2 sum N(c) ln N(c). Ends when a round moves no word, or after `rounds`. Ties: the lowest class."""
    classes = max(1, min(classes, size))
    of = np.arange(size) % classes
    n = n.astype(np.float64)
    by_l, by_r = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    at_l, at_r = np.searchsorted(left[by_l], np.arange(size + 1)), np.searchsorted(right[by_r], np.arange(size + 1))
    table = np.bincount(of[left] * classes + of[right], n, classes * classes).reshape(classes, classes)
    for _ in range(rounds):
        moved = 0
        for w in range(size):
            a, b = by_l[at_l[w] : at_l[w + 1]], by_r[at_r[w] : at_r[w + 1]]
            loop = float(n[a][right[a] == w].sum())
            out = np.bincount(of[right[a]], n[a], classes)
            into = np.bincount(of[left[b]], n[b], classes)
            c = of[w]
            out[c] -= loop
            into[c] -= loop
            table[c, :] -= out
            table[:, c] -= into
            table[c, c] -= loop
            row, col = _xlogx(table + out[None, :]) - _xlogx(table), _xlogx(table + into[:, None]) - _xlogx(table)
            d = np.arange(classes)
            gain = row.sum(1) + col.sum(0) - row[d, d] - col[d, d] + _xlogx(table[d, d] + out + into + loop) - _xlogx(table[d, d])
            sums_r, sums_c, o, i = table.sum(1), table.sum(0), out.sum() + loop, into.sum() + loop
            gain -= _xlogx(sums_r + o) - _xlogx(sums_r) + _xlogx(sums_c + i) - _xlogx(sums_c)
            best = int(np.argmax(gain - 1e-9 * (d != c)))
            of[w] = best
            moved += best != c
            table[best, :] += out
            table[:, best] += into
            table[best, best] += loop
        if not moved:
            break
    return of


@dataclass
class Coded:
    """Some texts as codes of `words` (hashes): text i has codes[ends[i]:ends[i + 1]]; its id is ids[i] where known[i]."""

    chunk: int
    ids: np.ndarray
    known: np.ndarray
    ends: np.ndarray
    codes: np.ndarray
    words: np.ndarray

    def framed(self, symbols: np.ndarray, edge: int) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words in order, each text between two edges, and which neighbours belong to one text."""
        n = len(self.ids)
        seq = np.full(len(self.codes) + 2 * n, edge, np.int64)
        doc = np.repeat(np.arange(n), np.diff(self.ends))
        seq[np.arange(len(self.codes)) + 2 * doc + 1] = symbols[self.codes] if len(self.codes) else 0
        inside = np.ones(max(0, len(seq) - 1), bool)
        inside[(self.ends[1:] + np.arange(1, n + 1) * 2)[:-1] - 1] = False
        return seq, inside


def _pack(x: np.ndarray) -> bytes:
    """The size, then the bytes compressed."""
    raw = x.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(x: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True), kind)


def _texts(batch: pa.RecordBatch) -> Iterator[Coded]:
    names = batch.schema.names
    for i in range(batch.num_rows):
        cell = lambda c: batch.column(c)[i].as_py()  # noqa: E731, B023
        yield Coded(cell("chunk"), np.frombuffer(cell("ids"), np.int64), np.frombuffer(cell("known"), np.uint8) > 0, np.frombuffer(cell("ends"), np.int64), _unpack(cell("codes"), np.uint32), np.frombuffer(cell("words"), np.uint64) if "words" in names else np.empty(0, np.uint64))


def encode(docs: DataFrame) -> DataFrame:
    """The texts of `docs` in chunks, written down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in pieces(batch, limit=CHUNK):
                c = Chunk(part.column("text"))
                used = np.unique(c.codes)
                place = np.zeros(len(c.words) + 1, np.uint32)
                place[used] = np.arange(len(used))
                ids = part.column("doc_id")
                row = [number, ids.fill_null(0).to_numpy().tobytes(), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(), c.offsets.tobytes(), _pack(place[c.codes]), c.word_hashes[used].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64() if k == 0 else pa.binary()) for k, x in enumerate(row)], ["chunk", "ids", "known", "ends", "codes", "words"])
                number += 1

    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _CODED))


@dataclass
class Model:
    """`words` (key, cls, n): every word's hash, class and count. `core`: ascending hashes, classes and counts of the core. `size`: words of each class.
    `trans`: log probabilities of class transitions; after the classes come one of unknown words, which no training text has, and the edge."""

    words: DataFrame
    core: tuple[np.ndarray, np.ndarray, np.ndarray]
    size: np.ndarray
    types: int
    trans: np.ndarray


def transitions(pairs: np.ndarray, mixing: float = 0.1) -> np.ndarray:
    total, rows = max(1.0, pairs.sum()), pairs.sum(1, keepdims=True)
    uni = (pairs.sum(0) + 1) / (total + len(pairs))
    return np.log((1 - mixing) * pairs / np.maximum(rows, 1) + np.where(rows > 0, mixing, 1.0) * uni)


def _sum_pairs(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts)
    u, at = np.unique(k, return_inverse=True)
    return u, np.bincount(at, n, len(u)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch], count, flush: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """(key, n) sums of what `count` gives for the coded texts of a task, sent whenever `flush` different keys are held."""
    keys: list[np.ndarray] = []
    sums: list[np.ndarray] = []
    held = 0
    for batch in batches:
        for text in _texts(batch):
            k, n = count(text)
            keys.append(k)
            sums.append(n)
            held += len(k)
            if held > flush:
                k, n = _sum_pairs(keys, sums)
                keys, sums, held = [k], [n], len(k)
                if held > flush // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["key", "n"])
                    keys, sums, held = [], [], 0
    if keys:
        k, n = _sum_pairs(keys, sums)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["key", "n"])


def _find(sorted_hashes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of words among ascending hashes."""
    if not len(sorted_hashes):
        return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
    at = np.minimum(np.searchsorted(sorted_hashes, words), len(sorted_hashes) - 1)
    return at, sorted_hashes[at] == words


def _neighbours(batches: Iterator[pa.RecordBatch], known: np.ndarray, cls: np.ndarray, classes: int) -> Iterator[pa.RecordBatch]:
    """(key, slots, counts) of a chunk's words outside the core: how often one comes before the core's words of class slot, or after those of class slot - classes."""

    def one(c: Coded) -> tuple[np.ndarray, np.ndarray]:
        at, there = _find(known, c.words)
        # symbols: a core word its class, any other one classes + 1 + its place; an edge is neither
        seq, inside = c.framed(np.where(there, cls[at] if len(cls) else 0, classes + 1 + np.arange(len(c.words))), classes)
        left, right = seq[:-1][inside], seq[1:][inside]
        before, after = (left > classes) & (right < classes), (right > classes) & (left < classes)
        key = np.concatenate(((left[before] - classes - 1) * 2 * classes + right[before], (right[after] - classes - 1) * 2 * classes + classes + left[after]))
        return np.unique(key, return_counts=True)

    for batch in batches:
        for text in _texts(batch):
            key, n = one(text)
            word, slot = key // (2 * classes), (key % (2 * classes)).astype(np.uint16)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            ends = np.append(first, len(word)).astype(np.int32)
            cells = [pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends * x.itemsize), pa.py_buffer(x)]) for x in (slot, n.astype(np.uint32))]
            yield pa.RecordBatch.from_arrays([pa.array(text.words[word[first]].view(np.int64)), *cells], ["key", "slots", "counts"])


def place_words(word: np.ndarray, slot: np.ndarray, n: np.ndarray, words: int, table: np.ndarray) -> np.ndarray:
    """The class of each of `words` words, from counts n of (word, slot), ascending by word: where it raises the likelihood most, the class bigrams `table` given. Ties: the lowest class."""
    classes = len(table)
    gain, rows, cols = np.zeros((words, classes)), table.sum(1), table.sum(0)
    before = slot < classes
    for own, t in ((before, table), (~before, table.T)):
        w, d, k = word[own], slot[own] % classes, n[own].astype(np.float64)
        for a in range(0, len(w), 1 << 15):
            part = slice(a, a + (1 << 15))
            add = t[:, d[part]].T
            value = _xlogx(add + k[part, None]) - _xlogx(add)
            first = np.flatnonzero(np.diff(w[part], prepend=-1))
            gain[w[part][first]] += np.add.reduceat(value, first, axis=0)
    # into its own class a word brings both counts to one cell
    out, into = np.zeros((words, classes)), np.zeros((words, classes))
    np.add.at(out, (word[before], slot[before]), n[before])
    np.add.at(into, (word[~before], slot[~before] - classes), n[~before])
    diagonal = np.diag(table)[None, :]
    gain += _xlogx(diagonal + out + into) + _xlogx(diagonal) - _xlogx(diagonal + out) - _xlogx(diagonal + into)
    o, i = out.sum(1, keepdims=True), into.sum(1, keepdims=True)
    gain -= _xlogx(rows[None, :] + o) - _xlogx(rows)[None, :] + _xlogx(cols[None, :] + i) - _xlogx(cols)[None, :]
    return np.argmax(gain - 1e-9 * np.arange(classes), 1)


def _placed(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(key, cls) from (key, slots, counts) that come sorted by key; a key may run over batches."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, n = (np.frombuffer(b"".join(x for b in held for x in b.column(c).to_pylist()), kind).astype(np.int64) for c, kind in ((1, np.uint16), (2, np.uint32)))
        key = np.concatenate([np.repeat(b.column(0).to_numpy(), pc.binary_length(b.column(1)).to_numpy() // 2) for b in held])
        first = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        word = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
        cell, at = np.unique(word * (2 * len(table)) + slot, return_inverse=True)
        sums = np.bincount(at, n)
        for a in range(0, len(first), 8192):
            low, high = np.searchsorted(cell, [a * 2 * len(table), (a + 8192) * 2 * len(table)])
            some = min(8192, len(first) - a)
            yield pa.RecordBatch.from_arrays([pa.array(key[first[a : a + some]]), pa.array(place_words(cell[low:high] // (2 * len(table)) - a, cell[low:high] % (2 * len(table)), sums[low:high], some, table).astype(np.int32))], ["key", "cls"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        start = int(np.flatnonzero(key == key[-1])[0])
        if start and key[start - 1] == key[-1]:
            raise RuntimeError("keys must come sorted")
        if start == 0 and held and held[-1].column(0)[-1].as_py() == key[0]:
            held.append(batch)
            continue
        held.append(batch.slice(0, start))
        if any(h.num_rows for h in held):
            yield from flush([h for h in held if h.num_rows])
        held = [batch.slice(start)]
    if held:
        yield from flush(held)


def lookup(coded: DataFrame, model_words: DataFrame, core: tuple[np.ndarray, np.ndarray, np.ndarray], unknown: int) -> DataFrame:
    """`coded` with the classes and counts of each chunk's words in place of their hashes, written down; a word that the model doesn't know has the class `unknown` and count 0."""

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The places of the core's words in the core and in the chunk, and the number of the chunk's words, stand for the hashes."""
        for batch in batches:
            rows = []
            for c in _texts(batch):
                at, there = _find(core[0], c.words)
                rows.append((np.flatnonzero(there).astype(np.int32).tobytes(), at[there].astype(np.int32).tobytes(), len(c.words)))
            own = batch.drop_columns(["words"])
            yield pa.RecordBatch.from_arrays([*own.columns, *[pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.int64()))]], [*own.schema.names, "place", "at", "width"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in _texts(batch):
                rest = np.flatnonzero(~_find(core[0], c.words)[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rest), c.chunk)), pa.array(rest.astype(np.int32)), pa.array(c.words[rest].view(np.int64))], ["chunk", "place", "key"])

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.slice(0, 1).to_batches()[0]
        cell = lambda k: np.frombuffer(row.column(k)[0].as_py(), np.int32)
        cls, n = (np.full(row.column("width")[0].as_py(), x, np.int64) for x in (unknown, 0))
        cls[cell("place")], n[cell("place")] = core[1][cell("at")], core[2][cell("at")]
        place = right.column("place").to_numpy()
        cls[place], n[place] = right.column("cls").to_numpy(), right.column("n").to_numpy()
        return pa.Table.from_batches([row.drop_columns(["place", "at", "width"])]).append_column("cls", pa.array([_pack(cls.astype(np.int32))], pa.binary())).append_column("n", pa.array([_pack(n.astype(np.int64))], pa.binary()))

    found = coded.mapInArrow(ask, "chunk long, place int, key long").join(model_words, "key").select("chunk", "place", "cls", "n")
    short = _CODED.removesuffix(", words binary")
    stripped = coded.mapInArrow(strip, f"{short}, place binary, at binary, width long")
    return cut(stripped.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(join, f"{short}, cls binary, n binary"))


def fit(docs: DataFrame, core: int = CORE, classes: int = CLASSES, coded: DataFrame | None = None) -> tuple[Model, DataFrame]:
    """(model, the texts with their classes) of all texts of `docs`."""
    spark, coded = docs.sparkSession, encode(docs) if coded is None else coded

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _counted(batches, lambda c: (c.words.view(np.int64), np.bincount(c.codes, minlength=len(c.words))))

    unigrams = cut(coded.mapInArrow(words, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    top = unigrams.orderBy(F.desc("n"), "key").limit(core).toPandas()
    hashes, counts = top["key"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    size = len(hashes)
    order = np.argsort(hashes)
    known = hashes[order]

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(c: Coded) -> tuple[np.ndarray, np.ndarray]:
            at, there = _find(known, c.words)
            seq, inside = c.framed(np.where(there, order[at] if size else 0, size), size)
            left, right = seq[:-1][inside], seq[1:][inside]
            both = (left < size) & (right < size)
            return np.unique(left[both] * (size + 1) + right[both], return_counts=True)

        return _counted(batches, one)

    table = coded.mapInArrow(bigrams, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow().sort_by("key")
    key, n = table.column("key").to_numpy().astype(np.int64), table.column("n").to_numpy().astype(np.float64)
    of = exchange(key // (size + 1), key % (size + 1), n, size, classes) if size else np.empty(0, np.int64)
    k = int(of.max()) + 1 if size else 1
    cells = np.bincount(of[key // (size + 1)] * k + of[key % (size + 1)], n, k * k).reshape(k, k) if size else np.zeros((1, 1))
    own = (known, of[order], counts[order])
    shared = spark.sparkContext.broadcast((own, cells))
    slots = coded.mapInArrow(lambda b: _neighbours(b, shared.value[0][0], shared.value[0][1], k), "key long, slots binary, counts binary")
    rest = slots.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: _placed(b, shared.value[1]), "key long, cls int")
    # a word that is never next to one of the core goes to the class that the core's words are in most
    usual = int(np.argmax(np.bincount(of, counts, k))) if size else 0
    frequent = F.broadcast(spark.createDataFrame([(int(h), int(c)) for h, c in zip(hashes.view(np.int64), of, strict=True)], "key long, core int"))
    table = cut(unigrams.join(frequent, "key", "left").join(rest, "key", "left").select("key", F.coalesce("core", "cls", F.lit(usual)).alias("cls"), "n"))
    sizes = {r.cls: r.n for r in table.groupBy("cls").agg(F.sum("n").alias("n")).collect()}
    named = lookup(coded, table, own, k)

    def class_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 2) ** 2, np.int64)
        for batch in batches:
            for i, c in enumerate(_texts(batch)):
                seq, inside = c.framed(_unpack(batch.column("cls")[i].as_py(), np.int32), k + 1)
                total += np.bincount((seq[:-1] * (k + 2) + seq[1:])[inside], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["key", "n"])

    pairs = np.zeros((k + 2) ** 2)
    for r in named.mapInArrow(class_pairs, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect():
        pairs[r.key] = r.n
    return Model(table, own, np.array([sizes.get(c, 0) for c in range(k)], np.float64), int(table.count()), transitions(pairs.reshape(k + 2, k + 2))), named


def score(c: Coded, cls: np.ndarray, n: np.ndarray, size: np.ndarray, types: int, trans: np.ndarray) -> np.ndarray:
    """Log probability of each text, its end included. An unknown word's emission is that of one among all words and itself."""
    unknown = len(size)
    emit = np.where(cls < unknown, np.log(np.maximum(n, 1) / np.maximum(np.append(size, 1)[cls], 1)), -np.log(types + 1))
    seq, inside = c.framed(cls, unknown + 1)
    doc = np.repeat(np.arange(len(c.ids)), np.diff(c.ends) + 2)
    out = np.bincount(doc[:-1][inside], trans[seq[:-1][inside], seq[1:][inside]], len(c.ids)) if len(c.ids) else np.empty(0)
    return out + np.bincount(np.repeat(np.arange(len(c.ids)), np.diff(c.ends)), emit[c.codes] if len(c.codes) else np.empty(0), len(c.ids))


def perplexity(docs: DataFrame, model: Model | None = None, core: int = CORE, classes: int = CLASSES) -> DataFrame:
    """(doc_id, n_words, log_prob, perplexity) for every row, by a model of these same documents unless one is given.

    perplexity = exp(-log_prob / (n_words + 1)): the end of a text is predicted too. A null, empty or blank text has 0 words and
    the perplexity of an end at once. Repeated rows are counted and scored as often as they occur. A null doc_id stays null. Other
    columns are ignored; an empty table gives an empty result.
    """
    if model is None:
        model, named = fit(docs, core, classes)
    else:
        named = lookup(encode(docs), model.words, model.core, len(model.size))
    size, types, trans = model.size, model.types, model.trans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, c in enumerate(_texts(batch)):
                cls, n = _unpack(batch.column("cls")[i].as_py(), np.int32), _unpack(batch.column("n")[i].as_py(), np.int64)
                logp, words = score(c, cls, n, size, types, trans), np.diff(c.ends)
                yield pa.RecordBatch.from_arrays([pa.array(c.ids, mask=~c.known), pa.array(words), pa.array(np.round(logp, 4)), pa.array(np.round(np.exp(-logp / (words + 1)), 4))], ["doc_id", "n_words", "log_prob", "perplexity"])

    return named.mapInArrow(run, "doc_id long, n_words long, log_prob double, perplexity double")
