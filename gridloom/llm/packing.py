"""Lexical retrieval packing: windows of documents that a sharded BM25 inverted index of the whole table holds for neighbours.

The seeds are the documents whose doc_id is divisible by `every`, in a seeded random order. All documents lie in shards of `shard_docs`, each with
an inverted index of its own. Document frequencies, their number and the mean length are those of the whole table. A seed's query is the whole seed; every
seed asks every shard; its unused neighbours, best first (ties: the earlier place), fill its window; the last one is cut where the window ends. What no seed
took, the rest of such documents included, is laid end to end, in the seeded order, in windows of its own. Every document's every word lands in exactly one window.

The seeds' windows are those of a plain loop over the seeds. They are made in rounds: some of the next seeds are searched at once, and the driver then
goes through them in order. Lists reach SLACK windows beyond the room. Where earlier seeds of the round took so much of a list that it no longer fills the room,
the driver goes on only to see which other lists will be too short; these seeds are searched again, four times as far beyond the room, and it resumes at the first of them, whose list then suffices.

Every seed is scored against every unused document, so the search grows with seeds x documents. The driver holds a byte, and tasks get a bit, for each document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, shuffle_partitions
from .text import Chunk, lean, mix, pieces

SHARD_DOCS, WINDOW_WORDS, EVERY = 8192, 2048, 50
#: Seeds of a round; windows of words by which their lists exceed the room at first; share of the scores of a shard and group that a term must change to be multiplied densely.
SEEDS, SLACK, DENSE = 8192, 8, 0.006
#: Similar seeds that are scored together.
GROUP = 512
#: What the driver holds at once, about: words of a round's seeds, rows of lists. There are fewer seeds to a search where they are long, or neighbours short.
WORDS, ROWS = 5_000_000, 2_000_000
K1, B = 1.2, 0.75


def _numbers(column: pa.Array, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document: words, a hash of the words in order, and its distinct terms with their counts."""
    for batch in batches:
        for part in pieces(batch):
            c = Chunk(part.column("text"))
            content = np.zeros(part.num_rows, np.uint64)
            if len(has := np.flatnonzero(c.counts)):
                content[has] = np.add.reduceat(mix(c.hashes + np.arange(len(c.codes), dtype=np.uint64) - np.repeat(c.offsets[:-1], c.counts).astype(np.uint64)), c.offsets[:-1][has])
            # the distinct terms of all documents by one sort of (document, word)
            key = np.sort(c.doc * max(1, len(c.words)) + c.codes)
            first = np.flatnonzero(np.diff(key, prepend=-1))
            doc, word = np.divmod(key[first], max(1, len(c.words)))
            ends = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=part.num_rows))))
            terms, tfs = c.word_hashes[word] if len(word) else np.empty(0, np.uint64), np.diff(np.append(first, len(key))).astype(np.int32)
            cells = [pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x)]) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(c.counts.astype(np.int64)), pa.array(content.view(np.int64)), *cells], ["doc_id", "n", "content", "terms", "tfs"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for s in _shards(batches):
        yield pa.RecordBatch.from_arrays([pa.array(s["vocabulary"].view(np.int64)), pa.array(np.diff(s["ends"]))], ["term", "df"])


_KINDS = {"ids": np.int64, "null": np.uint8, "counts": np.int64, "vocabulary": np.uint64, "ends": np.int64, "docs": None, "tfs": None}  # None: the least unsigned kind that holds them
_SHARD = "part int, number int, size long, words long, seeds long, " + ", ".join(f"{k} binary" for k in _KINDS)


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max())))


def _index(shard_docs: int, every: int):
    """Inverted indexes of runs of `shard_docs` rows of the parts in a sorted partition: postings of vocabulary[t] are docs and tfs from ends[t] to ends[t + 1]."""

    def one(part: int, number: int, table: pa.Table) -> pa.RecordBatch:
        terms, tfs = _numbers(table.column("terms"), np.uint64), _numbers(table.column("tfs"), np.int32)
        doc, term = np.repeat(np.arange(len(terms), dtype=np.int32), [len(t) for t in terms]), np.concatenate(terms)
        order = np.argsort(term)
        term = term[order]
        first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
        counts = table.column("n").to_numpy()
        ids, null = table.column("doc_id").fill_null(0).to_numpy(), table.column("doc_id").is_null().to_numpy()
        blobs = [x.tobytes() for x in (ids, null.astype(np.uint8), counts, term[first], np.append(first, len(term)), _narrow(doc[order]), _narrow(np.concatenate(tfs)[order]))]
        numbers = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), *[pa.array([int(x)], pa.int64()) for x in (len(terms), counts.sum(), (~null & (ids % every == 0)).sum())]]
        return pa.RecordBatch.from_arrays([*numbers, *[pa.array([x], pa.binary()) for x in blobs]], names=["part", "number", "size", "words", "seeds", *_KINDS])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, number, part = 0, 0, None
        for batch in batches:
            parts = batch.column("part").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if int(parts[a]) != part:
                    if rows:
                        yield one(part, number, pa.Table.from_batches(held))
                    held, rows, number, part = [], 0, 0, int(parts[a])
                held.append(batch.slice(a, b - a))
                rows += b - a
                while rows >= shard_docs:
                    table = pa.Table.from_batches(held)
                    yield one(part, number, table.slice(0, shard_docs))
                    held, rows, number = table.slice(shard_docs).to_batches(), rows - shard_docs, number + 1
        if rows:
            yield one(part, number, pa.Table.from_batches(held))

    return build


def _shards(batches: Iterator[pa.RecordBatch], firsts: dict[tuple[int, int], int] | None = None) -> Iterator[dict[str, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            s = {k: np.frombuffer(batch.column(k)[i].as_buffer(), kind or np.uint8) for k, kind in _KINDS.items()}
            s |= {k: s[k].view(f"u{len(s[k]) // int(s['ends'][-1])}") for k, kind in _KINDS.items() if kind is None}
            if firsts is not None:
                s["places"] = firsts[batch.column("part")[i].as_py(), batch.column("number")[i].as_py()] + np.arange(len(s["counts"]))
            yield s


def _best(own: np.ndarray, counts: np.ndarray, limit: int, least: float, first: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Of the documents of positive score, rounded, that is at least `least`, best first, the least number that have `limit` words, or all; with their scores."""
    border = least
    while first < len(own):
        border = max(least, np.partition(own, len(own) - first)[len(own) - first])
        if border <= least or counts[own >= border].sum() >= limit:
            break
        border, first = least, first * 4
    free = np.flatnonzero(own >= border - 2e-6) if border > 0 else np.flatnonzero(own)  # those that are equal once rounded, too
    score = np.round(own[free], 6)
    order = np.argsort(-score, kind="stable")[: np.count_nonzero(score >= least if least > 0 else score > 0)]
    order = order[: int(np.searchsorted(np.cumsum(counts[free[order]]), limit)) + 1]
    return free[order], score[order]


def _search(shard: dict[str, np.ndarray], used: np.ndarray, seeds: np.ndarray, limit: np.ndarray, least: np.ndarray, ends: np.ndarray, terms: np.ndarray, asked: np.ndarray, weights: np.ndarray, mean: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(seed's position, places, counts, scores) of a shard: seed i asks with terms[asked[ends[i]:ends[i + 1]]] and their weights for documents of a score of at least least[i]."""
    alive = ~used[shard["places"]]
    n, at = int(alive.sum()), np.cumsum(alive) - 1
    if not n:
        return
    places, counts = shard["places"][alive], shard["counts"][alive]
    keep = alive[shard["docs"]]
    docs, tf = at[shard["docs"][keep]], shard["tfs"][keep]
    posts = np.concatenate(([0], np.cumsum(np.add.reduceat(keep.view(np.uint8), shard["ends"][:-1], dtype=np.int64))))
    tf = tf.astype(np.float64)
    value = (K1 * (1 - B + B * counts / mean))[docs]
    value += tf
    tf *= K1 + 1
    np.divide(tf, value, out=value)
    where = np.searchsorted(shard["vocabulary"], terms)
    where[where == len(shard["vocabulary"])] = 0
    begin = posts[where]
    size = np.where(shard["vocabulary"][where] == terms, posts[where + 1] - begin, 0)
    earlier = np.searchsorted(places, seeds, "right")
    for start in range(0, len(seeds), GROUP):
        stop = min(start + GROUP, len(seeds))
        mine, weight, cuts = asked[ends[start] : ends[stop]], weights[ends[start] : ends[stop]], ends[start : stop + 1] - ends[start]
        many = np.flatnonzero(np.bincount(mine, minlength=len(terms)) * size > max(8, DENSE * n * (stop - start)))
        column = np.full(len(terms), -1)
        column[many] = np.arange(len(many))
        table = np.zeros((len(many), n))
        for k, (a, b) in enumerate(zip(begin[many].tolist(), (begin + size)[many].tolist(), strict=True)):
            table[k, docs[a:b]] = value[a:b]
        column, asker = column[mine], np.repeat(np.arange(stop - start), np.diff(cuts))
        dense, few = np.flatnonzero(column >= 0), np.flatnonzero((column < 0) & (size[mine] > 0))
        query = np.zeros((stop - start, len(many)))
        query[asker[dense], column[dense]] = weight[dense]
        # of the terms that are added one posting at a time: postings, where they begin less those of the terms before
        s, weight, cuts = size[mine[few]], weight[few], np.searchsorted(few, cuts)
        before = np.concatenate(([0], np.cumsum(s)))
        shift, steps = begin[mine[few]] - before[:-1], np.arange(int(np.diff(before[cuts]).max()))
        for low in range(start, stop, 128):
            high = min(low + 128, stop)
            scores = query[low - start : high - start] @ table
            for i in range(low, high):
                a, b = cuts[i - start], cuts[i - start + 1]
                if total := int(before[b] - before[a]):
                    post = np.repeat(shift[a:b] + before[a], s[a:b])
                    post += steps[:total]
                    gain = value.take(post, mode="clip")
                    gain *= np.repeat(weight[a:b], s[a:b])
                    scores[i - low] += np.bincount(docs.take(post, mode="clip"), gain, n)
                scores[i - low, : earlier[i]] = 0
                if limit[i]:
                    got, score = _best(scores[i - low], counts, int(limit[i]), float(least[i]))
                    if len(got):
                        yield np.full(len(got), i), places[got], counts[got], score


def _part(chosen: np.ndarray, ends: np.ndarray, names: np.ndarray, asks: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """ends, names, asks and weights of the chosen seeds alone."""
    size = np.diff(ends)[chosen]
    to = np.concatenate(([0], np.cumsum(size)))
    at = np.repeat(ends[chosen] - to[:-1], size) + np.arange(int(to[-1]))
    here = np.zeros(len(names), bool)
    here[asks[at]] = True
    return to, names[here], (np.cumsum(here, dtype=np.int32) - 1)[asks[at]], weights[at]


def _alike(ends: np.ndarray, asks: np.ndarray, first: int = 24) -> np.ndarray:
    """An order of the seeds in which those that ask for the same of the most frequent terms stand together, as do those of a language."""
    common = np.full(int(asks.max()) + 1, -1)
    often = np.argsort(-np.bincount(asks), kind="stable")[:first]
    common[often] = np.arange(len(often))
    has = np.zeros((len(often), len(ends) - 1), bool)
    which = common[asks]
    has[which[which >= 0], np.repeat(np.arange(len(ends) - 1), np.diff(ends))[which >= 0]] = True
    return np.lexsort(has[::-1])


def _merge(lists: pa.Table, limit: np.ndarray) -> tuple[pa.Table, np.ndarray]:
    """Lists of shards made one for each seed, as far as its limit of words; the score that further documents need to be in it."""
    lists = lists.sort_by([("seed", "ascending"), ("score", "descending"), ("place", "ascending")])
    seeds, n = lists.column("seed").to_numpy(), lists.column("n").to_numpy()
    before = np.cumsum(n) - n
    first = np.flatnonzero(np.diff(seeds, prepend=-1))
    before -= np.repeat(before[first], np.diff(np.append(first, len(n))))
    kept = np.flatnonzero(before < limit[seeds])
    last = kept[np.flatnonzero(np.diff(seeds[kept], append=-1))]
    full = last[before[last] + n[last] >= limit[seeds[last]]]
    least = np.zeros(len(limit))
    least[seeds[full]] = lists.column("score").to_numpy()[full]
    return lists.take(pa.array(kept)), least


def pack_documents(docs: DataFrame, window: int = WINDOW_WORDS, shard_docs: int = SHARD_DOCS, every: int = EVERY, seed: int = 17) -> DataFrame:
    """(window, position, doc_id, start_word, end_word, score): the pieces of every window, in order.

    Windows of seeds are named s..., the others r...; a piece that is no neighbour (a seed, or what no seed took) has the score 0. A document longer than a window first fills whole windows; what remains is a seed. Texts without a word (null, empty, blank) have no piece, but count
    as documents. Rows of null doc_id are packed like others, placed by a hash of their words, carry null and are no seeds. Repeated rows are packed
    as documents of their own. Other columns are ignored; an empty table gives an empty result. `shard_docs` changes no window of a seed; windows of the rest end with a shard.
    """
    spark = docs.sparkSession
    base = f"{shared_folder(spark)}/packing-{uuid.uuid4().hex}"
    sketched = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_sketch), "doc_id long, n long, content long, terms binary, tfs binary")
    turn = F.when(F.col("doc_id").isNull(), F.xxhash64("content", F.lit(seed))).otherwise(F.xxhash64("doc_id", F.lit(seed)))
    later = F.coalesce(F.col("doc_id") % every != 0, F.lit(True))
    # parts in the order of places: the seeds', then the others', each a range of turns
    others = shuffle_partitions(spark)
    first = -(-others // every)
    size = F.when(F.col("later"), others).otherwise(first)
    part = F.when(F.col("later"), first).otherwise(0) + F.least(size - 1, F.floor((F.col("turn").cast("double") / 2.0**64 + 0.5) * size)).cast("int")
    placed = sketched.where("n > 0").withColumns({"later": later, "turn": turn}).withColumn("part", part)
    ordered = placed.repartition(others + first, "part").sortWithinPartitions("part", "turn", "doc_id", "n", "content").select("part", "doc_id", "n", "terms", "tfs")
    ordered.mapInArrow(lean(_index(shard_docs, every)), _SHARD).write.option("compression", "zstd").parquet(f"{base}/shards")
    shards = spark.read.schema(_SHARD).parquet(f"{base}/shards")
    shards.mapInArrow(lean(_frequencies), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).write.parquet(f"{base}/df")
    frequencies = spark.read.schema("term long, df long").parquet(f"{base}/df")
    # places run on from shard to shard and from partition to partition
    sizes = sorted(map(tuple, shards.select("part", "number", "size", "words", "seeds").collect()))
    starts = np.concatenate(([0], np.cumsum([x[2] for x in sizes]))).astype(np.int64)
    firsts = {x[:2]: int(a) for x, a in zip(sizes, starts, strict=False)}
    count, total = int(starts[-1]), docs.count()
    mean = max(1.0, sum(x[3] for x in sizes) / max(1, total))
    used, kind = np.zeros(count, bool), "window string, position int, place long, start_word int, end_word int, score double"
    spark.createDataFrame([], kind).write.parquet(f"{base}/out")
    seeds, cut_at = sum(x[4] for x in sizes), {}  # the seeds have the first places

    def look(shards: DataFrame, used: np.ndarray, batch: np.ndarray, limit: np.ndarray, ends: np.ndarray, names: np.ndarray, asks: np.ndarray, weights: np.ndarray, keys: np.ndarray) -> dict[int, tuple]:
        """For each of `keys`, the unused neighbours of the seed of the same position in `batch`, best first: places, counts, scores, and whether these are all."""
        query = spark.sparkContext.broadcast((np.packbits(used), batch, limit, ends, names, asks, weights))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits, batch, limit, *asked = query.value
            used, held, least = np.unpackbits(bits, count=count).astype(bool), [], np.zeros(len(batch))
            for s in _shards(batches, firsts):
                if got := list(_search(s, used, batch, limit, least, *asked, mean)):
                    held.append(pa.table([np.concatenate(c) for c in zip(*got, strict=True)], names=["seed", "place", "n", "score"]))
                    lists, least = _merge(pa.concat_tables(held), limit)
                    held = [lists]
            for lists in held:
                yield from lists.to_batches()

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if held := list(batches):
                yield from _merge(pa.Table.from_batches(held), query.value[2])[0].to_batches()

        shape = "seed long, place long, n long, score double"
        found = shards.mapInArrow(lean(search), shape).repartition("seed").mapInArrow(lean(merge), shape).toArrow().sort_by([("seed", "ascending"), ("score", "descending"), ("place", "ascending")])
        query.destroy()
        owner, *cells = (found.column(c).to_numpy() for c in ("seed", "place", "n", "score"))
        first = np.searchsorted(owner, np.arange(len(batch) + 1)).tolist()
        out = {}
        for i, key in enumerate(keys.tolist()):
            place, words, score = (c[first[i] : first[i + 1]] for c in cells)
            out[key] = place, words, score, int(words.sum()) < limit[i]
        return out

    own = sum(x[3] for x in sizes if x[4]) / max(1, sum(x[2] for x in sizes if x[4]))  # words of a seed
    round_ = max(1, int(min(SEEDS, WORDS / max(1, own), ROWS * mean / (window * (1 + SLACK)))))
    while len(batch := np.flatnonzero(~used[:seeds])[:round_]):
        sent = spark.sparkContext.broadcast(batch)

        def ask(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            batch = sent.value
            for s in _shards(batches, firsts):
                if not len(mine := np.flatnonzero(np.isin(s["places"], batch))):
                    continue
                row = np.full(len(s["places"]), -1)
                row[mine] = np.arange(len(mine))
                keep = np.flatnonzero(row[s["docs"]] >= 0)
                order = keep[np.argsort(row[s["docs"][keep]], kind="stable")]
                term = np.repeat(s["vocabulary"], np.diff(s["ends"]))[order]
                size = np.concatenate(([0], np.cumsum(np.bincount(row[s["docs"][keep]], minlength=len(mine)))))
                cells = [pa.array([x[a:b].tobytes() for a, b in zip(size[:-1], size[1:], strict=True)], pa.binary()) for x in (term, s["tfs"][order].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(s["places"][mine]), pa.array(s["counts"][mine]), *cells], ["place", "n", "terms", "tfs"])

        low, high = (sizes[int(np.searchsorted(starts, int(x), "right")) - 1][0] for x in (batch[0], batch[-1]))
        open_ = shards.where(F.col("part") >= low)
        asked = open_.where(F.col("part") <= high).mapInArrow(lean(ask), "place long, n long, terms binary, tfs binary").toArrow().sort_by("place")
        n, terms, tfs = asked.column("n").to_numpy(), _numbers(asked.column("terms"), np.uint64), _numbers(asked.column("tfs"), np.int32)
        bounds, flat = np.concatenate(([0], np.cumsum([len(t) for t in terms]))), np.concatenate(terms)
        names, asks = np.unique(flat, return_inverse=True)
        wanted = spark.sparkContext.broadcast(names)

        def known(batches: Iterator[pa.RecordBatch], wanted=wanted) -> Iterator[pa.RecordBatch]:
            for b in batches:
                term = b.column("term").to_numpy().view(np.uint64)
                yield b.filter(pa.array(wanted.value[np.minimum(np.searchsorted(wanted.value, term), len(wanted.value) - 1)] == term))

        found = frequencies.mapInArrow(known, "term long, df long").toArrow()
        term, df = found.column("term").to_numpy().view(np.uint64), found.column("df").to_numpy()
        df = df[np.argsort(term)][asks]  # every name is found
        weights = np.log1p((total - df + 0.5) / (df + 0.5)) * np.concatenate(tfs)
        asks, room = asks.astype(np.int32), np.where(n % window > 0, window - n % window, 0)
        del asked, terms, tfs, flat, found, term, df
        sent.destroy()
        wanted.destroy()
        lists, reach, rows, cuts, start = {}, np.full(len(batch), SLACK * window), [], [], 0
        short = _alike(bounds, asks)
        while len(short):
            lists |= look(open_, used, batch[short], np.where(room[short] > 0, room[short] + reach[short], 0), *_part(short, bounds, names, asks, weights), short)
            short, safe = [], None
            for i in range(start, len(batch)):
                if used[s := batch[i]]:
                    continue
                place, words, score, whole = lists[i] if room[i] else (*[np.empty(0, int)] * 3, True)
                free = ~used[place]
                if not whole and int(words[free].sum()) < room[i]:
                    if safe is None:  # from here on it's only tried which other lists are too short
                        safe, start = (used.copy(), len(rows), len(cuts)), i
                    short.append(i)
                used[s] = True
                full = int(n[i]) // window
                rows += [(f"s{s}-{k}", 0, int(s), k * window, (k + 1) * window, 0.0) for k in range(full)]
                if not room[i]:
                    continue
                rows.append((f"s{s}-{full}", 0, int(s), full * window, int(n[i]), 0.0))
                space, position = int(room[i]), 1
                for p, c, x in zip(place[free].tolist(), words[free].tolist(), score[free].tolist(), strict=True):
                    rows.append((f"s{s}-{full}", position, p, 0, min(c, space), x))
                    used[p] = True
                    if c >= space:
                        cuts += [(p, space)] if c > space else []
                        break
                    space, position = space - c, position + 1
            if safe:
                used, rows, cuts, short = safe[0], rows[: safe[1]], cuts[: safe[2]], np.array(short)
                short = short[: max(1, int(np.searchsorted(np.cumsum((room + 4 * reach)[short]), ROWS * mean)))]
                reach[short] *= 4
        cut_at |= dict(cuts)
        spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64()), strict=True)], names=["window", "position", "place", "start_word", "end_word", "score"])).write.mode("append").parquet(f"{base}/out")
    used[list(cut_at)] = False
    places = np.array(sorted(cut_at), np.int64)
    sent = spark.sparkContext.broadcast((np.packbits(used), places, np.array([cut_at[p] for p in places.tolist()], np.int64)))

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What no seed took of the documents of each shard, end to end."""
        bits, cut_places, cuts = sent.value
        used = np.unpackbits(bits, count=count).astype(bool)
        for s in _shards(batches, firsts):
            free = np.flatnonzero(~used[s["places"]])
            if not len(free):
                continue
            done = np.zeros(len(s["places"]), np.int64)
            mine = slice(*np.searchsorted(cut_places, [s["places"][0], s["places"][-1] + 1]))
            done[cut_places[mine] - s["places"][0]] = cuts[mine]
            size, done = (s["counts"] - done)[free], done[free]
            stop = np.cumsum(size)
            start = stop - size
            # a document's pieces lie between its ends and the windows' borders among its words
            pieces = (stop - 1) // window - start // window + 1
            own = np.repeat(np.arange(len(free)), pieces)
            nth = np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            w = start[own] // window + nth
            a, b = np.maximum(start[own], w * window) - start[own], np.minimum(stop[own], (w + 1) * window) - start[own]
            edge = np.flatnonzero(np.diff(w, prepend=-1))
            position = np.arange(len(w)) - np.repeat(edge, np.diff(np.append(edge, len(w))))
            ids, none = s["ids"][free][own], s["null"][free][own] > 0
            yield pa.RecordBatch.from_arrays([pa.array([f"r{s['places'][0]}-{x}" for x in w]), pa.array(position, pa.int32()), pa.array(ids, mask=none), pa.array(a + done[own], pa.int32()), pa.array(b + done[own], pa.int32()), pa.array(np.zeros(len(w)))], ["window", "position", "doc_id", "start_word", "end_word", "score"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _shards(batches, firsts):
            yield pa.RecordBatch.from_arrays([pa.array(s["places"]), pa.array(s["ids"], mask=s["null"] > 0)], ["place", "doc_id"])

    out = spark.read.schema(kind).parquet(f"{base}/out")
    taken = out.join(shards.mapInArrow(named, "place long, doc_id long"), "place").select("window", "position", "doc_id", "start_word", "end_word", "score")
    return taken.unionByName(shards.mapInArrow(lean(lay), "window string, position int, doc_id long, start_word int, end_word int, score double"))
