"""N-gram Jaccard join by MinHash banding.

1. Every document's set of word n-grams is hashed; documents of equal sets form a class, so exact copies cost nothing further.
2. Each class has a MinHash signature of bands * rows values; bands and rows are chosen to give the target recall at the
   threshold. Classes are shuffled on band hashes. All pairs of a bucket are candidates: a large bucket is cut into tiles, and every pair of
   tiles is a group of its own, so no partner is capped and no task holds a bucket.
3. Candidates are linked where the signatures agree in the threshold less `SIGMAS` standard errors, as all but .4 % of the pairs at the threshold, and
   more above it, do; the bands are chosen with that loss in view. A bucket gives a spanning forest of its links, not its pairs.
4. Linked classes form components. The full n-gram sets of a component are brought together and all its pairs verified exactly, in tiles again.
   As every linked pair lies in one component, whether a bucket's forest names it or not, no more is lost than by 2 and 3.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.graph import union

from .common import components, cut, small
from .text import Chunk, lean, lean_groups, mix, ngrams, pieces

N, THRESHOLD, RECALL, SIGMAS = 3, 0.5, 0.98, 2.7
#: Classes of a component, and of a bucket, that one side of a tile holds.
TILE, BUCKET = 512, 4096


def choose_bands(threshold: float, recall: float, most: int = 96) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, for which `most` values give a pair at the threshold the
    probability 1 - (1 - threshold^rows)^bands >= recall; one row with as many bands as it takes where none do.

    A bucket of N unrelated classes of Jaccard index j draws N * j^rows of them: for tables far beyond a billion documents, a greater `most` buys rows.
    """
    best = (1, 1)
    for rows in range(1, 17):
        share = threshold**rows
        bands = 1 if share >= 1 else max(1, int(np.ceil(np.log(1 - recall) / np.log1p(-share))))
        if bands * rows <= most or rows == 1:
            best = (bands, rows)
    return best


def signatures(grams: np.ndarray, ends: np.ndarray, bands: int, rows: int, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (documents, bands), and a byte of each signature value, of documents with at least one n-gram."""
    rng = np.random.default_rng(seed)
    mult = rng.integers(1, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    add = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)
    low, high = (grams & np.uint64(0xFFFFFFFF)).astype(np.uint32), (grams >> np.uint64(32)).astype(np.uint32)
    out, short = np.zeros((len(ends) - 1, bands), np.uint64), np.zeros((len(ends) - 1, bands * rows), np.uint8)
    work = np.empty_like(low)
    for b in range(bands):
        for r in range(rows):
            k = b * rows + r
            np.multiply(low, mult[k], out=work)
            work ^= high + add[k]
            work *= np.uint32(0x9E3779B1)
            least = np.minimum.reduceat(work, ends[:-1])
            out[:, b] = mix(out[:, b] + least + np.uint64(0x632BE59BD9B4E019 + b))
            short[:, k] = mix(least.astype(np.uint64)) & np.uint64(0xFF)
    return out, short


def _sets(chunk: Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each document, and offsets."""
    grams, ends = ngrams(chunk.hashes, chunk.offsets, n)
    if not len(grams):
        return grams, ends
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    order = np.lexsort((grams, doc))
    g = grams[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[new], np.concatenate(([0], np.cumsum(np.bincount(doc[new], minlength=len(ends) - 1))))


def _verify(sides: list[tuple[list[int], list[np.ndarray]]], threshold: float) -> tuple[list[int], list[int], list[float]]:
    """Pairs of a tile with a Jaccard index of at least the threshold; one side: pairs inside it, two: pairs across."""
    ids = [i for s in sides for i in s[0]]
    sets = [x for s in sides for x in s[1]]
    first = len(sides[0][0])
    size = np.array([len(x) for x in sets], np.int64)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1  # an n-gram of one document is in no intersection
    _, column = np.unique(column[shared], return_inverse=True)
    owner = owner[shared]
    both = np.zeros((len(sets), len(sets)), np.float32)
    step, total = 8192, int(column.max()) + 1 if len(column) else 0
    for at in range(0, total, step):
        a, b = np.searchsorted(column, [at, at + step])
        slab = np.zeros((len(sets), step), np.float32)
        slab[owner[a:b], column[a:b] - at] = 1
        both += slab @ slab.T
    jaccard = both / (size[:, None] + size[None, :] - both)
    x, y = np.nonzero(np.triu(jaccard >= threshold - 1e-7, 1))
    if len(sides) == 2:
        across = (x < first) & (y >= first)
        x, y = x[across], y[across]
    i, j = np.array(ids)[x], np.array(ids)[y]
    exact = both[x, y].astype(np.float64) / (size[x] + size[y] - both[x, y])
    return np.minimum(i, j).tolist(), np.maximum(i, j).tolist(), exact.tolist()


def _forest(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of a spanning forest of every group's agreeing pairs. Batches (h, t1, t2, node, short) come sorted by group; a group may run over batches."""

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (x == y).mean(-1) >= least

    def edges(group: np.ndarray, node: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
        size = np.diff(np.append(first, len(group)))
        found = []
        few = np.repeat(size <= 16, size)
        for d in range(1, 16):  # small groups: all pairs, by distance
            i = np.flatnonzero(few[:-d] & (group[d:] == group[:-d])) if len(group) > d else []
            if len(i):
                i = i[near(sig[i], sig[i + d])]
                found.append((node[i], node[i + d]))
        for a, n in zip(first[size > 16], size[size > 16], strict=True):  # large ones: breadth first, each member meets those not yet reached
            own, names = sig[a : a + n], node[a : a + n]
            left, queue = np.arange(1, n), [0]
            while len(left):
                if not queue:
                    queue.append(int(left[0]))
                    left = left[1:]
                u = queue.pop()
                hit = near(own[left], own[u])
                if hit.any():
                    queue.extend(left[hit].tolist())
                    found.append((np.full(int(hit.sum()), names[u]), names[left[hit]]))
                    left = left[~hit]
        x, y = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (node[:0], node[:0])
        x, y = np.minimum(x, y), np.maximum(x, y)
        pairs = np.unique(np.stack((x, y), 1)[x != y], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        keys = [batch.column(c).to_numpy() for c in ("h", "t1", "t2")]
        last = np.logical_or.reduce([k != k[-1] for k in keys])
        if not last.any():
            continue  # one group so far, which may go on
        end = int(np.flatnonzero(last)[-1]) + 1
        held[-1] = batch.slice(0, end)
        yield from _groups(held, edges)
        held = [batch.slice(end)]
    if held:
        yield from _groups(held, edges)


def _groups(held: list[pa.RecordBatch], edges) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held)
    keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("h", "t1", "t2")])
    group = np.cumsum((np.diff(keys, axis=1, prepend=keys[:, :1]) != 0).any(0))
    sig = np.frombuffer(b"".join(table.column("short").to_pylist()), np.uint8).reshape(table.num_rows, -1)
    yield edges(group, table.column("node").to_numpy(), sig)


def _sketched(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, name, node, bands, short): a row for each document with an n-gram; name is a digest of its set, node a hash of that."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for part in pieces(batch):
                grams, ends = _sets(Chunk(part.column("text")), n)
                has = np.flatnonzero(np.diff(ends))
                if not len(has):
                    continue
                keys, short = signatures(grams, np.append(ends[has], ends[-1]), bands, rows)
                names = [xxhash.xxh3_128_digest(grams[ends[i] : ends[i + 1]].tobytes()) for i in has]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(has)), pa.array(names, pa.binary()), flat, pa.array([x.tobytes() for x in short], pa.binary())], ["doc_id", "name", "bands", "short"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    return cut(own.mapInArrow(lean(sketch), "doc_id long, name binary, bands array<long>, short binary").withColumn("node", F.xxhash64("name")))


class Join:
    """The join of a table, in the parts that its callers put together.

    members (doc_id, name, node); classes (name, node, rep); verified (x, y, ...) of the nodes of classes.
    """

    def __init__(self, docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, tile: int = TILE, bucket: int = BUCKET):
        self.docs, self.n, self.threshold, self.tile = docs, n, threshold, tile
        bands, rows = choose_bands(threshold, recall + 0.0035)
        sketched = _sketched(docs, n, bands, rows)
        self.members = sketched.select("doc_id", "name", "node")
        classes = cut(sketched.groupBy("name", "node").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("short").alias("short")))
        self.classes = classes.select("name", "node", "rep")
        hashes = classes.select("node", F.explode("bands").alias("h"))
        shared = hashes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
        placed = hashes.join(shared, "h").withColumn("t", F.ceil(F.col("n") / bucket).cast("int")).withColumn("mine", F.pmod(F.xxhash64("node", "h"), F.col("t")).cast("int"))
        # members of a bucket of t tiles are in t groups, one for each pair of their own tile with another, and with itself
        grouped = placed.select("h", "node", "mine", F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("other")).select("h", F.least("mine", "other").alias("t1"), F.greatest("mine", "other").alias("t2"), "node")
        least = threshold - SIGMAS * float(np.sqrt(threshold * (1 - threshold) / (bands * rows)))
        signed = grouped.join(classes.select("node", "short"), "node").select("h", "t1", "t2", "node", "short").repartition("h", "t1", "t2").sortWithinPartitions("h", "t1", "t2", "node")
        self.linked = components(signed.mapInArrow(lean(lambda batches: _forest(batches, least)), "a long, b long"))

    def _tiles(self, kind: str, result) -> DataFrame:
        """`result` of every tile of every component: of (names, x, y, jaccard), x and y places in names, the pairs that hold."""
        n, threshold, tile = self.n, self.threshold, self.tile
        comps = cut(self.linked.join(self.classes, "node"))
        sizes = comps.groupBy("component").agg(F.count("*").alias("size"))
        tiles = comps.join(sizes, "component").withColumn("tiles", F.ceil(F.col("size") / tile).cast("int")).withColumn("mine", F.pmod(F.xxhash64("name"), F.col("tiles")).cast("int"))
        places = cut(tiles.select(F.col("rep").alias("p_doc"), F.col("name").alias("p_name"), "node", "component", "tiles", "mine"))

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import xxhash

            for batch in batches:
                for part in pieces(batch):
                    grams, ends = _sets(Chunk(part.column("text")), n)
                    rows = []
                    for i, (name, node, comp, tiles, mine) in enumerate(zip(*(part.column(c).to_pylist() for c in ("p_name", "node", "component", "tiles", "mine")), strict=True)):
                        blob = grams[ends[i] : ends[i + 1]].tobytes()
                        if xxhash.xxh3_128_digest(blob) == name:
                            rows += [(comp, min(mine, t), max(mine, t), mine, node, blob) for t in range(tiles)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["component", "t1", "t2", "mine", "node", "grams"])

        def verify(key: tuple, table: pa.Table) -> pa.Table:
            t1, t2 = key[1].as_py(), key[2].as_py()
            sides: dict[int, dict[int, np.ndarray]] = {t1: {}, t2: {}}
            for mine, node, grams in zip(*(table.column(c).to_pylist() for c in ("mine", "node", "grams")), strict=True):
                sides[mine][node] = np.frombuffer(grams, np.uint64)
            x, y, j = _verify([(list(s), list(s.values())) for s in sides.values()], threshold) if all(sides.values()) else ([], [], [])
            return result(np.array(x, np.int64), np.array(y, np.int64), np.array(j, np.float64))

        own = self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        sets = own.join(small(places), own.doc_id == places.p_doc).select("text", "p_name", "node", "component", "tiles", "mine").mapInArrow(lean(fill), "component long, t1 int, t2 int, mine int, node long, grams binary")
        return cut(sets.groupBy("component", "t1", "t2").applyInArrow(lean_groups(verify), kind))

    def pairs(self) -> DataFrame:
        """(x, y, jaccard): a row for each similar pair of classes."""
        return self._tiles("x long, y long, jaccard double", lambda x, y, j: pa.table({"x": x, "y": y, "jaccard": j}))

    def links(self) -> tuple[DataFrame, DataFrame]:
        """((node, links), (node, component)): the number of classes similar to a class, and the group that they connect. A tile gives a row for each of its classes, not for each pair."""

        def sums(x: np.ndarray, y: np.ndarray, j: np.ndarray) -> pa.Table:
            nodes, roots = union(x, y)
            return pa.table({"node": nodes, "root": roots, "links": np.bincount(np.searchsorted(nodes, np.concatenate((x, y))), minlength=len(nodes)).astype(np.int64)})

        found = self._tiles("node long, root long, links long", sums)
        return found.groupBy("node").agg(F.sum("links").alias("links")), components(found, "node", "root")


def jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, tile: int = TILE, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, class_id, group_id, n_copies, n_links): a row for each document that has a partner of Jaccard index >= threshold.

    class_id is the least doc_id with the same set of n-grams, n_copies the number of documents of that class, n_links the number of other classes
    that are similar to it, group_id the least doc_id of all that such links connect. So a document has n_copies - 1 partners of equal
    n-grams, and those of n_links other classes, each counted; `similar_pairs` names them.

    A text of fewer than `n` words has one n-gram, all its words; null, empty and blank texts have none and no partner. Rows of null doc_id
    are left out. Repeated rows count once (a document is no copy of itself); a doc_id that comes with several texts has a row for each that has a
    partner. Other columns are ignored. An empty table gives an empty result.
    """
    join = Join(docs, n, threshold, recall, tile, bucket)
    links, groups = join.links()
    copies = join.members.distinct().groupBy("node").agg(F.count("*").alias("n_copies"))
    named = join.classes.join(copies, "node").join(links, "node", "left").join(groups, "node", "left").where("n_copies > 1 or links > 0")
    named = cut(named.select("node", F.col("rep").alias("class_id"), F.coalesce("component", "node").alias("component"), "n_copies", F.coalesce("links", F.lit(0)).alias("n_links")))
    least = named.groupBy("component").agg(F.min("class_id").alias("group_id"))
    return join.members.distinct().join(named.join(least, "component"), "node").select("doc_id", "class_id", "group_id", "n_copies", "n_links")


def similar_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, tile: int = TILE, bucket: int = BUCKET) -> DataFrame:
    """(class_a, class_b, jaccard): a row for each pair of classes that `jaccard_join` counts as a link, by their class_id (the lesser first).

    Its rows are all pairs of different texts: in a group of similar texts, they grow with its square. Awkward rows as in `jaccard_join`.
    """
    join = Join(docs, n, threshold, recall, tile, bucket)
    a, b = join.classes.select(F.col("node").alias("x"), F.col("rep").alias("i")), join.classes.select(F.col("node").alias("y"), F.col("rep").alias("j"))
    return join.pairs().join(a, "x").join(b, "y").select(F.least("i", "j").alias("class_a"), F.greatest("i", "j").alias("class_b"), "jaccard")


def drop_near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """`docs` with one document, the least doc_id, of each group of documents that the join connects.

    Repeated rows of one doc_id are copies too: one row stays. Rows of null doc_id, and texts without a word, stay as they are. An empty table stays
    empty. Columns of any name pass through.
    """
    join = Join(docs, n, threshold, recall)
    groups = join.links()[1]
    leader = join.classes.join(groups, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    keepers = leader.groupBy("component").agg(F.min("rep").alias("keeper"))
    kept = leader.join(keepers, "component").select("node", "keeper")
    losers = cut(join.members.join(kept, "node").where("doc_id != keeper").select(F.col("doc_id").alias("__gl_id")).distinct())
    rest = docs.join(small(losers), docs["doc_id"] == losers["__gl_id"], "left_anti")
    twice = cut(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("__gl_id")).count().where("count > 1").select("__gl_id"))
    if not twice.limit(1).count():
        return rest
    again = small(twice)
    return rest.join(again, rest["doc_id"] == twice["__gl_id"], "left_anti").unionByName(rest.join(again, rest["doc_id"] == twice["__gl_id"], "left_semi").dropDuplicates(["doc_id"]))
