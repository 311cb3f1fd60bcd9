"""Pairs of two tables of shapes by the cells that their boxes share, worked out in tiles.

A join on cells makes a row of every candidate, with both shapes in it: as many as the product of the tables. Here a shape is sent once for each cell and tile;
the candidates of a tile are indices into its arrays, a block at a time, and only pairs that hold leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut

#: Shapes of either side in a tile, about; boxes compared at a time; edges or vertices of pairs worked on at a time.
TILE, BLOCK, EDGES = 2048, 1 << 18, 1 << 17
BOX = ["x0", "y0", "x1", "y1"]
#: Cells whose numbers of tiles are broadcast at most.
FEW_CELLS = 200_000


class Side:
    """The shapes of one side of a tile: ids, boxes and, where there are rings, their vertices."""

    def __init__(self, t: pa.Table, id_: str) -> None:
        self.ids = t.column(id_).combine_chunks()
        self.x0, self.y0, self.x1, self.y1 = (t.column(c).to_numpy() for c in BOX)
        self.n = len(self.x0)
        if "ring" in t.column_names:
            ring = t.column("ring").combine_chunks()
            flat = ring.flatten()
            self.xy = np.stack([pc.struct_field(flat, [k]).to_numpy(zero_copy_only=False).astype(np.float64) for k in (0, 1)], 1)
            self.size = pc.fill_null(pc.list_value_length(ring), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if "k" in t.column_names:
            self.k = t.column("k").to_numpy()

    def sorted_by_id(self) -> np.ndarray:
        return pc.sort_indices(self.ids).to_numpy()


Run = Callable[[Side, Side, int, int], Iterator[dict]]


def tiled(a: DataFrame, b: DataFrame, cell: float, run: Run, schema: str) -> DataFrame:
    """The rows that `run(side a, side b, i, j)` yields, as arrays by column, for each tile of each cell (i, j) of side `cell`.

    `a` and `b` are (id, x0, y0, x1, y1) and alike further columns: ring, an array of struct<x, y>, and k, a number. Shapes with a missing box meet nothing. Cells that
    hold more than `TILE` shapes of a side are cut into tiles by a hash: each tile of the one side meets each of the other, so what a task holds doesn't grow with the tables.
    """
    def dealt(df: DataFrame) -> DataFrame:
        e = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
        return df.select("*", e("x0", "x1").alias("i")).select("*", e("y0", "y1").alias("j"))

    sides = dealt(a), dealt(b)
    n = [s.groupBy("i", "j").agg(F.ceil(F.count("*") / TILE).alias(f"n_{p}")) for s, p in zip(sides, "ab", strict=True)]
    cells = cut(n[0].join(n[1], ["i", "j"]))
    cells = F.broadcast(cells) if cells.count() <= FEW_CELLS else cells
    more = [c for c in a.columns if c not in ("id", *BOX)]

    def placed(df: DataFrame, own: str, other: str) -> DataFrame:
        tile = F.pmod(F.xxhash64("id", *BOX), F.col(f"n_{own}")).alias(f"t_{own}")
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n_{other}") - 1)).alias(f"t_{other}")
        null = F.lit(None).cast(dict((a if other == "a" else b).dtypes)["id"]).alias(f"{other}_id")
        return df.join(cells, ["i", "j"]).select("i", "j", tile, each, F.lit(own == "a").alias("left"), F.col("id").alias(f"{own}_id"), null, *BOX, *more).select("i", "j", "t_a", "t_b", "left", "a_id", "b_id", *BOX, *more)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        left = t.column("left")
        one, other = Side(t.filter(left), "a_id"), Side(t.filter(pc.invert(left)), "b_id")
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        del t, left
        if one.n and other.n:
            for out in run(one, other, i, j):
                yield pa.RecordBatch.from_pydict(out)

    keys = ["i", "j", "t_a", "t_b"]
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed(sides[0], "a", "b").unionByName(placed(sides[1], "b", "a")).repartition(parts, *keys).groupBy(*keys).applyInArrow(work, schema)


def pairs(a: Side, b: Side, some: np.ndarray | None = None, those: np.ndarray | None = None, strict: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices in a, indices in b) of shapes (of a's `some`, of b's `those`) whose boxes meet, in blocks; with `strict`, whose boxes overlap."""
    some = np.arange(a.n) if some is None else some
    those = np.arange(b.n) if those is None else those
    bx0, by0, bx1, by1 = b.x0[those], b.y0[those], b.x1[those], b.y1[those]
    step = max(1, BLOCK // max(1, len(those)))
    less = np.less if strict else np.less_equal
    for s in range(0, len(some), step):
        k = some[s : s + step]
        hit = less(a.x0[k, None], bx1)
        hit &= less(bx0, a.x1[k, None])
        hit &= less(a.y0[k, None], by1)
        hit &= less(by0, a.y1[k, None])
        m, n = np.nonzero(hit)
        if len(m):
            yield k[m], those[n]


def once(a: Side, b: Side, m: np.ndarray, n: np.ndarray, cell: float, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs that share several cells those whose greater lower left corner is in this one: each pair in one cell."""
    here = (np.floor(np.maximum(a.x0[m], b.x0[n]) / cell) == i) & (np.floor(np.maximum(a.y0[m], b.y0[n]) / cell) == j)
    return m[here], n[here]


class Rings:
    """The rings of a side, counter-clockwise, in arrays by the power of two that holds their vertices; a ring is filled up with its first vertex, which changes neither shape nor area."""

    def __init__(self, side: Side) -> None:
        start = np.concatenate([[0], np.cumsum(side.size)[:-1]]).astype(np.int64)
        self.kind = np.maximum(2, np.ceil(np.log2(np.maximum(side.size, 1)))).astype(np.int64)
        self.at, self.convex, self.of = np.zeros(side.n, np.int64), np.zeros(side.n, bool), {}
        for k in np.unique(self.kind).tolist():
            r = np.flatnonzero(self.kind == k)
            v = np.arange(1 << k)
            ring = side.xy[start[r, None] + np.where(v < side.size[r, None], v, 0)]
            turned = signed(ring) < 0
            ring[turned] = ring[turned, ::-1]
            self.at[r], self.of[k] = np.arange(len(r)), ring
            if k <= 5:
                for s in range(0, len(r), step := max(1, EDGES >> 2 * k)):
                    self.convex[r[s : s + step]] = (turns(ring[s : s + step], ring[s : s + step]) >= 0).all((1, 2)) & (signed(ring[s : s + step]) > 0)


def alike(a: Rings, b: Rings, m: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(places in the pairs, rings of a, rings of b, both convex): pairs whose rings have arrays of the same sizes, some at a time."""
    code = (a.kind[m] * 64 + b.kind[n]) * 2 + (a.convex[m] & b.convex[n])
    for c in np.unique(code).tolist():
        where = np.flatnonzero(code == c)
        p, q = c // 128, c // 2 % 64
        step = max(1, EDGES >> (p + q))
        for s in range(0, len(where), step):
            k = where[s : s + step]
            yield k, a.of[p][a.at[m[k]]], b.of[q][b.at[n[k]]], bool(c % 2)


def signed(r: np.ndarray) -> np.ndarray:
    """Signed areas of rings (rings, vertices, 2), counter-clockwise ones positive."""
    x, y = r[..., 0] - r[..., :1, 0], r[..., 1] - r[..., :1, 1]
    return (x * np.roll(y, -1, -1) - np.roll(x, -1, -1) * y).sum(-1) / 2


def turns(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """(pairs, edges of p, vertices of q): positive where a vertex lies left of an edge."""
    a = p[:, :, None]
    d = np.roll(p, -1, 1)[:, :, None] - a
    c = q[:, None]
    return d[..., 0] * (c[..., 1] - a[..., 1]) - d[..., 1] * (c[..., 0] - a[..., 0])


def inside(points: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Whether each point (pairs, 2) is in its ring (pairs, vertices, 2), by the even-odd rule."""
    x, y = points[:, :1], points[:, 1:]
    a0, a1 = ring[..., 0], ring[..., 1]
    b0, b1 = np.roll(a0, -1, 1), np.roll(a1, -1, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (b0 - a0) * (y - a1) / (b1 - a1) + a0
    return (((a1 > y) != (b1 > y)) & (x < at)).sum(1) % 2 == 1


def meet(p: np.ndarray, q: np.ndarray, convex: bool = False) -> np.ndarray:
    """Of each pair whether the rings share a point: an edge of one meets one of the other (touching counts), or one lies in the other.

    Convex rings share none where an edge of one has all of the other on its outer side.
    """
    t = turns(p, q)
    if convex:
        hit = ~(t < 0).all(2).any(1)
        hit[hit] = ~(turns(q[hit], p[hit]) < 0).all(2).any(1)
        return hit
    u = turns(q, p).swapaxes(1, 2)
    t1, t2, t3, t4 = np.sign(t), np.sign(np.roll(t, -1, 2)), np.sign(u), np.sign(np.roll(u, -1, 1))
    hit = ((t1 * t2 < 0) & (t3 * t4 < 0)).any((1, 2))
    rest = np.flatnonzero(~hit)
    p, q, t1, t2, t3, t4 = p[rest], q[rest], t1[rest], t2[rest], t3[rest], t4[rest]
    a, b, c, d = p[:, :, None], np.roll(p, -1, 1)[:, :, None], q[:, None], np.roll(q, -1, 1)[:, None]
    within = lambda o, u, v: (np.minimum(o, u) <= v).all(-1) & (v <= np.maximum(o, u)).all(-1)
    touch = ((t1 == 0) & within(a, b, c)) | ((t2 == 0) & within(a, b, d)) | ((t3 == 0) & within(c, d, a)) | ((t4 == 0) & within(c, d, b))
    hit[rest] = touch.any((1, 2)) | inside(p[:, 0], q) | inside(q[:, 0], p)
    return hit


def clipped(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of each pair of convex counter-clockwise rings the area in common: p is cut by each edge of q.

    What is outside an edge is one run of vertices, round the farthest one; the two points where the ring crosses the edge take its place, so a cut adds a vertex at most.
    """
    x, y = p[..., 0], p[..., 1]
    rows, gone = np.arange(len(p)), np.zeros(len(p), bool)
    for k in range(q.shape[1]):
        a = q[:, k, :, None]
        d = q[:, (k + 1) % q.shape[1], :, None] - a
        side = d[:, 0] * (y - a[:, 1]) - d[:, 1] * (x - a[:, 0])
        far = side.argmin(1)
        n = x.shape[1]
        turn = far[:, None] + np.arange(n)
        turn[turn >= n] -= n
        x, y, side = (np.take_along_axis(v, turn, 1) for v in (x, y, side))
        kept = side >= 0
        crossed = ~kept[:, 0]
        if not crossed.any():
            continue
        gone |= ~kept.any(1)
        first, last = kept.argmax(1), n - 1 - kept[:, ::-1].argmax(1)
        new = []
        before, after = np.maximum(first - 1, 0), np.where(last + 1 < n, last + 1, 0)
        for u, v in ((before, first), (last, after)):
            su, sv = side[rows, u], side[rows, v]
            t = np.where(crossed, su / np.where(su == sv, 1.0, su - sv), 0.0)
            new.append([w[rows, u] + (w[rows, v] - w[rows, u]) * t for w in (x, y)])
        j = np.arange(n + 1)
        head, tail = j < first[:, None], j > last[:, None]
        x, y = (np.where(head, new[0][i][:, None], np.where(tail, new[1][i][:, None], np.concatenate([w, w[:, -1:]], 1))) for i, w in enumerate((x, y)))
    x, y = x - x[:, :1], y - y[:, :1]
    area = (x * np.roll(y, -1, 1) - np.roll(x, -1, 1) * y).sum(1) / 2
    area[gone] = 0.0
    return np.abs(area)


def fans(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rings, triangles, 3, 2), counter-clockwise, and their signs: of each ring the triangles whose signed sum it is."""
    t = np.stack([np.broadcast_to(r[:, :1], r[:, 2:].shape), r[:, 1:-1], r[:, 2:]], 2)
    s = np.sign(signed(t))
    return np.where((s < 0)[..., None, None], t[:, :, ::-1], t), s


def shared(p: np.ndarray, q: np.ndarray, convex: bool = False) -> np.ndarray:
    """Of each pair of simple counter-clockwise rings the area in common; rings that aren't convex are taken as the signed sums of their fans."""
    if convex:
        area = np.zeros(len(p))
        real = (np.roll(p, -1, 1) != p).any(2)  # an edge of no length parts nothing
        some = np.flatnonzero(~((turns(p, q) <= 0).all(2) & real).any(1))
        area[some] = clipped(p[some], q[some])
        return area
    (t, s), (u, v) = fans(p), fans(q)
    m, i, j = np.nonzero((s[:, :, None] * v[:, None] != 0) & (t.min(2)[:, :, None] < u.max(2)[:, None]).all(-1) & (u.min(2)[:, None] < t.max(2)[:, :, None]).all(-1))
    return np.maximum(0.0, np.bincount(m, s[m, i] * v[m, j] * clipped(t[m, i], u[m, j]), len(p)))
