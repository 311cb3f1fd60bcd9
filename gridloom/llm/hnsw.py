"""Approximate nearest neighbours: one hierarchical navigable small-world graph a shard, shard results merged.

Vectors are dealt to a number of shards by a hash of their id. A shard's graph (Malkov and Yashunin, 2016) is kept as flat neighbour
arrays: per layer, an int32 matrix of `m` (layer 0: 2 m) links, -1 where there are fewer. Searches run for a block of queries in
lockstep: every step expands each query's best unexpanded candidate, so that distances are computed for thousands of links at a time.
The queries are the rows whose id is divisible by `every`. Every query asks every shard, a graph meeting blocks of
queries; the best k over all shards are the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .text import mix

M, EF_BUILD, EF_SEARCH, K, SHARD_ROWS, EVERY = 16, 64, 96, 10, 8192, 50


class Graph:
    """HNSW over the rows of `x` (float32) by squared Euclidean distance."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, m: int = M, ef: int = EF_BUILD):
        n = len(x)
        self.x, self.m, self.norm = np.ascontiguousarray(x, np.float32), m, (x.astype(np.float32) ** 2).sum(1)
        # a node's top layer, from a hash of its id: exponential with factor 1 / ln(m); layer 6 is expected from 16^6 rows on, far beyond a shard
        u = (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(11)).astype(np.float64) / 2**53
        level = np.minimum((-np.log(np.maximum(u, 1e-12)) / np.log(m)).astype(int), 6)
        order = np.lexsort((np.arange(n), -level))  # the upper layers come first, so that blocks can be linked at once
        self.order, self.x, self.norm, level = order, self.x[order], self.norm[order], level[order]
        tops = int(level[0]) + 1 if n else 0
        self.links = [np.full((int((level >= k).sum()), m if k else 2 * m), -1, np.int32) for k in range(tops)]
        done = 0
        while done < n:
            size = 1 if done < 1 else min(512, max(1, done // 2), n - done)
            self._insert(done, done + size, level, ef)
            done += size

    def _insert(self, a: int, b: int, level: np.ndarray, ef: int) -> None:
        q, new = self.x[a:b], np.arange(a, b)
        enter = np.zeros((b - a, 1), np.int64)
        for k in reversed(range(len(self.links))):
            here = np.flatnonzero(level[a:b] >= k)
            old = min(a, len(self.links[k]))
            if old:
                found, dist = self.search_layer(q, enter, k, ef if len(here) else 1, old)
            else:
                found, dist = np.full((b - a, 1), -1, np.int64), np.full((b - a, 1), np.inf, np.float32)
            if len(here):
                mates = new[here]
                inside = self._cross(q[here], mates)
                np.fill_diagonal(inside, np.inf)
                few = min(ef, len(mates))
                at = np.argpartition(inside, few - 1, 1)[:, :few]
                all_ids = np.concatenate((found[here], mates[at]), 1)
                all_d = np.concatenate((dist[here], np.take_along_axis(inside, at, 1)), 1)
                for i, node in enumerate(mates):
                    ok = np.isfinite(all_d[i]) & (all_ids[i] >= 0)
                    self._link(int(node), all_ids[i][ok], all_d[i][ok], k)
            if old:
                enter = found[:, :1]

    def _cross(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        return np.maximum((q**2).sum(1)[:, None] + self.norm[nodes][None, :] - 2 * q @ self.x[nodes].T, 0)

    def _pick(self, ids: np.ndarray, d: np.ndarray, most: int) -> np.ndarray:
        """The paper's heuristic: a candidate is linked unless it is nearer to one linked before; places left over go to the nearest."""
        order = np.lexsort((ids, d))
        ids, d = ids[order], d[order]
        if len(ids) <= most:
            return ids
        between = self._cross(self.x[ids], ids)
        taken: list[int] = []
        blocked = np.zeros(len(ids), bool)
        for i in range(len(ids)):
            if not blocked[i]:
                taken.append(i)
                if len(taken) == most:
                    break
                blocked |= between[i] < d
        if len(taken) < most:
            taken += [i for i in range(len(ids)) if i not in set(taken)][: most - len(taken)]
        return ids[taken]

    def _link(self, node: int, ids: np.ndarray, d: np.ndarray, k: int) -> None:
        links = self.links[k]
        ids, first = np.unique(ids, return_index=True)
        chosen = self._pick(ids, d[first], self.m)
        old = links[node][links[node] >= 0]
        mine = np.concatenate((chosen, old[~np.isin(old, chosen)]))[: links.shape[1]]
        links[node, : len(mine)] = mine
        for other in chosen:
            row = links[other]
            if node in row:
                continue
            used = int((row >= 0).sum())
            if used < len(row):
                row[used] = node
            else:
                all_ids = np.append(row, node).astype(np.int64)
                kept = self._pick(all_ids, self._cross(self.x[other : other + 1], all_ids)[0], len(row))
                row[:] = -1
                row[: len(kept)] = kept

    def search_layer(self, q: np.ndarray, enter: np.ndarray, k: int, ef: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The `ef` nearest found from the entries, best first: ids (-1 for none) and squared distances."""
        n, links = len(q), self.links[k]
        qn = (q**2).sum(1)
        rows = np.arange(n)
        seen = np.zeros((n, size), bool)
        width = enter.shape[1]
        ids, dist, done = np.full((n, ef), -1, np.int64), np.full((n, ef), np.inf, np.float32), np.ones((n, ef), bool)
        e = np.where(enter < size, enter, 0)
        ids[:, :width], done[:, :width] = e[:, :ef], False
        dist[:, :width] = np.maximum(qn[:, None] + self.norm[e] - 2 * np.einsum("nd,nwd->nw", q, self.x[e]), 0)[:, :ef]
        seen[rows[:, None], e] = True
        live = rows
        while len(live):
            open_d = np.where(done[live], np.inf, dist[live])
            best = open_d.argmin(1)
            go = np.isfinite(open_d[np.arange(len(live)), best])
            live, best = live[go], best[go]
            if not len(live):
                break
            node = ids[live, best]
            done[live, best] = True
            near = links[node].astype(np.int64)
            ok = (near >= 0) & (near < size)
            near = np.where(ok, near, 0)
            ok &= ~seen[live[:, None], near]
            r, c = np.nonzero(ok)
            if not len(r):
                continue
            to = near[r, c]
            seen[live[r], to] = True
            d = np.full(near.shape, np.inf, np.float32)
            d[r, c] = np.maximum(qn[live[r]] + self.norm[to] - 2 * np.einsum("ij,ij->i", q[live[r]], self.x[to]), 0)
            all_d = np.concatenate((dist[live], d), 1)
            all_i = np.concatenate((ids[live], np.where(np.isfinite(d), near, -1)), 1)
            all_o = np.concatenate((done[live], ~np.isfinite(d)), 1)
            at = np.argpartition(all_d, ef - 1, 1)[:, :ef]
            dist[live], ids[live], done[live] = (np.take_along_axis(v, at, 1) for v in (all_d, all_i, all_o))
        at = np.argsort(dist, 1, kind="stable")
        return np.take_along_axis(ids, at, 1), np.take_along_axis(dist, at, 1)

    def search(self, q: np.ndarray, k: int, ef: int = EF_SEARCH, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest of each query: places in the rows given at first (-1 for none), and squared distances."""
        out_i, out_d = np.full((len(q), k), -1, np.int64), np.full((len(q), k), np.inf, np.float32)
        for a in range(0, len(q), block):
            part = np.ascontiguousarray(q[a : a + block], np.float32)
            enter = np.zeros((len(part), 1), np.int64)
            for layer in reversed(range(1, len(self.links))):
                enter = self.search_layer(part, enter, layer, 1, len(self.links[layer]))[0][:, :1]
            ids, dist = self.search_layer(part, enter, 0, max(ef, k), len(self.x))
            w = min(k, ids.shape[1])
            out_i[a : a + block, :w] = np.where(ids[:, :w] >= 0, self.order[np.maximum(ids[:, :w], 0)], -1)
            out_d[a : a + block, :w] = dist[:, :w]
        return out_i, out_d


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.float32)


def nearest(vectors: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, query_block: int = 32_768, ef: int = EF_SEARCH, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, neighbour, rank, distance): for every row whose id is divisible by `every`, its k nearest others among all rows by Euclidean distance.

    The number of shards is the number of vectors over `shard_rows`, rounded up: a graph is held by one task, whatever the table's
    size. Ties: the smaller id first. Rows of null id, null or empty vector, or with a null or non-finite component, and rows whose
    number of dimensions is not the table's most frequent one (ties: the greater), take no part. Repeated rows of one id count
    once (the least vector). Other columns are ignored. Tables of one row or none give an empty result.
    """
    spark = vectors.sparkSession
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where("id is not null and v is not null and size(v) > 0 and forall(v, c -> c is not null and not isnan(c) and abs(c) < 3e38)")
    dims = clean.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1)
    rows = cut(clean.join(F.broadcast(dims), F.size(clean.v) == F.col("d")).groupBy("id").agg(F.min("v").alias("v")))
    total = rows.count()
    shards = -(-total // shard_rows)
    empty = spark.createDataFrame([], "vec_id long, neighbour long, rank int, distance double")
    if not shards:
        return empty
    queries = rows.where(F.col("id") % every == 0)
    blocks = max(1, -(-queries.count() // query_block))
    base = rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"))

    def build(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids = table.column("id").to_numpy()
        graph = Graph(_matrix(table.column("v")), ids)
        flat = [x for links in graph.links for x in (links.shape[0], links.shape[1])]
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "ids": [ids.astype(np.int64).tobytes()], "x": [graph.x.tobytes()], "order": [graph.order.astype(np.int64).tobytes()], "shape": [np.array(flat, np.int64).tobytes()], "links": [b"".join(x.tobytes() for x in graph.links)]})

    # a task a shard: AQE would put small shards together
    graphs = cut(base.repartition(shards, "shard").groupBy("shard").applyInArrow(build, "shard int, ids binary, x binary, order binary, shape binary, links binary"))
    # one task for each pair of a block of queries and a shard: a graph of 8,192 vectors travels once for each 32,768 queries
    asks = queries.select("id", "v", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    pairs = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def ask(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        none = {"id": pa.array([], pa.int64()), "neighbour": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())}
        if not left.num_rows or not right.num_rows:
            return pa.table(none)
        row = right.slice(0, 1).to_pylist()[0]
        graph = Graph.__new__(Graph)
        ids = np.frombuffer(row["ids"], np.int64)
        graph.x = np.frombuffer(row["x"], np.float32).reshape(len(ids), -1)
        graph.norm, graph.order, graph.links, at = (graph.x**2).sum(1), np.frombuffer(row["order"], np.int64), [], 0
        shape, links = np.frombuffer(row["shape"], np.int64), np.frombuffer(row["links"], np.int32)
        for n, m in zip(shape[::2], shape[1::2], strict=True):
            graph.links.append(links[at : at + n * m].reshape(n, m))
            at += n * m
        q = left.column("id").to_numpy()
        found, dist = graph.search(_matrix(left.column("v")), k + 1, ef)
        ok = (found >= 0) & (ids[np.maximum(found, 0)] != q[:, None])
        r, c = np.nonzero(ok)
        return pa.table({"id": q[r], "neighbour": ids[found[r, c]], "distance": np.sqrt(dist[r, c].astype(np.float64))})

    found = asks.groupBy("block", "shard").cogroup(pairs.groupBy("block", "shard")).applyInArrow(ask, "id long, neighbour long, distance double")
    best = Window.partitionBy("id").orderBy("distance", "neighbour")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(F.col("id").alias("vec_id"), "neighbour", F.col("rank").cast("int").alias("rank"), F.round("distance", 5).alias("distance"))
