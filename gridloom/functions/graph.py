"""Connected components of any graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

#: Edges that one task contracts at a time, and up to which a graph is finished by one task: 16 bytes each.
EDGES = 2_000_000


def union(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node of each one's component) of the edges x - y: roots hook on to lesser roots, then all pointers are halved until flat."""
    nodes, at = np.unique(np.concatenate((x, y)), return_inverse=True)
    a, b = at[: len(x)], at[len(x) :]
    up = np.arange(len(nodes))
    while True:
        ra, rb = up[a], up[b]
        open_ = ra != rb
        if not open_.any():
            return nodes, nodes[up]
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(up, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up, up[up]):
            up = up[up]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars (node, least node reached), a bounded number of edges at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0

    def flush() -> pa.RecordBatch:
        nodes, roots = union(*(np.concatenate(c) for c in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["x", "y"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        rows += batch.num_rows
        if rows > EDGES:
            yield flush()
            held, rows = [], 0
    if rows:
        yield flush()


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("x", "y")), F.sum(F.shiftright(F.xxhash64("y", "x"), 24))).first())


def connected(edges: DataFrame, a: str = "a", b: str = "b", limit: int = EDGES) -> DataFrame:
    """(node, component) of the undirected graph of `edges` over integers; a component is named by its least node.

    Every task first contracts its own edges to stars. If no more than `limit` edges are left, one task finishes them; else large-star and
    small-star rounds (Kiveris et al., 2014) alternate until they change nothing: no node's neighbours are ever gathered in a
    task. Both ways give the same table. Null ends make no edge; loops and repeated edges don't matter. Lineage is cut each round.
    """
    e = edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).where("x is not null and y is not null")
    stars = cut(e.mapInArrow(_contract, "x long, y long"))
    if stars.count() <= limit:
        return cut(stars.coalesce(1).mapInArrow(_contract, "x long, y long").select(F.col("x").alias("node"), F.col("y").alias("component")))
    nodes = stars.select(F.col("x").alias("node"))
    now = stars.where("x != y").distinct()
    seen = None
    while True:
        # large star: the greater neighbours of a node go to the least of it and its neighbours
        both = cut(now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y"))))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = cut(both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x != y").distinct())
        # small star: a node and its lesser neighbours go to the least of them
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        now = cut(large.join(least, "x").select(F.explode(F.array("x", "y")).alias("x"), F.col("m").alias("y")).where("x != y").distinct())
        if (mark := _print(now)) == seen:
            break
        seen = mark
    return cut(nodes.distinct().join(now, F.col("node") == F.col("x"), "left").select("node", F.coalesce("y", "node").alias("component")))
