"""Substring deduplication by Rabin-Karp hashes of every fixed-length word window.

One pass hashes all windows of `window` words. The hashes travel to the owners of their ranges as packed arrays (8 bytes a
window, with positions), are counted there, and the positions of those that occur at least twice anywhere travel back to their
documents, where touching and overlapping windows merge into maximal intervals. Nothing is sampled, and no window is left
out. A chunk of documents sends a hash once, however often it holds it; the positions of one that it holds twice don't leave
it. So of a passage that a third of all documents share, its range gets as many hashes as there are chunks, and no pairs are made.

Windows of one 64-bit hash count as equal: among n different windows, n^2 / 2^65 pairs are expected to be so wrongly (.03 for a billion, 3 * 10^6 for 10^13).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions, small
from .text import DROP, Chunk, lean, lean_groups, mix, pieces, rolling

WINDOW = 50
_WIRE = "bucket int, chunk long, kind int, a binary, b binary, c binary, d binary"
_NAMES = ["bucket", "chunk", "kind", "a", "b", "c", "d"]


def _spread(at: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending positions as the low and high halves of their differences: the high ones are nearly all 0 and compress away."""
    step = np.diff(at, prepend=0).astype(np.uint32)
    return (step & 0xFFFF).astype(np.uint16).tobytes(), (step >> 16).astype(np.uint16).tobytes()


def _gather(low: bytes, high: bytes) -> np.ndarray:
    step = np.frombuffer(low, np.uint16).astype(np.int64) | np.frombuffer(high, np.uint16).astype(np.int64) << 16
    return np.cumsum(step)


def repeated_intervals(docs: DataFrame, window: int = WINDOW, buckets: int | None = None) -> DataFrame:
    """(doc_id, start_word, end_word): maximal intervals [start, end) of words covered by windows that occur twice or more.

    A window may repeat inside one document or across documents; all its occurrences count, the first one too. Texts of fewer than
    `window` words, nulls and empty texts have no window. Repeated rows are documents of their own, so their windows
    repeat. A null doc_id is reported as null. Other columns are ignored. An empty table gives an empty result.

    `buckets` is the number of hash ranges, by default four for each shuffle partition of the session, so it follows the
    partitioning chosen for the input; a range is held by one task at a time.
    """
    spark = docs.sparkSession
    ranges = buckets or 4 * shuffle_partitions(spark)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                chunk = Chunk(part.column("text"))
                full = np.maximum(chunk.counts - window + 1, 0)
                total = int(full.sum())
                if not total:
                    continue
                ends = np.cumsum(full)
                at = np.arange(total) + np.repeat(chunk.offsets[:-1] - (ends - full), full)
                h = mix(rolling(chunk.hashes, window)[at])
                # of hashes that the chunk holds twice or more, all positions are hits, and one copy goes out without a position (kind 3)
                by = np.argsort(h, kind="stable")
                same = h[by][1:] == h[by][:-1]
                again, other = np.zeros(total, bool), np.zeros(total, bool)
                again[by[1:][same]] = again[by[:-1][same]] = True
                other[by[1:][same]] = True
                out = []
                for kind, some in ((0, np.flatnonzero(~again)), (3, np.flatnonzero(again & ~other))):
                    owner = (h[some] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
                    order = some[np.argsort(owner.astype(np.uint16) if ranges <= 1 << 16 else owner.astype(np.uint32), kind="stable")]
                    cuts = np.concatenate(([0], np.cumsum(np.bincount(owner.astype(np.int64), minlength=ranges))))
                    out += [(b, kind, order[x:y]) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x]
                ids = part.column("doc_id").to_numpy(zero_copy_only=False) if not part.column("doc_id").null_count else np.array([-1 if x is None else x for x in part.column("doc_id").to_pylist()], np.int64)
                has = full > 0
                known = np.array([x is not None for x in part.column("doc_id").to_pylist()])[has] if part.column("doc_id").null_count else np.ones(int(has.sum()), bool)
                # a name made of all contents: it is the same in a repeated attempt, and differs where the contents differ
                name = int(mix(np.array([np.bitwise_xor.reduce(mix(h + np.arange(total, dtype=np.uint64))) ^ np.bitwise_xor.reduce(mix(ids.astype(np.int64).view(np.uint64) + np.arange(len(ids), dtype=np.uint64)))], np.uint64)).view(np.int64)[0])
                rows = [(b, name, kind, h[x].tobytes(), *(_spread(x) if kind == 0 else (b"", b"")), b"") for b, kind, x in out]
                if again.any():
                    rows.append((name % ranges, name, 2, b"", *_spread(np.flatnonzero(again)), b""))
                rows.append((name % ranges, name, 1, ids[has].astype(np.int64).tobytes(), full[has].astype(np.int64).tobytes(), known.astype(np.uint8).tobytes(), b""))
                yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4), strict=True)], _NAMES)

    def count(key: tuple, table: pa.Table) -> pa.Table:
        """The positions of repeated hashes of one range, by chunk; the documents' rows pass through."""
        kinds = table.column("kind").to_numpy()
        own = table.filter(pa.array(kinds == 0))
        out = [(0, m["chunk"], m["kind"] % 2, m["a"], m["b"], m["c"], b"") for m in table.filter(pa.array((kinds == 1) | (kinds == 2))).to_pylist()]
        if own.num_rows:
            blobs = own.column("a").to_pylist()
            held = np.frombuffer(b"".join(table.filter(pa.array(kinds == 3)).column("a").to_pylist()), np.uint64)
            h = np.concatenate((np.frombuffer(b"".join(blobs), np.uint64), held))
            order = np.argsort(h)
            s = h[order]
            same = s[1:] == s[:-1]
            twice = np.zeros(len(h), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            edge = np.cumsum([0] + [len(x) // 8 for x in blobs])
            for i, (chunk, low, high) in enumerate(zip(own.column("chunk").to_pylist(), own.column("b").to_pylist(), own.column("c").to_pylist(), strict=True)):
                if (hit := twice[edge[i] : edge[i + 1]]).any():
                    out.append((0, chunk, 0, b"", *_spread(_gather(low, high)[hit]), b""))
        return pa.Table.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*out, strict=True) if out else [[]] * 7, (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4), strict=True)], names=_NAMES)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        """The intervals of one chunk's documents. Two chunks of the same contents have the same name and the same positions."""
        kinds = table.column("kind").to_numpy()
        meta = table.filter(pa.array(kinds == 1)).to_pylist()
        hits = table.filter(pa.array(kinds == 0))
        ids: list[np.ndarray] = []
        starts: list[np.ndarray] = []
        stops: list[np.ndarray] = []
        known: list[np.ndarray] = []
        if hits.num_rows:
            if not meta:
                raise RuntimeError("positions came back to a chunk that isn't there: the documents changed between two reads")
            at = np.unique(np.concatenate([_gather(x, y) for x, y in zip(hits.column("b").to_pylist(), hits.column("c").to_pylist(), strict=True)]))
            full = np.frombuffer(meta[0]["b"], np.int64)
            ends = np.cumsum(full)
            doc = np.searchsorted(ends, at, "right")
            word = at - (ends - full)[doc]
            new = np.ones(len(at), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (word[1:] > word[:-1] + window)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            for m in meta:
                ids.append(np.frombuffer(m["a"], np.int64)[doc[first]])
                known.append(np.frombuffer(m["c"], np.uint8)[doc[first]] == 1)
                starts.append(word[first])
                stops.append(word[last] + window)
        none = np.empty(0, np.int64)
        cat = lambda xs: np.concatenate(xs) if xs else none
        return pa.table({"doc_id": pa.array(cat(ids), mask=~cat(known).astype(bool)), "start_word": cat(starts).astype(np.int32), "end_word": cat(stops).astype(np.int32)})

    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(hashes), _WIRE)
    back = sent.groupBy("bucket").applyInArrow(lean_groups(count), _WIRE)
    return back.groupBy("chunk").applyInArrow(lean_groups(merge), "doc_id long, start_word int, end_word int")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """`text` without the words of the spans and the white space after them; other characters stay as they are."""
    runs = list(re.finditer(r"\S+", text))
    plain = pc.replace_substring_regex(pc.utf8_lower(pa.array([m[0] for m in runs], pa.string())), DROP, "").to_pylist()
    words = [m for m, p in zip(runs, plain, strict=True) if p]
    out, done = [], 0
    for a, b in sorted(spans):
        out.append(text[done : words[a].start()])
        done = words[b].start() if b < len(words) else len(text)
    return "".join([*out, text[done:]])


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` without the repeated passages: all occurrences of windows that occur twice or more are cut from the texts.

    n_chars, if there is such a column, is counted anew for the texts that changed. A document of which nothing but white space is left is dropped;
    one that had no repeat stays as it was, null and empty texts too. Rows of null doc_id, and repeated rows, are treated by
    the intervals found for their doc_id (null ones are left alone). Columns stay as they are.
    """
    spans = cut(
        repeated_intervals(docs, window).where("doc_id is not null").distinct().groupBy(F.col("doc_id").alias("__gl_id")).agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("__gl_spans"))
    )
    joined = docs.join(small(spans), docs["doc_id"] == spans["__gl_id"], "left").drop("__gl_id")
    names = docs.columns

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                spans = part.column("__gl_spans")
                own = part.select(names)
                if spans.null_count == part.num_rows:
                    yield own
                    continue
                texts, keep, sizes = part.column("text").to_pylist(), [], {}
                for i, s in enumerate(spans.to_pylist()):
                    ok = True
                    if s and texts[i] is not None:
                        texts[i] = cut_words(texts[i], [(x["start_word"], x["end_word"]) for x in s])
                        sizes[i] = len(texts[i])
                        ok = bool(texts[i].strip())
                    keep.append(ok)
                columns = dict(zip(names, own.columns, strict=True))
                columns["text"] = pa.array(texts, pa.string())
                if "n_chars" in columns:
                    old = columns["n_chars"]
                    columns["n_chars"] = pa.array([sizes.get(i, x) for i, x in enumerate(old.to_pylist())], old.type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), schema=own.schema).filter(pa.array(keep))

    return joined.mapInArrow(lean(rewrite), docs.schema)


def repeats_sql(window: int = WINDOW) -> str:
    """`repeated_intervals` over `documents` in DuckDB SQL."""
    return f"""
WITH runs AS (SELECT doc_id, row_number() OVER () AS r, list_filter(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda x: regexp_replace(x, '[^\\p{{L}}\\p{{N}}]+', '', 'g')), lambda x: x != '') AS w FROM documents),
wins AS (SELECT doc_id, r, s, md5(array_to_string(list_slice(w, s + 1, s + {window}), ' ')) AS h FROM (SELECT doc_id, r, w, unnest(range(0, len(w) - {window} + 1)) AS s FROM runs)),
twice AS (SELECT h FROM wins GROUP BY h HAVING count(*) > 1),
hit AS (SELECT doc_id, r, s, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + {window} THEN 0 ELSE 1 END AS new FROM wins WHERE h IN (SELECT h FROM twice)),
grouped AS (SELECT doc_id, r, s, sum(new) OVER (PARTITION BY r ORDER BY s) AS g FROM hit)
SELECT doc_id, min(s)::INTEGER AS start_word, (max(s) + {window})::INTEGER AS end_word FROM grouped GROUP BY doc_id, r, g
"""
