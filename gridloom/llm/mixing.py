"""Mixing sources to target weights by subset-sum budget fitting.

1. Documents are counted by source and exact length (words between white space).
2. The total budget T is the greatest for which every source can supply its share: T = min over sources of tokens / weight,
   times `share`. A source's budget is floor(weight * T).
3. Per source, a proportional part of every length is taken first: floor(count * budget / tokens). Then lengths are drawn in a seeded
   order, with the fractions that the floors left as weights, and give one document each while at least `table` words and one of the
   longest documents remain. What is left is fitted by bounded-knapsack dynamic programming over the remaining counts, in the same
   order: the greatest sum that does not exceed it. Where that misses the budget by the lengths' common divisor or more, less is drawn and
   the program runs over 16 times as many words, in the end over all that the floors left: so the sum is the greatest that there is.
4. The planned number of documents of each length is chosen in the order of a seeded hash: counts by ranges of hashes tell which ranges are taken
   whole, and only the documents of the range in which a plan ends are ranked. No length or source is ever gathered in a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small

#: Ranges of hashes by which documents are counted: 2 to the power of this.
BITS = 12


def length() -> "F.Column":
    """Words between white space: of a null or blank text, 0."""
    return F.expr(r"coalesce(if(text = '', 0, size(split(text, '\\s+', -1)) - cast(substr(text, 1, 1) rlike '\\s' as int) - cast(substr(text, -1, 1) rlike '\\s' as int)), 0)")


def turn(seed: int) -> "F.Column":
    """The hash by which documents have their turn: of doc_id, or where it is null, of the text."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(seed))).otherwise(F.xxhash64("doc_id", F.lit(seed)))


def _knapsack(lengths: np.ndarray, counts: np.ndarray, rest: int, order: np.ndarray) -> np.ndarray:
    """How many of each length make the greatest sum of at most `rest`."""
    take, some = np.zeros(len(lengths), np.int64), lengths[(counts > 0) & (lengths > 0)]
    unit = int(np.gcd.reduce(some)) if len(some) else 1
    rest //= unit
    # bit s of `reach` says that a sum s can be made; each step keeps its table for the way back
    mask, reach, steps = (1 << (rest + 1)) - 1, 1, []
    for i in order:
        size = int(lengths[i]) // unit
        have, part = min(int(counts[i]), rest // size) if size else 0, 1
        while have > 0:
            part = min(part, have)
            new = (reach | reach << (part * size)) & mask
            if new != reach:
                steps.append((i, part, reach))
                reach = new
            have -= part
            part *= 2
        if reach >> rest & 1:
            break
    at = reach.bit_length() - 1
    for i, part, before in reversed(steps):
        if not before >> at & 1:
            take[i] += part
            at -= part * (int(lengths[i]) // unit)
    return take


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, table: int = 1 << 20, seed: int = 17) -> np.ndarray:
    """How many documents of each length to take: the greatest sum(take * lengths) <= budget that the proportional part allows."""
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    total = int((lengths * counts).sum())
    if total <= budget:
        return counts.copy()
    if budget <= 0:
        return np.zeros(len(lengths), np.int64)
    base = np.array([int(c) * budget // total for c in counts], np.int64)
    rest = budget - int((base * lengths).sum())
    part = np.array([int(c) * budget % total / total for c in counts])
    order = np.argsort(np.random.default_rng(seed).exponential(size=len(lengths)) / np.maximum(part, 1e-12), kind="stable")
    order = order[(counts[order] > base[order]) & (lengths[order] > 0)]
    unit = int(np.gcd.reduce(lengths[order])) if len(order) else 1
    while True:
        bulk = order[: int(np.searchsorted(np.cumsum(lengths[order]), rest - max(table, int(lengths.max())), "right"))]
        take = base.copy()
        take[bulk] += 1
        take += _knapsack(lengths, counts - take, budget - int((take * lengths).sum()), order)
        if not len(bulk) or budget - int((take * lengths).sum()) < unit:
            take[lengths == 0] = 0
            return take
        table *= 16


def _histogram(docs: DataFrame, seed: int) -> DataFrame:
    """(source, n_tokens, range, n), written down."""
    own = docs.select("source", length().alias("n_tokens"), F.shiftright(turn(seed), 64 - BITS).alias("range"))
    return cut(own.where("source is not null and n_tokens > 0").groupBy("source", "n_tokens", "range").agg(F.count("*").alias("n")))


def plan_mix(hist: DataFrame, weights: dict[str, float] | None = None, share: float = 1.0, table: int = 1 << 14) -> DataFrame:
    """(source, n_tokens, take): the plan for counts (source, n_tokens, n). Weights are normalised; None gives all sources the same weight, except that they are
    read from the data. A source without weight, or of null name, is not drawn from; neither are documents without a word."""
    hist = hist.groupBy("source", "n_tokens").agg(F.sum("n").alias("n"))
    totals = hist.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("tokens"))
    if weights is None:
        part = totals.withColumn("w", F.lit(1.0))
    else:
        some = {k: float(v) for k, v in weights.items() if v > 0}
        pairs = F.create_map(*[F.lit(x) for kv in some.items() for x in kv]) if some else F.lit(None).cast("map<string,double>")
        part = totals.withColumn("w", pairs[F.col("source")]).where("w is not null")
    whole = part.agg(F.sum("w").alias("sum_w"), F.min(F.col("tokens") / F.col("w")).alias("least"))
    # least / ... : T = min(tokens / (w / sum_w)) = least * sum_w, a source's budget = w / sum_w * T * share = w * least * share
    budgets = part.crossJoin(F.broadcast(whole)).select("source", F.floor(F.col("w") * F.col("least") * F.lit(share) + F.lit(1e-6)).cast("long").alias("budget"))

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n_tokens")
        take = fit(pdf.n_tokens.to_numpy(), pdf.n.to_numpy(), int(pdf.budget.iloc[0]), table)
        return pdf[["source", "n_tokens"]].assign(take=take)[take > 0]

    return hist.join(budgets, "source").groupBy("source").applyInPandas(plan, "source string, n_tokens int, take long")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, share: float = 1.0, seed: int = 17, whole_rows: bool = False) -> DataFrame:
    """The chosen documents: (doc_id, source, n_tokens), or with `whole_rows` all columns of `docs`.

    Within a source and length, documents are taken in the order of xxhash64(doc_id, seed), of a null doc_id xxhash64(text, seed), then doc_id, then
    text; of repeated rows as many are taken as the plan has places. Null sources and texts without a word are never chosen. An empty
    table gives an empty result. Other columns, whatever their names, only pass through.
    """
    keep = docs.columns if whole_rows else ["doc_id", "source"]
    hist = _histogram(docs, seed)
    ranges = Window.partitionBy("source", "n_tokens").orderBy("range")  # at most 2 ** BITS rows of counts
    reached = hist.join(plan_mix(hist, weights, share), ["source", "n_tokens"]).withColumn("upto", F.sum("n").over(ranges))
    last = cut(reached.where("upto >= take and upto - n < take").select(F.col("source").alias("__gl_source"), F.col("n_tokens").alias("__gl_len"), F.col("range").alias("__gl_last"), (F.col("take") - F.col("upto") + F.col("n")).alias("__gl_take")))
    own = docs.select(F.struct(*[docs[f"`{c}`"] for c in keep]).alias("__gl_row"), F.col("source").alias("__gl_src"), length().alias("__gl_n"), F.col("doc_id").alias("__gl_id"), turn(seed).alias("__gl_turn"), F.xxhash64("text").alias("__gl_text"))
    placed = own.join(small(last), (F.col("__gl_src") == F.col("__gl_source")) & (F.col("__gl_n") == F.col("__gl_len"))).withColumn("__gl_range", F.shiftright("__gl_turn", 64 - BITS))
    order = Window.partitionBy("__gl_src", "__gl_n").orderBy("__gl_turn", "__gl_id", "__gl_text")
    ranked = placed.where("__gl_range = __gl_last").withColumn("__gl_rank", F.row_number().over(order)).where("__gl_rank <= __gl_take").drop("__gl_rank")
    picked = placed.where("__gl_range < __gl_last").unionByName(ranked)
    return picked.select("__gl_row.*") if whole_rows else picked.select("__gl_row.doc_id", "__gl_row.source", F.col("__gl_n").alias("n_tokens"))
