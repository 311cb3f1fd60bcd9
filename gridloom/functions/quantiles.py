"""Exact percentiles without bringing the values, or a map of them, to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import running_totals


def percentiles(df: DataFrame, column: str, qs: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., q): for each group the array `q` of the percentiles `qs` of a column, interpolated between order statistics.

    Values are counted first; range-partitioned running totals of the counts, in the order of group and value, give every value its ranks; only
    the values that hold a wanted rank go on. NULLs don't count. A group without a value has no row; without groups, there is always one
    row, of NULLs if there is no value. So the result is as small as the groups are many.
    """
    by = by or []
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("__gl_v")).agg(F.count("*").alias("__gl_k"))
    keys = [F.col(c) for c in by]
    ranked = running_totals(counts, [*keys, F.col("__gl_v")], {"__gl_upto": "__gl_k"})
    whole = ranked.groupBy(*by).agg(F.sum("__gl_k").alias("__gl_n"), F.min(F.col("__gl_upto") - F.col("__gl_k")).alias("__gl_start")).select(*[F.col(c).alias(f"__gl_by_{c}") for c in by], "__gl_n", "__gl_start")
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__gl_by_{c}"))
    # as many rows as there are groups: Spark broadcasts them by their size
    placed = ranked.join(whole, same) if by else ranked.crossJoin(F.broadcast(whole))
    last = F.col("__gl_upto") - F.col("__gl_start") - 1  # the greatest rank, from 0, that the value holds
    first = last - F.col("__gl_k") + 1
    at = [F.lit(float(q)) * (F.col("__gl_n") - 1) for q in qs]
    held = lambda r: r.between(first, last)
    wanted = F.lit(False)
    for p in at:
        wanted |= held(F.floor(p)) | held(F.ceil(p))
    pick = lambda r: F.max(F.when(held(r), F.col("__gl_v")))
    parts = [F.struct(pick(F.floor(p)).alias("lo"), pick(F.ceil(p)).alias("hi"), F.max(p - F.floor(p)).alias("f")) for p in at]
    few = placed.where(wanted).groupBy(*by).agg(F.array(*parts).alias("__gl_q"))
    return few.select(*by, F.transform("__gl_q", lambda s: s["lo"] + (s["hi"] - s["lo"]) * s["f"]).alias("q"))
