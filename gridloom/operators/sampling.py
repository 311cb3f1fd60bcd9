"""Sampling, blocking and folds (section K). Draws are made in the order of md5(id), so they repeat and SQL can say them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw_order(id_col: str = "id") -> list[Column]:
    return [F.md5(F.col(id_col).cast("string")), F.col(id_col)]


def turn(by: list[str], id_col: str = "id") -> Column:
    """The place of a row in its group's draw, from 1."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(*draw_order(id_col)))


def spatial_blocks(df: DataFrame, side: float = 2000.0, least: int = 10) -> DataFrame:
    """`block`: xi * ny + yi of bins over the extent, n = max(10, int(range / side)) an axis, the last bin closed (K1)."""
    b = df.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    b = b.select("*", F.greatest(F.lit(least), F.floor((F.col("x1") - F.col("x0")) / side)).alias("nx"), F.greatest(F.lit(least), F.floor((F.col("y1") - F.col("y0")) / side)).alias("ny"))
    at = lambda v, lo, hi, n: F.coalesce(F.least(F.floor((F.col(v) - F.col(lo)) / F.nullif(F.col(hi) - F.col(lo), F.lit(0.0)) * F.col(n)), F.col(n) - 1), F.lit(0))
    out = df.crossJoin(F.broadcast(b)).withColumns({"bx": at("x", "x0", "x1", "nx").cast("int"), "by": at("y", "y0", "y1", "ny").cast("int")})
    return out.withColumn("block", F.col("bx").cast("long") * F.col("ny") + F.col("by")).drop("x0", "x1", "y0", "y1", "nx", "ny")


def assign_folds(blocked: DataFrame, k: int) -> DataFrame:
    """`fold`: blocks in md5 order are dealt to k folds in turn (K2). Blocks are few: one row each."""
    folds = blocked.select("block").distinct().withColumn("fold", ((F.row_number().over(Window.orderBy(F.md5(F.col("block").cast("string")), "block")) - 1) % k).cast("int"))
    return blocked.join(folds, "block")


def buffer_exclusion(blocked: DataFrame, test_fold: int, buffer: int = 1) -> DataFrame:
    """Training rows for a test fold: other folds, without blocks within `buffer` blocks of a test block; no wrap at the edges (K3)."""
    o = F.explode(F.sequence(F.lit(-buffer), F.lit(buffer)))
    near = blocked.where(F.col("fold") == test_fold).select("bx", "by").distinct().select("bx", "by", o.alias("a")).select("*", o.alias("b")).select((F.col("bx") + F.col("a")).alias("bx"), (F.col("by") + F.col("b")).alias("by")).distinct()
    return blocked.where(F.col("fold") != test_fold).join(near, ["bx", "by"], "left_anti")


def rebalance(df: DataFrame, ratio: float, share: float | None, id_col: str = "id") -> DataFrame:
    """`kept` by block (K4): all positives (label >= 2); background up to int(positives * ratio), of which the share goes to class 1
    and the rest to class 0; without a share, half each, the odd one to class 1; places that a class can't fill go to the other. Blocks without both sides are discarded whole."""
    c = df.groupBy("block").agg(F.sum((F.col("label") >= 2).cast("int")).alias("np"), F.sum((F.col("label") == 0).cast("int")).alias("n0"), F.sum((F.col("label") == 1).cast("int")).alias("n1"))
    quota = F.floor(F.col("np") * ratio)
    q = c.withColumn("q", F.least(quota, F.col("n0") + F.col("n1"))).withColumn("w1", F.floor((F.col("q") + 1) / 2) if share is None else F.floor(F.col("q") * share)).withColumn("w0", F.col("q") - F.col("w1"))
    q = q.withColumn("k1", F.least("n1", F.col("w1") + F.greatest(F.lit(0), F.col("w0") - F.col("n0")))).withColumn("k0", F.least("n0", F.col("w0") + F.greatest(F.lit(0), F.col("w1") - F.col("n1"))))
    ok = (F.col("np") > 0) & (F.col("n0") + F.col("n1") > 0)
    j = df.withColumn("__gl_t", turn(["block", "label"], id_col)).join(q.select("block", "k0", "k1", ok.alias("__gl_ok")), "block")
    return j.withColumn("kept", F.col("__gl_ok") & ((F.col("label") >= 2) | ((F.col("label") == 0) & (F.col("__gl_t") <= F.col("k0"))) | ((F.col("label") == 1) & (F.col("__gl_t") <= F.col("k1"))))).drop("__gl_t", "__gl_ok", "k0", "k1")


def balanced(df: DataFrame, per_class: int, label: str = "label", id_col: str = "id") -> DataFrame:
    """At most per_class rows a class (K5, K9 with another column)."""
    return df.withColumn("__gl_t", turn([label], id_col)).where(F.col("__gl_t") <= per_class).drop("__gl_t")


def block_holdout(blocked: DataFrame, share: float = 0.2) -> DataFrame:
    """`held`: the first share of the blocks in md5 order, one at least (K6)."""
    w = Window.orderBy(F.md5(F.col("block").cast("string")), "block")
    b = blocked.select("block").distinct().withColumn("__gl_r", F.row_number().over(w))
    n = b.agg(F.greatest(F.lit(1), F.floor(F.count("*") * share)).alias("__gl_n"))
    return blocked.join(b.crossJoin(F.broadcast(n)).select("block", (F.col("__gl_r") <= F.col("__gl_n")).alias("held")), "block")


def proportional(df: DataFrame, most: int, by: str, label: str = "label", id_col: str = "id") -> DataFrame:
    """Of each group with more than `most` rows, int(most * class share) rows a class (K7)."""
    n, c = df.groupBy(by).agg(F.count("*").alias("__gl_n")), df.groupBy(by, label).agg(F.count("*").alias("__gl_c"))
    j = df.withColumn("__gl_t", turn([by, label], id_col)).join(n, by).join(c, [by, label])
    return j.where((F.col("__gl_n") <= most) | (F.col("__gl_t") <= F.floor(F.lit(most) * F.col("__gl_c") / F.col("__gl_n")))).drop("__gl_n", "__gl_c", "__gl_t")


def stratified(df: DataFrame, n: int, cell: str, id_col: str = "id") -> DataFrame:
    """n rows spread over cells: base = n div cells each, one more for the first n % cells cells; places left over go, in md5 order,
    to the rows not yet drawn (K8)."""
    cells = df.groupBy(cell).agg(F.count("*").alias("c")).withColumn("i", F.row_number().over(Window.orderBy(cell)) - 1)
    total = cells.agg(F.count("*").alias("m"))
    quota = cells.crossJoin(F.broadcast(total)).select(cell, (F.floor(F.lit(n) / F.col("m")) + (F.col("i") < F.lit(n) % F.col("m")).cast("int")).alias("q"))
    first = df.withColumn("__gl_t", turn([cell], id_col)).join(quota, cell).withColumn("__gl_in", F.col("__gl_t") <= F.col("q"))
    short = first.agg((F.lit(n) - F.sum(F.col("__gl_in").cast("int"))).alias("s")).first()["s"] or 0
    rest = first.where(~F.col("__gl_in")).orderBy(*draw_order(id_col)).limit(max(0, int(short)))
    return first.where("__gl_in").unionByName(rest).drop("__gl_t", "__gl_in", "q")


def split_strata(df: DataFrame, n: int, flag: str, id_col: str = "id") -> DataFrame:
    """n rows, half of either side of a flag, a short side made up from the other (K11). Counts: one row for each side."""
    c = df.agg(F.sum(F.col(flag).cast("int")).alias("a"), F.sum((~F.col(flag)).cast("int")).alias("b"))
    half, other = n // 2, n - n // 2
    q = c.select(F.least("a", half + F.greatest(F.lit(0), other - F.col("b"))).alias("qa"), F.least("b", other + F.greatest(F.lit(0), half - F.col("a"))).alias("qb"))
    return df.withColumn("__gl_t", turn([flag], id_col)).crossJoin(F.broadcast(q)).where(F.col("__gl_t") <= F.when(F.col(flag), F.col("qa")).otherwise(F.col("qb"))).drop("__gl_t", "qa", "qb")


def uniform(df: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    """The first n rows in md5 order, a top-k."""
    return df.orderBy(*draw_order(id_col)).limit(n)


def validation_fold(df: DataFrame, least: int = 1000) -> DataFrame:
    """The largest fold with at least `least` rows in it and outside, and both classes on both sides; ties: the least."""
    f = df.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    t = f.agg(F.sum("n").alias("tn"), F.sum("p").alias("tp"))
    ok = (F.col("n") >= least) & (F.col("tn") - F.col("n") >= least) & (F.col("p") > 0) & (F.col("p") < F.col("n")) & (F.col("tp") > F.col("p")) & (F.col("tn") - F.col("n") > F.col("tp") - F.col("p"))
    return f.crossJoin(F.broadcast(t)).where(ok).agg(F.max_by("fold", F.struct("n", -F.col("fold"))).alias("fold"))
