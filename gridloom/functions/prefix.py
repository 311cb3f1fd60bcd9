"""Running totals in a global order, without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def running_totals(df: DataFrame, order: list[Column], sums: dict[str, str], n: int | None = None) -> DataFrame:
    """`df` with, for each (name, column) of `sums`, the column's total over the rows up to this one in `order` (rows frame).

    Rows are range-partitioned by the order; each partition sums on its own, and the partitions' totals, one row each, give the offsets.
    `order` should be a total order for a defined result; rows equal under it stay in one partition.
    """
    spark = df.sparkSession
    n = n or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parted = cut(df.repartitionByRange(n, *order).withColumn("__gl_p", F.spark_partition_id()))
    own = Window.partitionBy("__gl_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("__gl_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = parted.groupBy("__gl_p").agg(*[F.sum(c).alias(f"__gl_t_{k}") for k, c in sums.items()])
    offsets = totals.select(F.col("__gl_p").alias("__gl_q"), *[F.coalesce(F.sum(f"__gl_t_{k}").over(before), F.lit(0)).alias(f"__gl_b_{k}") for k in sums])
    out = parted.join(F.broadcast(offsets), F.col("__gl_p") == F.col("__gl_q"))  # as many rows as there are partitions
    return out.withColumns({k: F.sum(c).over(own) + F.col(f"__gl_b_{k}") for k, c in sums.items()}).drop("__gl_p", "__gl_q", *[f"__gl_b_{k}" for k in sums])
