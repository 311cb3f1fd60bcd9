"""Time-slice statistics as a stream (the incremental form of F25)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slice_stats_stream(events: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """(slice_start, cell, n, mean, std) by tumbling window and cell; rows later than `late` are dropped, and their state with them."""
    w = events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "cell")
    return w.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")).select(F.col("w.start").alias("slice_start"), "cell", "n", "mean", "std")
