"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.graph import connected as components  # noqa: F401

#: Bytes up to which a table is broadcast, as `small` counts them. Beyond it, joins shuffle.
BROADCAST_BYTES = 16 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir.

    Only where that is unset and the session runs in one process (tests), a temporary folder takes its place.
    """
    sc = spark.sparkContext
    if folder := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        return folder
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
        return sc.getCheckpointDir()
    raise ValueError("spark.checkpoint.dir names no folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read from there: its lineage ends here."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`df` (already cut) with a broadcast hint if its cells have at most `limit` bytes; else as it is, for a shuffled join."""
    cell = {"string": F.octet_length, "binary": F.octet_length}
    width = [F.coalesce(cell[t](c), F.lit(0)) + 8 if t in cell else F.greatest(F.size(c), F.lit(0)) * 16 + 8 if t.startswith("array") else F.lit(8) for c, t in df.dtypes]
    return F.broadcast(df) if (df.agg(F.sum(sum(width, F.lit(8)))).first()[0] or 0) <= limit else df
