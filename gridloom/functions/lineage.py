"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where that is unset and the session runs in one process (tests), a temporary folder."""
    sc = spark.sparkContext
    if folder := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        return folder
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
        return sc.getCheckpointDir()
    raise ValueError("spark.checkpoint.dir names no folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read from there."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
