"""All queries of the grid and vector operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import zonal
from . import q_geometry, q_learn, q_masks, q_more, q_patches, q_rules, q_space
from .base import ORACLES, QUERIES, Query

MODULES = (q_masks, q_patches, q_space, q_geometry, q_rules, q_learn, q_more)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: hysteresis patches, their sizes and the division of the landscape."""
    patches = cut(q_patches.patches(spark, sf_dir))
    return zonal.size_summary(patches).crossJoin(F.broadcast(zonal.landscape_division(patches)))  # one row each


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
