"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.grid import GridSpec
from ..sources.views import WIDTH, px

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def spec(spark: SparkSession, sf_dir: str) -> GridSpec:
    """The grid of the pixel view."""
    rows = px(spark, sf_dir).agg({"row": "max"}).first()[0]
    return GridSpec(400000.0, 300000.0, 10.0, WIDTH, (rows if rows is not None else -1) + 1)
