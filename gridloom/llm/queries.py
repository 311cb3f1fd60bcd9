"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import class_lm, hnsw, interleave, jaccard_join, license_scan, mixing, packing, quality, substring, toxicity
from .common import read


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(read(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(read(spark, sf_dir, "documents"))


def op4_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave.interleave(read(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.toxic_documents(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.perplexity(read(spark, sf_dir, "documents"))


def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(read(spark, sf_dir, "embeddings"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stay, with their probability."""
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels"))).where("keep").select("doc_id", "p")


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_intervals(read(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_packing, op3_jaccard_join, op4_interleave, op5_toxicity, op6_class_lm, op7_hnsw, op8_quality, op9_substring, op10_mixing)}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_scan.license_sql(), "op9_substring": substring.repeats_sql()}
