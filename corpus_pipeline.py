"""A training corpus from raw documents, in five stages.

A stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame; it is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents.

Every stage takes nulls in any column, empty and very long texts, ties and repeated rows, empty tables (of which it makes empty ones) and further columns
of any name (which pass through all but the last); what becomes of such rows stands with each stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import jaccard_join, mixing, packing, quality, substring
from gridloom.llm.common import read, shared_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (trained on these documents' labels) rejects go.

    Null, empty and blank texts go too. A null doc_id doesn't matter, and repeated rows are treated alike. Without labels all weights are 0, and every text with a word stays.
    """
    return quality.keep_good(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of the least doc_id.

    Of repeated rows of a doc_id one stays. Rows of null doc_id, and texts without a word, stay as they are.
    """
    return jaccard_join.drop_near_duplicates(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that occur twice or more are cut out, at every place.

    n_chars is counted anew for texts that changed; a document of which nothing is left goes. Rows of null doc_id, and null, empty and short texts, stay as they are.
    """
    return substring.remove_repeats(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in equal weights, as many words as the smallest source can supply.

    Null sources, and texts without a word, are never drawn; null doc_ids are, in the order of a hash of their text. Of repeated rows as many are drawn as their length has places.
    """
    return mixing.mix(docs, share=1.0, whole_rows=True)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of lexical neighbours of the documents whose doc_id is divisible by 50, then windows of what these left.

    Texts without a word have no piece; rows of null doc_id are no seeds; repeated rows are documents of their own. Other columns end here.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("substring", substring_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The fitted classifier, the bucketed hashing and the knapsack can't be said in SQL: the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to documents. What lies between them is written below the shared folder of the session, and removed when the next stage is written."""
    docs = read(spark, sf_dir, "documents")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.parquet(f"{base}/{i}-{name}")
        if i:
            _remove(spark, f"{base}/{i - 1}-{STAGES[i - 1][0]}")
    return docs


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
