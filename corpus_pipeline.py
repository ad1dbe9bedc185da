"""From documents to packed sequences: language, copies, near copies, test items, packing.

Each stage is a function of (spark, docs, sf_dir). Its result is written as Parquet and read again as the next
one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from litevidence.llm import decontaminate, exact_dedup, jaccard_join, language_id, packing
from litevidence.llm.common import crc_fold, documents, staged, table
from litevidence.llm.queries import tokenizer_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that no language model takes for its own: no letters, or unlike all languages."""
    folds, out = language_id.HELD_OUT
    model = language_id.train(docs.where(crc_fold("doc_id", folds) != out).select("text", "lang"))
    return language_id.known_language(docs, model)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    return exact_dedup.without_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by similar shingles, the one with the smallest doc_id."""
    return jaccard_join.one_of_each(docs)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold an item of the benchmark."""
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, each with its sequence and place."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("jaccard_join", without_near_copies),
    ("decontamination", without_test_items),
    ("packing", packed),
]
# Language models and packing have no SQL form; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
