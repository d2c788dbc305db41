"""The corpus pipeline: quality rules, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir), docs with the columns of documents, and returns a DataFrame; run() writes it as Parquet in the
shared folder and reads it as the next stage's docs. All stages but the last return the columns of documents, in their order:
the first two return some of the rows as they are, the third all rows with secrets masked in text. Nulls, empty and repeated rows
are as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagefold.llm import packing, quality, secrets, simhash
from pagefold.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rules and the classifier, which is fitted on the labelled ones among docs."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id."""
    return simhash.keep_one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secret spans replaced by a mask; n_chars is that of the new text."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document: its bucket, padded length, batch and place."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("simhash_near_dedup", simhash_near_dedup), ("secret_scans", secret_scans), ("packing", pack)]

#: The classifier's verdict and the fingerprints can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
