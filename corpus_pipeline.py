"""The corpus pipeline: stages over the documents table, each written as Parquet and read again.

Every stage works on what its predecessor kept.  All but the last return the columns
of documents; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veritab.llm import language_id, minhash, packing, quality_classifier, shared, suffix_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; the labels of sf_dir, if it is named, say which words are toxic."""
    return quality_classifier.keep_good(docs, shared.table(spark, sf_dir, "labels") if sf_dir else None)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no recognised language go."""
    return language_id.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of smallest doc_id."""
    return minhash.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that also start earlier are cut out of the texts."""
    return suffix_dedup.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens."""
    return packing.op9_packing(docs)


STAGES = [
    ("quality classifier", quality),
    ("language ID", language),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", repeats),
    ("packing", packed),
]

#: The first two stages train models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
