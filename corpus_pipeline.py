"""The corpus pipeline: toxicity, exact copies, near copies, secrets, packing.

Every stage takes (spark, docs, sf_dir), works on all rows of `docs` and returns a DataFrame; all but the last return the columns of `documents`.

Defined results, for every stage: NULL texts count as empty, empty texts are clean, equal to each other and hold no secrets; NULL ids are ids like
any other, and rows that repeat an id stay rows of their own until a copy of their text stands for them; extra columns, whatever their names, pass
through unchanged; an empty table gives an empty result; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wearline.llm import exact_dedup, ngram_join, packing, secret_scan, toxicity
from wearline.llm.common import cut
from wearline.session import ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator, learned from these documents and `labels`, does not reject."""
    ship_package(spark)
    return toxicity.without_toxic(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of texts that are equal but for white space."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every class of near copies."""
    ship_package(spark)
    return ngram_join.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets that belong to someone are overwritten with asterisks, copied examples stay."""
    ship_package(spark)
    return secret_scan.masked(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents with their sequence and their place in it."""
    ship_package(spark)
    return packing.placed(cut(packing.pieces(docs, digests=True)))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scan", mask_secrets),
    ("best-fit packing", pack_sequences),
]

#: Learned scores, signatures and a fitted plan have no SQL twin; tests compare every stage with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
