"""From raw documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir), works on all rows of docs, and its result is written before the next one
reads it. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memoryloom.llm import lines, packing, quality, secrets, simhash
from memoryloom.llm.shared import Scratch


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among docs, accepts."""
    return quality.accepted(docs, quality.fit_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand, alike, in an earlier place; those of which hardly anything is left go."""
    return lines.without_repeated_lines(spark, docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates by SimHash."""
    return simhash.one_per_group(spark, docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets and linked credential parts masked."""
    return secrets.redact(spark, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2048."""
    return packing.pack_documents(spark, docs)


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", distinct_lines),
    ("SimHash near-dedup", distinct_documents),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]

#: Trained, fuzzy and packing stages have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Tables of the stages are deleted, after a failure too; that of the result stays until its folder is cleared."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for _, stage in STAGES[:-1]:
            docs = scratch.save(stage(spark, docs, sf_dir), docs)
        return scratch.keep(STAGES[-1][1](spark, docs, sf_dir), small=False)
