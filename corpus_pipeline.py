"""A cleaning and packing pipeline over documents; a part of subpackage llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. A null text is an empty one; columns beside id and text
are carried, whatever they hold; an empty table passes every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeway.llm import bpe, classifier, exact_dedup, near_dedup, packing, secrets
from ridgeway.llm.common import table
from ridgeway.session import forget, ship, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones, doesn't reject. Empty texts get the bias alone;
    repeated rows fare alike; without labels all stay."""
    return classifier.keep_quality(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one of the smallest id, an id before none; ties go by raw text and columns. All empty
    texts are one."""
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id. Empty texts and rows without an id stay."""
    return near_dedup.near_dedup(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked and their sizes counted anew; nulls stay null."""
    return secrets.recounted(secrets.redact_secrets(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences, by its BPE tokens and an end mark; an empty text is
    one token long, and longer ones than the largest sequence come in pieces."""
    return packing.best_fit(packing.token_lengths(docs, bpe.vocabulary(spark, bpe.vocabulary_path())), F.col("n"))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("near dedup", near),
    ("secret scan", mask_secrets),
    ("best-fit packing", pack),
]

#: SQL can express neither the classifier nor the packing; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        was, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        forget(was)
    return STAGES[-1][1](spark, docs, sf_dir)
