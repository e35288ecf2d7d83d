"""The queries of this subpackage, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeway.llm import bpe, classifier, exact_dedup, licenses, line_dedup, near_dedup, packing, secrets, token_files, topk
from ridgeway.llm.bpe import vocabulary_path
from ridgeway.llm.common import table
from ridgeway.session import fresh_path


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.span_digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), bpe.vocabulary(spark, vocabulary_path()))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.integer_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), licenses.known_table(spark))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = packing.token_lengths(table(spark, sf_dir, "documents"), bpe.vocabulary(spark, vocabulary_path()))
    return packing.best_fit(lengths, F.col("n"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), bpe.vocabulary(spark, vocabulary_path()), path)
    return token_files.count_tokens(spark, path).select("doc_id", "n_tokens", "file", "doc_no", "start")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = line_dedup.line_report(table(spark, sf_dir, "documents"), distance=None)
    return report.select("doc_id", "n_lines", (F.col("n_lines") - F.size("dropped")).alias("n_kept"), F.array_join(F.transform("dropped", lambda x: x.cast("string")), ",").alias("dropped"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_secrets": op1_secrets, "op2_bpe": op2_bpe, "op3_top_k": op3_top_k, "op4_licenses": op4_licenses, "op5_packing": op5_packing, "op6_token_counts": op6_token_counts, "op7_quality": op7_quality, "op8_exact_dedup": op8_exact_dedup, "op9_near_dedup": op9_near_dedup, "op10_line_dedup": op10_line_dedup}


def oracle_sql() -> dict[str, str]:
    return {"op3_top_k": topk.ORACLE, "op4_licenses": licenses.ORACLE, "op8_exact_dedup": exact_dedup.ORACLE}
