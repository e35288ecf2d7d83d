"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups.

Texts are equal when identical after each run of white space became one space. Rows are grouped by the hash and the
normalised bytes themselves, so two texts that share a hash stay apart; each task merges its own copies before the
shuffle, so a text that a third of the rows hold crosses it once a task. Documents then find their group by hash and
SHA-256; that join carries no text, and AQE splits a hot group's documents. Two texts that share both digests would
be an error, never a merge.

Nulls count as empty texts; all empty texts are equal. Rows that repeat an id count as members of their group each
time; they get the same answer. An empty table gives an empty result. `exact_groups` reads only the id and the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeway.llm.common import WHITE, hash128, texts


def normalised(text: Column | str) -> Column:
    return F.regexp_replace(text, WHITE, " ")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[Column], Column] = hash128) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of df."""
    rows = texts(df, id_col, text_col).select("doc_id", normalised("text").alias("norm"))
    rows = rows.select("doc_id", content_hash(F.col("norm")).alias("h"), F.sha2("norm", 256).alias("text_sha256"), "norm")
    groups = (
        rows.groupBy("h", "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
        .groupBy("h", "text_sha256")
        .agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts"))
        .withColumn("group_size", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share both digests")).cast("long")))
        .drop("texts")
    )
    members = rows.select("doc_id", "h", "text_sha256")
    return members.join(groups, ["h", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256"
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each text, that of the smallest id, in df's columns. One shuffle; tasks merge copies before it.

    Of rows that repeat that id, the one whose raw text and other columns come first in their order stays, nulls first;
    columns without an order (maps) don't decide.
    """
    norm = normalised(F.coalesce(F.col(text_col), F.lit("")))
    ordered = [f.name for f in df.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    first = [c for c in (id_col, text_col) if c in ordered]
    names = first + [c for c in ordered if c not in first]
    # Nulls last: an id beats none.
    order = F.struct(F.col(id_col).isNull().alias("none"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    rest = [c for c in df.columns if c not in names]
    rows = df.select(norm.alias("norm"), order.alias("order"), *([F.struct(*[F.col(c).alias(f"r{i}") for i, c in enumerate(rest)]).alias("rest")] if rest else []))
    rows = rows.select(hash128(F.col("norm")).alias("h"), *rows.columns)
    best = [F.min("order").alias("order"), *([F.min_by("rest", "order").alias("rest")] if rest else [])]
    kept = rows.groupBy("h", "norm").agg(*best)
    at = {c: F.col(f"order.c{i}") for i, c in enumerate(names)} | {c: F.col(f"rest.r{i}") for i, c in enumerate(rest)}
    return kept.select(*[at[c].alias(c) for c in df.columns])


ORACLE = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM n
"""
