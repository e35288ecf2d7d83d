"""What the operators share: reading tables, checked column selection, white space."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeway.session import ship

#: The white space of the contracts: space and U+0009 to U+000D.
WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, through Spark's own reader."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) and nothing else: other columns, whatever their names, stay behind; a null text is empty."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def hash128(col: Column | str) -> Column:
    """The 128-bit digest of a string's bytes, as 16 bytes."""
    return F.unhex(F.md5(F.col(col).cast("binary") if isinstance(col, str) else col.cast("binary")))


#: Bits of the filter by which rows are dropped before a join, and of each row of it.
BITS, CHUNK = 1 << 25, 1 << 15


def maybe_in(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows of df whose column may be among the values of ids, a table of one column: all that are, and a few others.

    The filter that is broadcast has BITS bits, 4 MB however many values there are. Of rows that are not among n
    values, about n / BITS pass, so far beyond 30 million values it lets most rows through to the join behind it.
    """
    place = F.pmod(F.xxhash64(ids.columns[0]), F.lit(BITS))
    bits = ids.filter(F.col(ids.columns[0]).isNotNull()).select(F.floor(place / CHUNK).alias("__chunk"), F.pmod(place, F.lit(CHUNK)).alias("__bit"))
    bits = bits.groupBy("__chunk").agg(F.bitmap_construct_agg("__bit").alias("__bits"))  # at most BITS / CHUNK rows
    place = F.pmod(F.xxhash64(column), F.lit(BITS))
    at = F.pmod(place, F.lit(CHUNK))
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = df.withColumn("__chunk", F.floor(place / CHUNK)).join(F.broadcast(bits), "__chunk")
    return joined.filter(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1).select(*df.columns)


def released(results: Iterator) -> Iterator:
    """The results of a kernel; then what it has freed goes back to the system, since idle workers live on."""
    yield from results
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)
