"""Lines that arrive as a stream: every micro-batch is cleaned and cut into segments, and lands in a folder of its own.

A batch that is run again after a failure overwrites its folder, so each line is stored once. The stored layer is the
same as that of all lines taken at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ridgeway.operators import lines


def ingest_lines(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start storing a stream of lines (id, pts, …); with `once`, what is there now."""

    def store(batch: DataFrame, number: int) -> None:
        lines.explode_segments(lines.clean_lines(batch)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stored_segments(spark: SparkSession, path: str) -> DataFrame:
    """All segments stored so far."""
    return spark.read.parquet(path).drop("batch")
