"""The filter that stands before joins by id, and the wrapper of kernels."""

from pyspark.sql import functions as F

from ridgeway.llm.common import maybe_in, released


def test_the_filter_keeps_all_that_are_asked_for(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") > 0, F.col("id")).alias("x"), F.lit("t").alias("__text"))
    asked = spark.range(0, 40_000, 7).select(F.when(F.col("id") > 0, F.col("id")).alias("y"))
    got = maybe_in(rows, "x", asked.union(asked))
    assert got.columns == rows.columns
    kept = [r.x for r in got.collect() if r.x is not None]
    assert len(kept) == len(set(kept)) and set(kept) >= set(range(7, 20_000, 7))
    assert len(kept) < 3_000 + 100
    assert maybe_in(rows, "x", asked.filter("y < 0")).count() == 0


def test_released_passes_results_on():
    assert list(released(iter([1, 2, 3]))) == [1, 2, 3] and list(released(iter(()))) == []
