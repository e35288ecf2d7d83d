"""Spatial joins as equi-joins on grid cells with exact tests behind them.

A geometry goes to the cells of its bounds; two that meet share a cell. A pair that shares several is taken once, in
the cell of the lower left corner of what their bounds share, so no deduplication is needed. Cells are an ordinary
join key: both sides are shuffled by it and merged, and AQE splits a crowded cell. Nothing is broadcast: Spark's estimates
count an array as one element and a geometry's cells as one, so a side of gigabytes would pass as small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of the left side of a grid cell, in sparse joins; each meets a copy of the right side.
SPREAD = 4


def cell_of(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def snap_key(x: str, y: str, tolerance: float) -> list[Column]:
    """Columns kx, ky: coordinates as multiples of a tolerance."""
    return [F.round(F.col(x) / tolerance).cast("long").alias("kx"), F.round(F.col(y) / tolerance).cast("long").alias("ky")]


def in_cells(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> DataFrame:
    """df with columns gx, gy: a row for each grid cell that the bounds touch."""
    xs = F.sequence(cell_of(x0, size), cell_of(x1, size))
    ys = F.sequence(cell_of(y0, size), cell_of(y1, size))
    return df.withColumn("gx", F.explode(xs)).withColumn("gy", F.explode(ys))


def grid_join(left: DataFrame, right: DataFrame, lb: list[str], rb: list[str], size: float, test: Column | None = None, how: str = "inner", sparse: bool = False) -> DataFrame:
    """Pairs whose bounds (names of x0, y0, x1, y1 columns on each side) touch and that pass the test.

    Names must differ between the sides. sparse: much of the left side may lie where the right one has nothing, as lines
    outside a raster do; it is then held against the bounds of the whole right side (one row) before it goes to grid cells,
    and against the grid cells that the right side has before it is shuffled.
    """
    c = F.col
    if sparse and how == "inner":
        whole = right.agg(F.min(rb[0]).alias("__wx0"), F.min(rb[1]).alias("__wy0"), F.max(rb[2]).alias("__wx1"), F.max(rb[3]).alias("__wy1"))
        inside = (c(lb[0]) <= c("__wx1")) & (c("__wx0") <= c(lb[2])) & (c(lb[1]) <= c("__wy1")) & (c("__wy0") <= c(lb[3]))
        left = left.join(F.broadcast(whole), inside).drop("__wx0", "__wy0", "__wx1", "__wy1")
    a = in_cells(left, *(c(n) for n in lb), size)
    b = in_cells(right, *(c(n) for n in rb), size).withColumnRenamed("gx", "hx").withColumnRenamed("gy", "hy")
    if sparse and how == "inner":
        held = in_cells(right.select(*dict.fromkeys(rb)), *(c(n) for n in rb), size).select("gx", "gy").distinct()
        a = a.join(held, ["gx", "gy"], "left_semi")
        # Few bytes make many pairs here: AQE, which joins parts by bytes, would leave them all to one task.
        parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        a = a.withColumn("ga", F.pmod(F.xxhash64(*lb), F.lit(SPREAD)).cast("int")).repartition(parts, "gx", "gy", "ga")
        b = b.withColumn("gb", F.explode(F.array(*[F.lit(i) for i in range(SPREAD)]))).repartition(parts, "hx", "hy", "gb")
    touch = (c(lb[0]) <= c(rb[2])) & (c(rb[0]) <= c(lb[2])) & (c(lb[1]) <= c(rb[3])) & (c(rb[1]) <= c(lb[3]))
    first = (c("gx") == cell_of(F.greatest(lb[0], rb[0]), size)) & (c("gy") == cell_of(F.greatest(lb[1], rb[1]), size))
    on = (c("gx") == c("hx")) & (c("gy") == c("hy")) & touch & first
    on = on & (c("ga") == c("gb")) if "gb" in b.columns else on
    joined = a.join(b.hint("merge"), on if test is None else on & test, how)
    return joined.drop("gx", "gy", "hx", "hy", "ga", "gb")
