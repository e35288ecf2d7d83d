"""Raster map algebra on tiles and cells.

A tile is a row with its cells as an array in row order; neighbourhood operators run over Arrow batches of tiles, many
at once, without a shuffle. A raster of cells is cut into tiles with a halo as wide as the neighbourhood by with_halo(),
the only shuffle, so that results do not depend on where tiles end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeway.functions import geom as g
from ridgeway.operators import kernels
from ridgeway.operators.spatial_join import grid_join


def canopy(height: Column, threshold: float) -> Column:
    """1 at or above a height, else 0; null stays."""
    return F.when(height.isNotNull(), F.when(height >= threshold, 1.0).otherwise(0.0))


def _stack(column: pa.Array, rows: int, cols: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, rows, cols)


def _lists(stack: np.ndarray) -> pa.Array:
    flat = stack.reshape(len(stack), -1)
    values = pa.array(flat.ravel(), pa.float64(), from_pandas=True)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), values)


def map_tiles(tiles: DataFrame, fn: Callable[[np.ndarray], dict[str, np.ndarray]], names: list[str], rows: int, cols: int, height: str = "h") -> DataFrame:
    """(tile, names…): new arrays from fn over stacks of tiles. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = fn(_stack(batch.column(1), rows, cols)) if batch.num_rows else {n: np.zeros((0, rows, cols)) for n in names}
            yield pa.RecordBatch.from_arrays([batch.column(0), *[_lists(made[n]) for n in names]], names=["tile", *names])

    return tiles.select("tile", height).mapInArrow(run, "tile bigint, " + ", ".join(f"{n} array<double>" for n in names))


def exploded(tiles: DataFrame, *names: str) -> DataFrame:
    """(tile, pos, names…): a row for each cell."""
    first = F.posexplode(F.arrays_zip(*names))
    return tiles.select("tile", first.alias("pos", "v")).select("tile", "pos", *[F.col("v")[n].alias(n) for n in names])


def focal_stats(tiles: DataFrame, threshold: float, radius: int, rows: int, cols: int) -> DataFrame:
    def fn(h):
        mean, std = kernels.focal(kernels.canopy_of(h, threshold), radius)
        return {"mean": mean, "std": std}

    return map_tiles(tiles, fn, ["mean", "std"], rows, cols)


def nodata_nearness(tiles: DataFrame, reach: float, rows: int, cols: int) -> DataFrame:
    return map_tiles(tiles, lambda h: {"near": kernels.nodata_nearness(h, reach)}, ["near"], rows, cols)


def cost_raster(tiles: DataFrame, rows: int, cols: int, **options) -> DataFrame:
    """(tile, cost, canopy): the whole chain of canopy, focal cover, nearness of nodata and cost."""

    def fn(h):
        cost, cover = kernels.cost_of(h, **options)
        return {"cost": cost, "canopy": cover}

    return map_tiles(tiles, fn, ["cost", "canopy"], rows, cols)


def closing(tiles: DataFrame, threshold: float, width: int, rows: int, cols: int) -> DataFrame:
    """(tile, open): 1 for cells below the threshold, after growing and shrinking by `width` cells."""
    return map_tiles(tiles, lambda h: {"open": kernels.closing(h < threshold, width)}, ["open"], rows, cols)


def accumulated(tiles: DataFrame, rows: int, cols: int, cost: Callable[[np.ndarray], np.ndarray], start: tuple[int, int], entered_only: bool = False) -> DataFrame:
    """(tile, acc): least accumulated cost from one cell of each tile."""

    def fn(h):
        m = np.zeros(h.shape, bool)
        m[:, start[0], start[1]] = True
        return {"acc": kernels.accumulate(cost(h), m, entered_only=entered_only)}

    return map_tiles(tiles, fn, ["acc"], rows, cols)


def corridors(tiles: DataFrame, rows: int, cols: int, cost: Callable[[np.ndarray], np.ndarray], source: tuple[int, int], target: tuple[int, int], threshold: float) -> DataFrame:
    """(tile, over, corridor): cost above the cheapest way's, and 0 below the threshold, else 1."""

    def fn(h):
        both = 0.0
        for p in (source, target):
            m = np.zeros(h.shape, bool)
            m[:, p[0], p[1]] = True
            both = both + kernels.accumulate(cost(h), m)
        both = np.where(np.isfinite(both), both, np.nan)
        over = both - np.nanmin(both, axis=(1, 2), keepdims=True) if len(h) else both
        return {"over": over, "corridor": np.where(np.isnan(over), np.nan, (over >= threshold).astype(float))}

    return map_tiles(tiles, fn, ["over", "corridor"], rows, cols)


def components(tiles: DataFrame, threshold: float, rows: int, cols: int) -> DataFrame:
    """(tile, label): for cells below the threshold the smallest cell number of their 4-connected component."""

    def fn(h):
        label = kernels.label4(h < threshold).astype(float)
        return {"label": np.where(label < 0, np.nan, label)}

    return map_tiles(tiles, fn, ["label"], rows, cols)


def polygons(tiles: DataFrame, threshold: float, rows: int, cols: int) -> DataFrame:
    """(tile, label, rings): components as rings of cell corners; the first is the outer one."""

    def run(batches):
        for batch in batches:
            out = {"tile": [], "label": [], "rings": []}
            for tile, h in zip(batch.column(0).to_pylist(), _stack(batch.column(1), rows, cols)):
                label = kernels.label4(h < threshold)
                for n in np.unique(label[label >= 0]):
                    out["tile"].append(tile)
                    out["label"].append(int(n))
                    out["rings"].append([[{"x": float(c), "y": float(r)} for r, c in ring] for ring in kernels.trace_rings(label == n)])
            point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["tile"], pa.int64()), pa.array(out["label"], pa.int64()), pa.array(out["rings"], pa.list_(pa.list_(point)))], names=["tile", "label", "rings"]
            )

    return tiles.select("tile", "h").mapInArrow(run, f"tile bigint, label bigint, rings array<{g.LINE}>")


def with_halo(cells: DataFrame, size: int, halo: int) -> DataFrame:
    """(trow, tcol, row, col, h): each cell for its own tile and for those that have it in their halo."""
    spread = lambda c: F.sequence(F.floor((F.col(c) - halo) / size), F.floor((F.col(c) + halo) / size))
    return cells.select("row", "col", "h", F.explode(spread("row")).alias("trow")).select("*", F.explode(spread("col")).alias("tcol"))


def focal_mosaic(cells: DataFrame, threshold: float, radius: int, size: int = 64) -> DataFrame:
    """(row, col, mean, std) over a raster of cells; at its edge the nearest cell counts. Cells of the raster's bounds that are missing are nodata."""
    span = cells.agg(*[f(c).alias(f"{f.__name__}{c}") for f in (F.min, F.max) for c in ("row", "col")]).first()
    if span[0] is None:
        return cells.select("row", "col", F.lit(0.0).alias("mean"), F.lit(0.0).alias("std"))
    r0, c0, r1, c1 = span

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        top, left = max(int(key[0]) * size - radius, r0), max(int(key[1]) * size - radius, c0)
        bottom, right = min((int(key[0]) + 1) * size + radius, r1 + 1), min((int(key[1]) + 1) * size + radius, c1 + 1)
        if bottom <= top or right <= left:
            return pd.DataFrame({"row": [], "col": [], "mean": [], "std": []})
        h = np.full((bottom - top, right - left), np.nan)
        h[frame["row"].to_numpy() - top, frame["col"].to_numpy() - left] = frame["h"].to_numpy(float)
        mean, std = kernels.focal(kernels.canopy_of(h, threshold), radius)
        own = frame[(frame["row"] // size == key[0]) & (frame["col"] // size == key[1])]
        r, c = own["row"].to_numpy(), own["col"].to_numpy()
        return pd.DataFrame({"row": r, "col": c, "mean": mean[r - top, c - left], "std": std[r - top, c - left]})

    return with_halo(cells, size, radius).groupBy("trow", "tcol").applyInPandas(run, "row bigint, col bigint, mean double, std double")


def clip(cells: DataFrame, lines: DataFrame, buffer: float, size: float = 32.0) -> DataFrame:
    """(id, x1, y1, x2, y2, row, col, x, y, h): the cells whose centres are within a distance of each two-point line."""
    a = lines.select(
        "id", "x1", "y1", "x2", "y2",
        (F.least("x1", "x2") - buffer).alias("bx0"), (F.least("y1", "y2") - buffer).alias("by0"), (F.greatest("x1", "x2") + buffer).alias("bx1"), (F.greatest("y1", "y2") + buffer).alias("by1"),
    )
    c = F.col
    near = g.segment_distance2(c("x"), c("y"), c("x1"), c("y1"), c("x2"), c("y2")) <= buffer * buffer
    met = grid_join(a, cells.select("row", "col", "x", "y", "h"), ["bx0", "by0", "bx1", "by1"], ["x", "y", "x", "y"], size, near, sparse=True)
    return met.drop("bx0", "by0", "bx1", "by1")


def clip_polygons(cells: DataFrame, rectangles: DataFrame, ring: Column, size: float = 32.0) -> DataFrame:
    """(id, row, col, x, y, h): the cells whose centres are inside each polygon; rectangles has its bounds x0, y0, x1, y1."""
    a = rectangles.withColumn("ring", ring)
    inside = g.in_ring(F.col("ring"), F.col("x"), F.col("y"))
    met = grid_join(a, cells.select("row", "col", "x", "y", "h"), ["x0", "y0", "x1", "y1"], ["x", "y", "x", "y"], size, inside, sparse=True)
    return met.select("id", "row", "col", "x", "y", "h")


def histogram_threshold(cells: DataFrame, key: str = "tile", value: str = "h", bins: int = 100, low: float = 0.0, high: float = 100.0) -> DataFrame:
    """(key, threshold): the lower edge of the last bin before the cumulative count passes half; -1 if the first passes."""
    from pyspark.sql import Window as W

    width = (high - low) / bins
    b = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    counted = cells.filter((F.col(value) >= low) & (F.col(value) <= high)).groupBy(key, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(key)
    run = counted.select(key, "bin", F.sum("n").over(w.orderBy("bin")).alias("upto"), F.sum("n").over(w).alias("all"))
    first = run.filter(F.col("upto") > F.col("all") / 2).groupBy(key).agg(F.min("bin").alias("b"))
    return first.select(key, F.when(F.col("b") == 0, -1.0).otherwise(low + (F.col("b") - 1) * width).alias("threshold"))
