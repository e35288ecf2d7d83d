"""Widths of polygons across lines, footprints as sets of cells, and trimming them where lines meet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeway.functions import geom as g
from ridgeway.operators import kernels, lines, topology
from ridgeway.operators.components import roots
from ridgeway.operators.spatial_join import grid_join
from ridgeway.session import written

#: The width of a line without any, and the share of a line below which a part of it goes.
DEFAULT_WIDTH, SMALL_PART, TRIM_NEAR, TRIM_FAR, SHORT_LINE, TRANSECT = 5.0, 0.15, 50.0, 75.0, 100.0, 40.0


def crossing_shares(edges: Column, a: Column, b: Column) -> Column:
    """Where a-b crosses the edges of a ring, in shares of its length, sorted, with 0 and 1."""

    def hit(s):
        dx, dy, ex, ey = b["x"] - a["x"], b["y"] - a["y"], s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        d = dx * ey - dy * ex
        fx, fy = s["a"]["x"] - a["x"], s["a"]["y"] - a["y"]
        t, u = (fx * ey - fy * ex) / F.when(d != 0, d), (fx * dy - fy * dx) / F.when(d != 0, d)
        return F.when((u >= 0) & (u <= 1) & (t > 0) & (t < 1), t)

    hits = F.filter(F.transform(edges, hit), lambda t: t.isNotNull())
    return F.array_sort(F.concat(F.array(F.lit(0.0)), hits, F.array(F.lit(1.0))))


def inside_pieces(df: DataFrame, edges: str, a: str, b: str, name: str = "pieces") -> DataFrame:
    """df with array<struct<from,to>>: the stretches of a-b, in shares of its length, inside a ring given by its edges.

    Steps are columns of their own, so that none is evaluated twice.
    """
    c = F.col
    df = df.withColumn("__cuts", crossing_shares(c(edges), c(a), c(b)))
    n = F.size("__cuts") - 1
    df = df.withColumn("__pieces", F.zip_with(F.slice("__cuts", F.lit(1), n), F.slice("__cuts", F.lit(2), n), lambda s, e: F.struct(s.alias("from"), e.alias("to"))))
    at = lambda p, k: c(a)[k] + (c(b)[k] - c(a)[k]) * (p["from"] + p["to"]) / 2
    inside = F.filter("__pieces", lambda p: (p["to"] > p["from"]) & g.in_edges(c(edges), at(p, "x"), at(p, "y")))
    return df.withColumn(name, inside).drop("__cuts", "__pieces")


def lines_by_polygons(left: DataFrame, polygons: DataFrame, size: float = 32.0) -> DataFrame:
    """(id, poly_id): lines (id, pts) and polygons (id, ring) whose bounds touch; with bt_group on both sides, of one group only."""
    a = left.withColumn("b", g.bounds(F.col("pts"))).select("id", *[c for c in ("bt_group",) if c in left.columns], *[F.col(f"b.{c}").alias(f"l{c}") for c in ("x0", "y0", "x1", "y1")])
    p = polygons.withColumn("b", g.bounds(F.col("ring"))).select(F.col("id").alias("poly_id"), *[F.col("bt_group").alias("poly_group") for _ in (1,) if "bt_group" in polygons.columns], *[F.col(f"b.{c}").alias(f"p{c}") for c in ("x0", "y0", "x1", "y1")])
    same = F.col("bt_group") == F.col("poly_group") if "bt_group" in a.columns and "poly_group" in p.columns else None
    return grid_join(a, p, ["lx0", "ly0", "lx1", "ly1"], ["px0", "py0", "px1", "py1"], size, same).select("id", "poly_id")


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float = 32.0) -> DataFrame:
    """points (with x, y) joined to the ids of the polygons (id, ring) that they are inside of."""
    p = polygons.withColumn("b", g.bounds(F.col("ring"))).select(F.col("id").alias("poly_id"), "ring", *[F.col(f"b.{c}").alias(f"p{c}") for c in ("x0", "y0", "x1", "y1")])
    met = grid_join(points, p, ["x", "y", "x", "y"], ["px0", "py0", "px1", "py1"], size, g.in_ring(F.col("ring"), F.col("x"), F.col("y")))
    return met.drop("ring", "px0", "py0", "px1", "py1")


def transect_widths(left: DataFrame, polygons: DataFrame, offset: float = 30.0, size: float = 64.0, zeros: bool = True) -> DataFrame:
    """(id, i, width): at each interior point of a line the longest stretch of its transect inside one polygon.

    A transect that meets no polygon has width 0, or no row where `zeros` is false, which saves a second pass over the
    lines. With bt_group on both sides only polygons of the line's group count. One shuffle by line after the grid join,
    which percentiles of a line's widths share.
    """
    grouped = "bt_group" in left.columns and "bt_group" in polygons.columns
    t = lines.transects(left.select("id", "pts"), offset)
    c = F.col
    t = t.select("id", "i", c("t.a").alias("a"), c("t.b").alias("b"))
    box = t.select("*", F.least("a.x", "b.x").alias("tx0"), F.least("a.y", "b.y").alias("ty0"), F.greatest("a.x", "b.x").alias("tx1"), F.greatest("a.y", "b.y").alias("ty1"))
    if grouped:
        box = box.join(left.select("id", "bt_group"), "id")
    p = polygons.withColumn("box", g.bounds(c("ring"))).withColumn("edges", g.segments(c("ring")))
    p = p.select("edges", *[c("bt_group").alias("poly_group") for _ in (1,) if grouped], *[c(f"box.{n}").alias(f"p{n}") for n in ("x0", "y0", "x1", "y1")])
    same = c("bt_group") == c("poly_group") if grouped else None
    met = inside_pieces(grid_join(box, p, ["tx0", "ty0", "tx1", "ty1"], ["px0", "py0", "px1", "py1"], size, same), "edges", "a", "b")
    longest = F.array_max(F.transform("pieces", lambda s: s["to"] - s["from"]))
    pieces = met.select("id", "i", (longest * g.point_distance(c("a"), c("b"))).alias("w"))
    if not zeros:
        parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return pieces.repartition(parts, "id").groupBy("id", "i").agg(F.max("w").alias("width"))
    widths = pieces.groupBy("id", "i").agg(F.max("w").alias("w"))
    return t.select("id", "i").join(widths, ["id", "i"], "left").select("id", "i", F.coalesce("w", F.lit(0.0)).alias("width"))


def containing_polygon(left: DataFrame, polygons: DataFrame, buffer: float = 1.0, size: float = 32.0) -> DataFrame:
    """(id, poly_id): of the polygons (id, ring) that hold a line (id, pts) wholly, to within `buffer`, the one of the
    smallest id. Lines are tested at their points and at stations no further apart than the buffer."""
    c = F.col
    a = left.filter(F.size("pts") >= 2).withColumn("b", g.bounds(c("pts"))).select(c("id").alias("line"), "pts", *[c(f"b.{n}").alias(f"l{n}") for n in ("x0", "y0", "x1", "y1")])
    p = polygons.withColumn("b", g.bounds(c("ring")))
    p = p.select(c("id").alias("poly_id"), "ring", *[(c(f"b.{n}") + (buffer if n[1] == "1" else -buffer)).alias(f"p{n}") for n in ("x0", "y0", "x1", "y1")])
    within = (c("px0") <= c("lx0")) & (c("py0") <= c("ly0")) & (c("px1") >= c("lx1")) & (c("py1") >= c("ly1"))
    met = grid_join(a, p, ["lx0", "ly0", "lx1", "ly1"], ["px0", "py0", "px1", "py1"], size, within)
    met = met.select("line", "poly_id", "pts", g.segments(c("ring")).alias("edges"))
    away = lambda q: F.array_min(F.transform("edges", lambda e: g.segment_distance2(q["x"], q["y"], e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"])))
    held = lambda pts: F.forall(pts, lambda q: g.in_edges(c("edges"), q["x"], q["y"]) | (away(q) <= buffer * buffer))
    # Stations are made of the pairs whose own points pass: shuffled with the lines they would be many times as much. Tests
    # are exploded, not filtered by, as a filter would go into the join, and the edges be made anew for every point.
    met = met.select("line", "pts", "edges", F.explode(F.when(held(c("pts")), F.array("poly_id"))).alias("poly_id"))
    met = met.select("line", "edges", "poly_id", lines.dense(c("pts"), buffer).alias("pts"))
    met = met.select("line", F.explode(F.when(held(c("pts")), F.array("poly_id"))).alias("poly_id"))
    return met.groupBy(c("line").alias("id")).agg(F.min("poly_id").alias("poly_id"))


def line_widths(left: DataFrame, widths: DataFrame, percentile: float = 75.0) -> DataFrame:
    """(id, avg_width, max_width, n_widths): percentiles of a line's widths above 0; a line without any has the default."""
    w = widths.filter(F.col("width") > 1e-9).groupBy("id").agg(F.percentile("width", F.lit(percentile / 100)).alias("a"), F.percentile("width", F.lit(0.9)).alias("m"), F.count(F.lit(1)).alias("n"))
    return left.select("id").join(w, "id", "left").select(
        "id", F.coalesce("a", F.lit(DEFAULT_WIDTH)).alias("avg_width"), F.coalesce("m", F.lit(DEFAULT_WIDTH)).alias("max_width"), F.coalesce("n", F.lit(0)).cast("long").alias("n_widths")
    )


def group_max(df: DataFrame, group: str = "bt_group", names: tuple[str, ...] = ("avg_width", "max_width")) -> DataFrame:
    """df with each of its widths replaced by the largest in its group: an aggregation that combines first, then a join on the group."""
    most = df.groupBy(group).agg(*[F.max(n).alias(n) for n in names])
    return df.drop(*names).join(most, group)


def imputed(df: DataFrame, *names: str) -> DataFrame:
    """df with nulls, nans and zeros of some columns replaced by the mean over all rows that have a value, zeros included."""
    value = lambda n: F.when(~F.isnan(F.col(n).cast("double")), F.col(n).cast("double"))
    means = df.agg(*[F.avg(value(n)).alias(f"__{n}") for n in names])
    out = df.join(F.broadcast(means))  # one row
    for n in names:
        out = out.withColumn(n, F.when(value(n).isNull() | (value(n) == 0), F.col(f"__{n}")).otherwise(value(n)))
    return out.drop(*[f"__{n}" for n in names])


#: Cells that a kernel tests at a time, about.
_CELLS = 1 << 20


def capsule_cells(ax, ay, bx, by, r, cell: float = 1.0, within: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment number, row, col): the cells whose centres are within r of each segment. Each row of cells is looked at
    only where the segment comes near it, so a long slanting segment costs its length times r, not its bounds.

    within: (row, col, side), the corner of a square of cells for each segment, outside which none is looked at.
    """
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    first = np.floor((np.minimum(ay, by) - r) / cell).astype(np.int64)
    end = np.floor((np.maximum(ay, by) + r) / cell).astype(np.int64) + 1
    if within is not None:
        first, end = np.maximum(first, within[0]), np.minimum(end, within[0] + within[2])
    rows = np.maximum(end - first, 0)
    seg = np.repeat(np.arange(len(ax)), rows)
    row = first[seg] + np.arange(len(seg)) - np.repeat(np.cumsum(rows) - rows, rows)
    y = (row + 0.5) * cell
    with np.errstate(divide="ignore", invalid="ignore"):  # the shares of the segment that are within r of the row's middle
        one, two = (y - r[seg] - ay[seg]) / dy[seg], (y + r[seg] - ay[seg]) / dy[seg]
    flat = dy[seg] == 0
    lo = np.where(flat, 0.0, np.clip(np.minimum(one, two), 0, 1))
    hi = np.where(flat, 1.0, np.clip(np.maximum(one, two), 0, 1))
    x0, x1 = ax[seg] + dx[seg] * lo, ax[seg] + dx[seg] * hi
    left = np.floor((np.minimum(x0, x1) - r[seg]) / cell).astype(np.int64) - 1
    end = np.floor((np.maximum(x0, x1) + r[seg]) / cell).astype(np.int64) + 2
    if within is not None:
        left, end = np.maximum(left, within[1][seg]), np.minimum(end, within[1][seg] + within[2])
    cols = np.maximum(end - left, 0)
    at = np.repeat(np.arange(len(seg)), cols)
    col = left[at] + np.arange(len(at)) - np.repeat(np.cumsum(cols) - cols, cols)
    seg, row = seg[at], row[at]
    px, py = (col + 0.5) * cell, (row + 0.5) * cell
    with np.errstate(divide="ignore", invalid="ignore"):
        t = ((px - ax[seg]) * dx[seg] + (py - ay[seg]) * dy[seg]) / n[seg]
    t = np.where(n[seg] > 0, np.clip(t, 0.0, 1.0), 0.0)
    x, y = ax[seg] + dx[seg] * t - px, ay[seg] + dy[seg] * t - py
    near = x * x + y * y <= r[seg] * r[seg]
    return seg[near], row[near], col[near]


def _buffered(batches: Iterator[pa.RecordBatch], cell: float, keep: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    """The cells of rows (id, pts, r, those to keep); a line's own segments don't repeat a cell."""

    def done(batch, of, starts, ends, r):
        line = np.repeat(np.arange(len(of)), [len(x) for x in starts])
        a, b = np.concatenate(starts), np.concatenate(ends)
        seg, row, col = capsule_cells(a[:, 0], a[:, 1], b[:, 0], b[:, 1], np.asarray(r, float)[line], cell)
        owner = line[seg]
        order = np.lexsort((col, row, owner))
        owner, row, col = owner[order], row[order], col[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (row[1:] != row[:-1]) | (col[1:] != col[:-1])
        whose = pa.array(np.asarray(of, np.int64)[owner[new]])
        kept = [batch.column(n).take(whose) for n in ("id", *keep)]
        return pa.RecordBatch.from_arrays([kept[0], pa.array(row[new]), pa.array(col[new]), *kept[1:]], names=["id", "row", "col", *keep])

    for batch in batches:
        of, starts, ends, radii, size = [], [], [], [], 0.0
        flat = batch.column("pts").flatten()
        xy = np.stack([flat.field("x").to_numpy(zero_copy_only=False), flat.field("y").to_numpy(zero_copy_only=False)], 1)
        at = np.concatenate([[0], np.cumsum(batch.column("pts").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))])
        for i, (key, r) in enumerate(zip(batch.column("id").to_pylist(), batch.column("r").to_pylist())):
            pts = xy[at[i] : at[i + 1]]
            if key is None or r is None or len(pts) < 2:
                continue
            some = (pts[1:] != pts[:-1]).any(axis=1)
            of.append(i)
            starts.append(pts[:-1][some])
            ends.append(pts[1:][some])
            radii.append(r)
            size += (np.abs(ends[-1] - starts[-1]).sum() + 2 * r * len(starts[-1])) * (2 * r + cell) / cell**2
            if size > _CELLS:
                yield done(batch, of, starts, ends, radii)
                of, starts, ends, radii, size = [], [], [], [], 0.0
        if of:
            yield done(batch, of, starts, ends, radii)


def buffered_cells(left: DataFrame, radius: str, cell: float = 1.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, row, col, columns to keep): cells whose centres are within each line's radius (a column), without a shuffle.
    Made from the lines alone, no raster is read. Ids name lines: rows that repeat an id each give their cells.

    What cells need of their line is kept here: there are hundreds of them a line, which Spark's estimates don't know,
    so that a join of cells with lines afterwards may broadcast the cells.
    """
    rows = left.select(F.col("id").cast("long").alias("id"), "pts", F.col(radius).cast("double").alias("r"), *keep)
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in left.select(*keep).schema) if keep else ""
    return rows.mapInArrow(lambda it: _buffered(it, cell, keep), f"id bigint, row bigint, col bigint{kinds}")


def dissolve_cells(cells: DataFrame, group: str, first: str | None = None) -> DataFrame:
    """(group, row, col, first): the union of the cells of each group; with `first` the least value of that column in each cell."""
    if first is None:
        return cells.select(group, "row", "col").distinct()
    return cells.groupBy(group, "row", "col").agg(F.min(first).alias(first))


#: Cells of a side of the squares by which the segments of a group are dealt to tasks; segments and cells (as many as the
#: processor's cache holds) at a time.
TILE, _SEGMENTS, _UNITED = 256, 1 << 14, 1 << 16


def _squares(batches: Iterator[pa.RecordBatch], cell: float) -> Iterator[pa.RecordBatch]:
    """The segments of rows (grp, id, pts, r), once for each square of TILE cells, by the corner, that may have cells of theirs."""
    size = TILE * cell
    for batch in batches:
        flat, lengths = batch.column("pts").flatten(), batch.column("pts").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        x, y = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("x", "y"))
        line = np.repeat(np.arange(len(lengths)), lengths.astype(np.int64))
        r, named = batch.column("r").to_numpy(zero_copy_only=False).astype(float), batch.column("id").is_valid().to_numpy(zero_copy_only=False)
        at = np.flatnonzero(line[1:] == line[:-1])
        at = at[((x[at] != x[at + 1]) | (y[at] != y[at + 1])) & named[line[at]]]
        at = at[np.isfinite(x[at] + y[at] + x[at + 1] + y[at + 1] + r[line[at]])]
        for part in np.split(at, range(_SEGMENTS, len(at), _SEGMENTS)):
            ax, ay, bx, by, of = x[part], y[part], x[part + 1], y[part + 1], line[part]
            seg, row, col = capsule_cells(ax, ay, bx, by, r[of] + 0.75 * size, size)
            # A long slanting segment leaves out most squares of its bounds, a short one has narrower bounds than surroundings.
            reach = r[of] + cell
            near = np.ones(len(seg), bool)
            for a, b, low in ((ax, bx, col * size), (ay, by, row * size)):
                near &= ((np.minimum(a, b) - reach)[seg] <= low + size) & ((np.maximum(a, b) + reach)[seg] >= low)
            seg, row, col = seg[near], row[near] * TILE, col[near] * TILE
            of = pa.array(of[seg])
            columns = [batch.column("grp").take(of), pa.array(row), pa.array(col), batch.column("id").take(of), batch.column("r").take(of)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(v[seg]) for v in (ax, ay, bx, by))], names=["grp", "row", "col", "id", "r", "ax", "ay", "bx", "by"])


def _united(batches: Iterator[pa.RecordBatch], cell: float) -> Iterator[pa.RecordBatch]:
    """From rows of `_squares` sorted by grp, row and col: (grp, row, col, cells, first) of each square with cells.

    Besides some segments only the union of one square is held, however many segments have cells in it.
    """

    def some():
        for batch in batches:
            ax, ay, bx, by, r = (batch.column(n).to_numpy() for n in ("ax", "ay", "bx", "by", "r"))
            length = np.minimum((np.abs(bx - ax) + np.abs(by - ay)) / cell, 2 * TILE)
            size = np.cumsum((length + np.minimum(2 * r / cell, TILE)) * np.minimum(2 * r / cell + 1, TILE))
            edges = [0, *(np.flatnonzero(np.diff(size // _UNITED)) + 1).tolist(), len(r)]
            yield from (batch.slice(i, j - i) for i, j in zip(edges, edges[1:]) if j > i)

    def told(batch, begins, cells, ends, first):
        full = np.flatnonzero(np.diff(ends))
        lists = pa.ListArray.from_arrays(pa.array(np.append(ends[full], ends[-1]).astype(np.int32)), pa.array(cells.astype(np.int32)))
        whose = pa.array(begins[full])
        return pa.RecordBatch.from_arrays([*(batch.column(n).take(whose) for n in ("grp", "row", "col")), lists, pa.array(first[full])], names=["grp", "row", "col", "cells", "first"])

    def named(batch, i):
        grp = batch.column("grp")[i].as_py()
        return (None if grp != grp else ("", grp)), batch.column("row")[i].as_py(), batch.column("col")[i].as_py()

    last, cells, first = None, None, None  # the square that may go on: a batch of one row, its cells, the least id
    for batch in some():
        row, col, ids = (batch.column(n).to_numpy() for n in ("row", "col", "id"))
        grp = batch.column("grp").dictionary_encode(null_encoding="encode").indices.to_numpy()
        begins = np.flatnonzero(np.append(True, (grp[1:] != grp[:-1]) | (row[1:] != row[:-1]) | (col[1:] != col[:-1])))
        unit = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(row))))
        seg, r, c = capsule_cells(*(batch.column(n).to_numpy() for n in ("ax", "ay", "bx", "by", "r")), cell, (row, col, TILE))
        key = (unit[seg] * TILE + r - row[seg]) * TILE + c - col[seg]
        least = np.full(len(begins), np.iinfo(np.int64).max)
        met = seg[np.flatnonzero(np.diff(seg, prepend=-1))]
        np.minimum.at(least, unit[met], ids[met])
        if last is not None and named(last, 0) == named(batch, 0):
            key, least[0] = np.append(key, cells), min(least[0], first)
        elif last is not None:
            yield told(last, np.zeros(1, np.int64), cells, np.array([0, len(cells)]), np.array([first]))
        key.sort()
        key = key[np.diff(key, prepend=-1) != 0]
        ends = np.searchsorted(key, np.arange(len(begins) + 1) * TILE**2)
        cells = key % TILE**2
        if len(begins) > 1:
            yield told(batch, begins[:-1], cells[: ends[-2]], ends[:-1], least[:-1])
        last, cells, first = batch.slice(begins[-1], 1), cells[ends[-2] :], least[-1]
    if last is not None:
        yield told(last, np.zeros(1, np.int64), cells, np.array([0, len(cells)]), np.array([first]))


def dissolve_lines(left: DataFrame, radius: str, group: str, cell: float = 1.0) -> DataFrame:
    """(group, row, col, cells, first): the union of the cells within each line's radius (a column) of each group, in squares
    of TILE by TILE cells whose corner is at row and col; cells are numbered row by row in their square, from 0. first: the
    least id of the lines that have cells in the square.

    Segments are dealt to tasks, by group and square, and no cells: a line has hundreds of these.
    """
    rows = left.select(F.col(group).alias("grp"), F.col("id").cast("long").alias("id"), "pts", F.col(radius).cast("double").alias("r"))
    kind = rows.schema["grp"].dataType.simpleString()
    segments = rows.mapInArrow(lambda it: _squares(it, cell), f"grp {kind}, row bigint, col bigint, id bigint, r double, ax double, ay double, bx double, by double")
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = segments.repartition(parts, "grp", "row", "col").sortWithinPartitions("grp", "row", "col")
    return dealt.mapInArrow(lambda it: _united(it, cell), f"grp {kind}, row bigint, col bigint, cells array<int>, first bigint").withColumnRenamed("grp", group)


def split_valid(layer: DataFrame, parts: str) -> dict[str, DataFrame]:
    """valid: rows with a geometry; invalid: those of more than one part."""
    return {"valid": layer.filter(F.col(parts).isNotNull() & (F.size(parts) > 0)), "invalid": layer.filter(F.size(parts) > 1)}


def valid_results(results: DataFrame, geometry: str) -> DataFrame:
    """The results of a tool less those without anything in them: null, or an empty array or string."""
    kind = results.schema[geometry].dataType.simpleString()
    size = F.size(geometry) if kind.startswith(("array", "map")) else F.length(geometry) if kind in ("string", "binary") else F.lit(1)
    return results.filter(F.col(geometry).isNotNull() & (size > 0))


def concat_layers(*layers: DataFrame) -> DataFrame:
    """All rows of all layers; columns that a layer lacks are null."""
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionByName(layer, allowMissingColumns=True)
    return out


def cut_ring(ring: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """A closed ring cut by a segment that crosses it exactly twice, as two rings; else the ring alone."""
    a, d = np.asarray(a, float), np.asarray(b, float) - np.asarray(a, float)
    hits = []
    for i in range(len(ring) - 1):
        p, e = ring[i], ring[i + 1] - ring[i]
        den = d[0] * e[1] - d[1] * e[0]
        if den == 0:
            continue
        f = p - a
        t, u = (f[0] * e[1] - f[1] * e[0]) / den, (f[0] * d[1] - f[1] * d[0]) / den
        if 0 <= t <= 1 and 0 <= u < 1:
            hits.append((i, u, a + t * d))
    if len(hits) != 2:
        return [ring]
    (i, _, p), (j, _, q) = sorted(hits, key=lambda h: (h[0], h[1]))
    one = np.concatenate([[p], ring[i + 1 : j + 1], [q], [p]])
    two = np.concatenate([[q], ring[j + 1 : -1], ring[: i + 1], [p], [q]])
    return [one, two]


def ring_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return abs(float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum())) / 2


def trim_ring(ring: np.ndarray, transect) -> np.ndarray:
    """The larger part of a ring that a transect cuts in two; the ring itself where it doesn't."""
    return max(cut_ring(ring, *transect), key=ring_area) if transect is not None else ring


def trim_ends(footprints: DataFrame, table: DataFrame, left: DataFrame) -> DataFrame:
    """(id, ring): the footprint of each line cut by the end transects at its unconnected ends, the larger part kept.

    footprints: (id, ring) of the line with that id; table: topology.vertex_table(). Ends are taken in order (0, -1).
    """
    c = F.col
    loose = table.filter(F.size("not_connected") > 0).select(F.explode("ends").alias("e"), "not_connected").filter(F.array_contains("not_connected", c("e.id"))).select(c("e.id").alias("id"), c("e.end").alias("end"))
    e = lines.ends(left.select("id", "pts")).select("id", "end", g.end_transect(c("p"), c("q"), TRANSECT).alias("t"))
    cuts = loose.join(e, ["id", "end"]).groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-c("end")).alias("n"), "t"))).alias("cuts"))
    rows = footprints.join(cuts, "id", "left").select("id", "ring", "cuts")

    def run(frames):
        for frame in frames:
            out = []
            for ring, todo in zip(frame["ring"], frame["cuts"]):
                r = np.array([(p["x"], p["y"]) for p in ring])
                for cut in todo if todo is not None else []:
                    t = cut["t"]
                    if t is not None:
                        r = trim_ring(r, ((t["a"]["x"], t["a"]["y"]), (t["b"]["x"], t["b"]["y"])))
                out.append([{"x": float(x), "y": float(y)} for x, y in r])
            yield pd.DataFrame({"id": frame["id"], "ring": out})

    return rows.mapInPandas(run, f"id bigint, ring {g.LINE}")


def cut_cells(rows: np.ndarray, cols: np.ndarray, a, b, cell: float = 1.0) -> np.ndarray:
    """Which cells stay when a segment cuts a footprint: those of the larger part where it makes one part more; else all."""
    return cut_many(np.zeros(len(rows), np.int64), rows, cols, np.array([[*a, *b]], float), cell)


def cut_many(of: np.ndarray, rows: np.ndarray, cols: np.ndarray, cuts: np.ndarray, cell: float = 1.0) -> np.ndarray:
    """cut_cells() of many footprints at once: of has the number of a cell's footprint, cuts a segment (ax, ay, bx, by) for each.

    Cells are nodes, sorted by footprint, row and column, steps between neighbours edges; of parts as large the first goes.
    """
    n = len(cuts)
    r0, c0 = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(r0, of, rows)
    np.minimum.at(c0, of, cols)
    r, k = rows - r0[of], cols - c0[of]
    high, wide = int(r.max(initial=0)) + 2, int(k.max(initial=0)) + 2  # a free row and column between footprints
    nodes, at, weight = np.unique((of * high + r) * wide + k, return_inverse=True, return_counts=True)
    foot, y, x = nodes // (high * wide), nodes // wide % high, nodes % wide
    ax, bx = (v / cell - 0.5 - c0 for v in (cuts[:, 0], cuts[:, 2]))  # in cells, centres whole
    ay, by = (v / cell - 0.5 - r0 for v in (cuts[:, 1], cuts[:, 3]))
    dx, dy = bx - ax, by - ay
    u, v, whole = [], [], []
    for step, ex, ey in ((1, 1.0, 0.0), (wide, 0.0, 1.0)):
        found = np.minimum(np.searchsorted(nodes, nodes + step), max(len(nodes) - 1, 0))
        one = np.flatnonzero(nodes[found] == nodes + step)
        f, px, py = foot[one], x[one], y[one]
        side = lambda x, y: dx[f] * (y - ay[f]) - dy[f] * (x - ax[f]) >= 0  # noqa: B023, E731
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((px - ax[f]) * ey - (py - ay[f]) * ex) / (dx[f] * ey - dy[f] * ex)
        u.append(one)
        v.append(found[one])
        whole.append((side(px, py) == side(px + ex, py + ey)) | ~((t >= 0) & (t <= 1)))
    u, v, whole = (np.concatenate(z) for z in (u, v, whole))
    before, after = roots(len(nodes), u, v), roots(len(nodes), u[whole], v[whole])
    number = np.arange(len(nodes))
    parts = lambda label: np.bincount(foot[label == number], minlength=n)
    tops = np.flatnonzero((after == number) & (parts(after) == parts(before) + 1)[foot])
    tops = tops[np.bincount(before[tops], minlength=len(nodes))[before[tops]] == 2]
    tops = tops[np.argsort(before[tops], kind="stable")]
    size = np.bincount(after, weights=weight, minlength=len(nodes))
    gone = np.zeros(len(nodes), bool)
    gone[np.where(size[tops[::2]] <= size[tops[1::2]], tops[::2], tops[1::2])] = True
    return ~gone[after][at]


def _cut_all(cells: DataFrame, cuts: DataFrame, cell: float) -> DataFrame:
    """(id, row, col): footprints cut by their transects (id, n, t), in order of n; all footprints of a batch at once."""
    c = F.col
    ends = cuts.filter("t IS NOT NULL").select("id", "n", *[c("t")[e][v].alias(e + v) for e in "ab" for v in "xy"])
    todo = ends.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "ax", "ay", "bx", "by"))).alias("cuts"))
    held = packed_cells(cells).join(todo.hint("merge"), "id", "left").select("id", "row", "col", F.transform("cuts", lambda t: F.struct(*[t[n].alias(n) for n in ("ax", "ay", "bx", "by")])).alias("cuts"))
    return held.mapInArrow(lambda it: _cut(it, cell), "id bigint, row bigint, col bigint")


def _cut(batches: Iterator[pa.RecordBatch], cell: float) -> Iterator[pa.RecordBatch]:
    """Of rows (id, row, col, cuts): the cells that stay."""
    for batch in batches:
        of, row, col = _flat(batch, "row", "col")
        held = batch.column("cuts")
        many = held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = held.flatten()
        ends = np.stack([flat.field(n).to_numpy(zero_copy_only=False) for n in ("ax", "ay", "bx", "by")], 1)
        first, keep = np.cumsum(many) - many, np.ones(len(of), bool)
        for turn in range(int(many.max(initial=0))):
            now = np.flatnonzero(many > turn)
            number = np.full(len(many), -1)
            number[now] = np.arange(len(now))
            some = np.flatnonzero(keep & (number[of] >= 0))
            keep[some] = cut_many(number[of[some]], row[some], col[some], ends[first[now] + turn], cell)
        ids = batch.column("id").take(pa.array(of[keep]))
        yield pa.RecordBatch.from_arrays([ids, pa.array(row[keep]), pa.array(col[keep])], names=["id", "row", "col"])


def _cell_of(x: Column, cell: float) -> Column:
    return F.floor(x / cell)


def trim_end_cells(cells: DataFrame, table: DataFrame, left: DataFrame, cell: float = 1.0, simplify: float = 1.0) -> DataFrame:
    """(id, row, col): footprints as cells, cut at loose ends: at single-way vertices and those without a primary line.

    left, table: the lines of the network and its vertices; their ids needn't be the footprints'. A footprint that holds
    the vertex and the midpoint of a line that isn't connected there is cut by that line's end transect (the last such
    line's), and its larger part stays. All vertices are taken at once.
    """
    c = F.col
    loose = table.filter((F.size("connected") == 0) & c("class").isNotNull()).select("kx", "ky", "x", "y", "ends", F.posexplode("not_connected").alias("n", "line"))
    loose = loose.withColumn("end", F.get(F.transform(F.filter("ends", lambda e: e["id"] == c("line")), lambda e: e["end"]), F.lit(0))).drop("ends")
    # Neither side is broadcast, as a row for each line may pass as small.
    ends = lines.end_pairs(topology.simplified(left, simplify)).select(c("id").alias("line"), "end", g.end_transect(c("p"), c("q"), TRANSECT).alias("t"))
    mid = left.select(c("id").alias("line"), g.measured(c("pts")).alias("s"), (g.length(c("pts")) / 2).alias("h")).select("line", g.interpolate(c("s"), c("h")).alias("m"))
    at = loose.join(ends.hint("merge"), ["line", "end"]).join(mid.hint("merge"), "line")
    at = at.select("kx", "ky", "n", "t", _cell_of(c("x"), cell).alias("row"), _cell_of(c("y"), cell).alias("vr"), _cell_of(c("m.x"), cell).alias("mc"), _cell_of(c("m.y"), cell).alias("mr"))
    at = at.withColumnRenamed("row", "col").withColumnRenamed("vr", "row")
    held = at.join(cells.select("id", "row", "col"), ["row", "col"]).drop("row", "col")
    held = held.join(cells.select("id", c("row").alias("mr"), c("col").alias("mc")), ["id", "mr", "mc"])
    last = held.groupBy("id", "kx", "ky").agg(F.max_by("t", "n").alias("t"))
    return _cut_all(cells, last.select("id", F.struct("kx", "ky").alias("n"), "t"), cell)


def trim_primary_cells(cells: DataFrame, table: DataFrame, left: DataFrame, cell: float = 1.0, simplify: float = 1.0) -> DataFrame:
    """(id, row, col): footprints as cells, those of the first connected pair of a vertex of three to five lines cut by the
    transect that halves the pair's angle there, the larger parts kept. All vertices are taken at once."""
    c = F.col
    pair = F.get("connected", F.lit(0))
    end_of = lambda line, k: F.get(F.transform(F.filter("ends", lambda e: e["id"] == line), lambda e: e["end"]), k)
    first = table.filter((F.size("connected") > 0) & c("class").isNotNull()).select("kx", "ky", "x", "y", "ends", pair.alias("pair"))
    first = first.select("kx", "ky", g.point(c("x"), c("y")).alias("v"), c("pair.a").alias("a"), c("pair.b").alias("b"), end_of(c("pair.a"), F.lit(0)).alias("ea"), end_of(c("pair.b"), F.when(c("pair.a") == c("pair.b"), 1).otherwise(0)).alias("eb"))
    ends = lines.ends(topology.simplified(left, simplify)).select("id", "end", "q")
    both = first.join(ends.select(c("id").alias("a"), c("end").alias("ea"), c("q").alias("qa")), ["a", "ea"]).join(ends.select(c("id").alias("b"), c("end").alias("eb"), c("q").alias("qb")), ["b", "eb"])
    both = both.select("kx", "ky", "a", "b", g.bisector_transect(c("qa"), c("v"), c("qb"), TRANSECT).alias("t"))
    both = both.select("kx", "ky", "t", F.explode(F.array_distinct(F.array("a", "b"))).alias("id"))
    return _cut_all(cells, both.select("id", F.struct("kx", "ky").alias("n"), "t"), cell)


def trim_intersections(cells: DataFrame, table: DataFrame, left: DataFrame, cell: float = 1.0) -> DataFrame:
    """(id, row, col): footprints as cells, less those of the primary lines near the vertices where they meet.

    At a vertex with a connected pair, cells of that pair's lines within 75 of the vertex (50 for a line shorter than
    100) go from the footprints of the other lines there; of what is left of a footprint the 4-connected part that holds
    the line's midpoint stays, or all of it if none does. All vertices are taken at once, so order doesn't matter.
    """
    c = F.col
    met = table.filter((F.size("connected") > 0) & (F.size("ends") > 2))
    first = met.select("kx", "ky", "x", "y", F.get("connected", F.lit(0)).alias("p"), F.transform("ends", lambda e: e["id"]).alias("ids"))
    others = first.select("x", "y", F.array("p.a", "p.b").alias("primary"), F.explode(F.array_distinct(F.array_except("ids", F.array("p.a", "p.b")))).alias("id"))
    lengths = left.select("id", g.length(c("pts")).alias("len"))
    others = others.join(lengths, "id").withColumn("reach", F.when(c("len") < SHORT_LINE, TRIM_NEAR).otherwise(TRIM_FAR))
    pairs = others.select("id", "x", "y", "reach", F.explode("primary").alias("by"))
    held = written(packed_cells(cells), "footprints")
    arrays = "id bigint, row array<bigint>, col array<bigint>"
    taken = pairs.join(held.select(c("id").alias("by"), "row", "col"), "by").select("id", "x", "y", "reach", "row", "col").mapInArrow(lambda it: _reached(it, cell), arrays)
    gone = _joined(taken).select("id", c("row").alias("grow"), c("col").alias("gcol"))
    middle = left.select("id", g.measured(c("pts")).alias("m"), (g.length(c("pts")) / 2).alias("h")).select("id", g.interpolate(c("m"), c("h")).alias("p"))
    gone = gone.join(middle.select("id", F.floor(c("p.y") / cell).alias("mr"), F.floor(c("p.x") / cell).alias("mc")), "id")
    return held.join(gone, "id", "left").select("id", "row", "col", "grow", "gcol", "mr", "mc").mapInArrow(_left_over, "id bigint, row bigint, col bigint")


def packed_cells(cells: DataFrame) -> DataFrame:
    """(id, row, col) with the cells of each footprint as arrays. Runs of one id are packed before the shuffle."""
    runs = cells.select(*[F.col(n).cast("long").alias(n) for n in ("id", "row", "col")]).mapInArrow(_packed, "id bigint, row array<bigint>, col array<bigint>")
    return _joined(runs)


def _joined(runs: DataFrame) -> DataFrame:
    joined = runs.groupBy("id").agg(F.collect_list(F.struct("row", "col")).alias("c"))
    return joined.select("id", F.flatten("c.row").alias("row"), F.flatten("c.col").alias("col"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        batch = batch.filter(batch.column("id").is_valid())
        ids = batch.column("id").to_numpy()
        if len(ids):
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            ends = pa.array(np.append(starts, len(ids)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids[starts]), *[pa.ListArray.from_arrays(ends, batch.column(n)) for n in ("row", "col")]], names=["id", "row", "col"])


def _flat(batch: pa.RecordBatch, rows: str, cols: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the batch, row, col) of all cells in two columns of arrays."""
    of = np.repeat(np.arange(batch.num_rows), batch.column(rows).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return of, batch.column(rows).flatten().to_numpy(zero_copy_only=False), batch.column(cols).flatten().to_numpy(zero_copy_only=False)


def _reached(batches: Iterator[pa.RecordBatch], cell: float) -> Iterator[pa.RecordBatch]:
    """Of rows (id, x, y, reach, row, col): the cells whose centres are within reach of x, y."""
    for batch in batches:
        of, row, col = _flat(batch, "row", "col")
        x, y, reach = (batch.column(n).to_numpy() for n in ("x", "y", "reach"))
        near = ((col + 0.5) * cell - x[of]) ** 2 + ((row + 0.5) * cell - y[of]) ** 2 <= reach[of] ** 2
        counts = np.bincount(of[near], minlength=batch.num_rows)
        ends = pa.array(np.concatenate([[0], np.cumsum(counts[counts > 0])]).astype(np.int32))
        ids = batch.column("id").take(pa.array(np.flatnonzero(counts)))
        yield pa.RecordBatch.from_arrays([ids, *[pa.ListArray.from_arrays(ends, pa.array(v[near])) for v in (row, col)]], names=["id", "row", "col"])


def _left_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of footprints (id, row, col, grow, gcol, mr, mc): their cells less those gone, and of these the part that holds the
    middle, if one does. All footprints of a batch are taken at once; those that lose nothing stay as they are."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        of, row, col = _flat(batch, "row", "col")
        r0, k0 = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(r0, of, row)
        np.minimum.at(k0, of, col)
        high, wide = int((row - r0[of]).max(initial=0)) + 2, int((col - k0[of]).max(initial=0)) + 2  # a free row and column between footprints

        def key(of, row, col):
            r, k = row - r0[of], col - k0[of]
            return np.where((r >= 0) & (r < high - 1) & (k >= 0) & (k < wide - 1), (of * high + r) * wide + k, -1)

        cells = key(of, row, col)
        lost, lr, lk = _flat(batch, "grow", "gcol")
        touched = np.zeros(n, bool)
        touched[lost] = True
        keep = ~np.isin(cells, key(lost, lr, lk))
        todo = np.flatnonzero(keep & touched[of])
        some, at = np.unique(cells[todo], return_inverse=True)

        def place(keys):
            found = np.minimum(np.searchsorted(some, keys), max(len(some) - 1, 0))
            return found, (some[found] == keys) if len(some) else np.zeros(len(keys), bool)

        u, v = [], []
        for step in (1, wide):
            found, there = place(some + step)
            u.append(np.flatnonzero(there))
            v.append(found[there])
        label = roots(len(some), np.concatenate(u), np.concatenate(v))
        mids = [batch.column(m).fill_null(-(1 << 40)).to_numpy(zero_copy_only=False).astype(np.int64) for m in ("mr", "mc")]
        found, there = place(key(np.arange(n), *mids))
        if len(todo):
            keep[todo] = ~there[of[todo]] | (label[at] == label[found[of[todo]]])
        ids = batch.column("id").take(pa.array(of[keep]))
        yield pa.RecordBatch.from_arrays([ids, pa.array(row[keep]), pa.array(col[keep])], names=["id", "row", "col"])


def clip_lines(left: DataFrame, cells: DataFrame, step: float = 1.0, cell: float = 1.0) -> DataFrame:
    """(id, share): how much of each line lies in its own cells, by stations; parts of 15 percent or less don't count."""
    s = lines.stations(left.select("id", "pts"), step).select("id", "k", F.floor(F.col("p.y") / cell).alias("row"), F.floor(F.col("p.x") / cell).alias("col"))
    marked = s.join(cells.withColumn("in", F.lit(1)), ["id", "row", "col"], "left").select("id", "k", F.coalesce("in", F.lit(0)).alias("in"))
    w = W.partitionBy("id").orderBy("k")
    runs = marked.withColumn("run", F.sum(F.when(F.col("in") == F.lag("in").over(w), 0).otherwise(1)).over(w))
    n = F.count(F.lit(1)).over(W.partitionBy("id"))
    sized = runs.withColumn("n", n).groupBy("id", "run").agg(F.max("in").alias("in"), F.count(F.lit(1)).alias("size"), F.max("n").alias("n"))
    share = F.sum(F.when((F.col("in") == 1) & (F.col("size") > SMALL_PART * F.col("n")), F.col("size")).otherwise(0)) / F.max("n")
    return sized.groupBy("id").agg(share.alias("share"))


