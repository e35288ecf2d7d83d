"""The six tools, and a template, as functions from layers to layers, with a registry of their parameters.

Lines are (id, pts), rasters cells (row, col, x, y, h) with square cells, row r spanning y from r * cell to
(r + 1) * cell. Each tool is one plan: joins that give a line the cells near it, then one kernel for each line.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeway.functions import geom as g
from ridgeway.operators import footprint, kernels, lines, profile, topology
from ridgeway.operators.spatial_join import grid_join
from ridgeway.session import written

#: The corridor threshold, how a centreline ended, and what is cut off its ends.
CORRIDOR, SUCCESS, FAILED, REGENERATED, NOT_REGENERATED, END_CLIP = 2.5, 1, 2, 3, 4, 5.0


@dataclass(frozen=True)
class Parameter:
    name: str
    kind: str
    default: object = None
    optional: bool = False
    output: bool = False


@dataclass
class Tool:
    name: str
    run: Callable[..., dict[str, DataFrame]]
    parameters: tuple[Parameter, ...] = field(default_factory=tuple)


TOOLS: dict[str, Tool] = {}


def tool(name: str, *parameters: Parameter):
    """Register a function from layers and parameters to named layers."""

    def add(fn):
        TOOLS[name] = Tool(name, fn, parameters)
        return fn

    return add


def parameters(spark: SparkSession) -> DataFrame:
    """(tool, name, kind, default, optional, output): the registry as a table."""
    rows = [(t.name, p.name, p.kind, None if p.default is None else json.dumps(p.default), p.optional, p.output) for t in TOOLS.values() for p in t.parameters]
    return spark.createDataFrame(rows, "tool string, name string, kind string, default string, optional boolean, output boolean")


def checked(name: str, given: dict) -> dict:
    """A tool's parameters with defaults, "true" and "false" as booleans, numbers as numbers; unknown or missing ones are errors."""
    known = {p.name: p for p in TOOLS[name].parameters if p.kind not in ("vector", "raster")}
    if extra := set(given) - set(known):
        raise ValueError(f"{name} has no parameter {sorted(extra)}")
    out = {}
    for n, p in known.items():
        v = given.get(n, p.default)
        if isinstance(v, str) and v.lower() in ("true", "false"):
            v = v.lower() == "true"
        if v is None and not p.optional:
            raise ValueError(f"{name} needs {n}")
        out[n] = float(v) if p.kind == "float" and v is not None else int(v) if p.kind == "int" and v is not None else v
    return out


def near_cells(features: DataFrame, cells: DataFrame, reach: float, size: float = 32.0) -> DataFrame:
    """features (id, pts, …) with each cell whose centre is within reach of the line; row, col, x, y, h are added."""
    flat = features.withColumn("__b", g.bounds(F.col("pts"))).withColumn("__e", g.segments(F.col("pts")))
    flat = flat.select("*", *[(F.col(f"__b.{n}") + (reach if n[1] == "1" else -reach)).alias(f"__{n}") for n in ("x0", "y0", "x1", "y1")]).drop("__b")
    met = grid_join(flat, cells.select("row", "col", "x", "y", "h"), ["__x0", "__y0", "__x1", "__y1"], ["x", "y", "x", "y"], size, sparse=True)
    d2 = lambda s: g.segment_distance2(F.col("x"), F.col("y"), s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])
    met = met.withColumn("__d", F.array_min(F.transform("__e", d2)))
    return met.filter(F.col("__d") <= reach * reach).drop("__d", "__e", "__x0", "__y0", "__x1", "__y1")


def near_blocks(features: DataFrame, cells: DataFrame, reach: float, size: float = 32.0) -> DataFrame:
    """The same with one row for a feature and each grid cell that has raster cells near it: row, col and h are arrays.

    The raster is packed by grid cells before the join, and distances are taken of a block at a time: a row for each
    raster cell in the bounds of a feature, with its distance made in the join's condition, cost more than the kernels.
    """
    flat = features.withColumn("__b", g.bounds(F.col("pts")))
    flat = flat.select(*features.columns, *[(F.col(f"__b.{n}") + (reach if n[1] == "1" else -reach)).alias(f"__{n}") for n in ("x0", "y0", "x1", "y1")])
    cell = F.struct(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.coalesce(F.col("h").cast("double"), F.lit(float("nan"))).alias("h"))
    blocks = cells.groupBy(F.floor(F.col("x") / size).alias("__gx"), F.floor(F.col("y") / size).alias("__gy"))
    blocks = blocks.agg(F.collect_list(cell).alias("__cells"), F.min("x").alias("__cx0"), F.min("y").alias("__cy0"), F.max("x").alias("__cx1"), F.max("y").alias("__cy1")).drop("__gx", "__gy")
    met = grid_join(flat, blocks, ["__x0", "__y0", "__x1", "__y1"], ["__cx0", "__cy0", "__cx1", "__cy1"], size, sparse=True)
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in features.schema)
    return met.select(*features.columns, "__cells").mapInArrow(lambda it: _near(it, reach), f"{kinds}row array<bigint>, col array<bigint>, h array<double>")


def distance2(px: np.ndarray, py: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distance of points from a segment, step by step as geom.segment_distance2."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    t = np.minimum(np.maximum(((px - a[0]) * dx + (py - a[1]) * dy) / n, 0.0), 1.0) if n > 0 else 0.0
    x, y = a[0] + dx * t - px, a[1] + dy * t - py
    return x * x + y * y


def _near(batches: Iterator[pa.RecordBatch], reach: float) -> Iterator[pa.RecordBatch]:
    """Of rows (columns of a feature, __cells): those cells whose centres are within reach of the feature's line."""

    def parts(column, names):
        flat = column.flatten()
        at = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))])
        return at, [flat.field(n).to_numpy(zero_copy_only=False) for n in names]

    for batch in batches:
        if not batch.num_rows:
            continue
        at, (row, col, x, y, h) = parts(batch.column("__cells"), ("row", "col", "x", "y", "h"))
        to, (lx, ly) = parts(batch.column("pts"), ("x", "y"))
        line = np.stack([lx, ly], 1).astype(float)
        kept, sizes = [], []
        for i in range(batch.num_rows):
            here = slice(at[i], at[i + 1])
            px, py, pts = x[here], y[here], line[to[i] : to[i + 1]]
            best = np.full(len(px), np.inf)
            if len(px) and len(pts) > 1:
                far = reach + 1e-6  # segments that stay outside the block's bounds by more can't be near its cells
                lo, hi = np.minimum(pts[:-1], pts[1:]), np.maximum(pts[:-1], pts[1:])
                near = (lo[:, 0] <= px.max() + far) & (hi[:, 0] >= px.min() - far) & (lo[:, 1] <= py.max() + far) & (hi[:, 1] >= py.min() - far)
                for k in np.flatnonzero(near):
                    best = np.minimum(best, distance2(px, py, pts[k], pts[k + 1]))
            found = np.flatnonzero(best <= reach * reach) + at[i]
            kept.append(found)
            sizes.append(len(found))
        some = pa.array(np.flatnonzero(sizes))
        every, ends = np.concatenate(kept), np.concatenate([[0], np.cumsum([n for n in sizes if n])]).astype(np.int32)
        out = {f.name: batch.column(f.name).take(some) for f in batch.schema if f.name != "__cells"}
        out |= {n: pa.ListArray.from_arrays(pa.array(ends), pa.array(v[every])) for n, v in (("row", row), ("col", col), ("h", h))}
        yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


def per_feature(met: DataFrame, keys: list[str], run: Callable[[dict], pd.DataFrame], schema: str) -> DataFrame:
    """run over each feature of near_blocks() or near_cells(): its own columns, and its cells as arrays row, col and h.

    Cells are packed before the shuffle, beside one copy of the feature's columns; a row of Python objects for each of its
    thousands of cells cost more than the kernels.
    """
    rest = [c for c in met.columns if c not in (*keys, "row", "col", "x", "y", "h")]
    in_blocks = met.schema["row"].dataType.typeName() == "array"
    cell = F.struct("row", "col", F.col("h") if in_blocks else F.coalesce(F.col("h").cast("double"), F.lit(float("nan"))).alias("h"))
    packed = met.groupBy(*keys).agg(F.first(F.struct(*rest)).alias("__one"), F.collect_list(cell).alias("__cells"))
    # Dealt out again by a number of parts: AQE joins parts by their bytes, which are few, and kernels would run in one task.
    packed = packed.repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    packed = packed.select(*keys, *[F.col(f"__one.{c}").alias(c) for c in rest], *[(F.flatten(f"__cells.{c}") if in_blocks else F.col(f"__cells.{c}")).alias(c) for c in ("row", "col", "h")])

    def each(frames):
        for frame in frames:
            names = list(frame.columns)
            for values in zip(*(frame[n] for n in names)):
                out = run(dict(zip(names, values)))
                if len(out):
                    yield out

    return packed.mapInPandas(each, schema)


class Window:
    """The cells of one line as an array; missing ones are nodata."""

    def __init__(self, frame: dict | pd.DataFrame, cell: float):
        r, c = np.asarray(frame["row"]), np.asarray(frame["col"])
        r0, c0 = int(r.min()), int(c.min())
        h = np.full((int(r.max()) - r0 + 1, int(c.max()) - c0 + 1), np.nan)
        h[r - r0, c - c0] = np.asarray(frame["h"], float)
        self._hold(r0, c0, h, cell)

    def _hold(self, r0: int, c0: int, h: np.ndarray, cell: float) -> Window:
        self.r0, self.c0, self.h, self.cell = r0, c0, h, cell
        self.x = (np.arange(h.shape[1]) + c0 + 0.5) * cell
        self.y = (np.arange(h.shape[0]) + r0 + 0.5) * cell
        return self

    @classmethod
    def of(cls, r0: int, c0: int, h: np.ndarray, cell: float) -> Window:
        return cls.__new__(cls)._hold(r0, c0, h, cell)

    def at(self, p) -> tuple[int, int]:
        """The cell of a point, held within the window."""
        r, c = math.floor(p[1] / self.cell) - self.r0, math.floor(p[0] / self.cell) - self.c0
        return min(max(r, 0), self.h.shape[0] - 1), min(max(c, 0), self.h.shape[1] - 1)

    def away(self, line: np.ndarray) -> np.ndarray:
        """Distance of each cell's centre from a line."""
        px, py = np.meshgrid(self.x, self.y)
        best = np.full(self.h.shape, np.inf)
        for a, b in zip(line[:-1], line[1:]):
            d = b - a
            n = float(d @ d)
            t = np.clip(((px - a[0]) * d[0] + (py - a[1]) * d[1]) / n, 0, 1) if n else np.zeros(px.shape)
            best = np.minimum(best, np.hypot(a[0] + d[0] * t - px, a[1] + d[1] * t - py))
        return best

    def within(self, line: np.ndarray, reach: float) -> np.ndarray:
        return np.where(self.away(line) <= reach, self.h, np.nan)

    def points(self, path: list[tuple[int, int]], first, last) -> np.ndarray:
        """Centres of cells, the ends replaced by the true ones."""
        out = np.array([(self.x[c], self.y[r]) for r, c in path], float)
        out[0], out[-1] = first, last
        return out

    def cells(self, mask: np.ndarray) -> pd.DataFrame:
        r, c = np.nonzero(mask)
        return pd.DataFrame({"row": r + self.r0, "col": c + self.c0})


class Tile:
    """A piece of a raster that many lines share: heights, and which cells there are."""

    def __init__(self, row: np.ndarray, col: np.ndarray, h: np.ndarray, cell: float):
        self.r0, self.c0, self.cell = int(row.min()), int(col.min()), cell
        shape = (int(row.max()) - self.r0 + 1, int(col.max()) - self.c0 + 1)
        self.h, self.there = np.full(shape, np.nan), np.zeros(shape, bool)
        self.h[row - self.r0, col - self.c0] = h
        self.there[row - self.r0, col - self.c0] = True

    def box(self, line: np.ndarray, reach: float) -> tuple[slice, slice]:
        """Rows and columns of the cells in a line's bounds widened by a reach, as far as the tile goes."""
        lo, hi = np.floor((line.min(axis=0) - reach) / self.cell).astype(int), np.floor((line.max(axis=0) + reach) / self.cell).astype(int) + 1
        of = lambda a, b, first, n: slice(min(max(a - first, 0), n), min(max(b - first, 0), n))
        return of(lo[1], hi[1], self.r0, self.h.shape[0]), of(lo[0], hi[0], self.c0, self.h.shape[1])

    def cells(self, line: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(x, y, h) of the cells there are in a line's bounds widened by a reach."""
        rows, cols = self.box(line, reach)
        r, c = np.nonzero(self.there[rows, cols])
        return (c + cols.start + self.c0 + 0.5) * self.cell, (r + rows.start + self.r0 + 0.5) * self.cell, self.h[rows, cols][r, c]

    def window(self, line: np.ndarray, reach: float, margin: int | None = None) -> Window | None:
        """The cells whose centres are within reach of a line, in their bounds; None if there are none.

        margin: the caller looks no further than so many cells from those of the line. If all its points lie on cells
        that are there, no more than the margin is given then, and cells in its corners needn't be within reach.
        """
        if margin is not None and (margin + 1) * self.cell * 2**0.5 <= reach:
            at = np.floor(line[:, ::-1] / self.cell).astype(int) - (self.r0, self.c0)
            if (at >= 0).all() and (at < self.h.shape).all() and self.there[at[:, 0], at[:, 1]].all():
                rows, cols = self.box(line, margin * self.cell)
                return Window.of(rows.start + self.r0, cols.start + self.c0, self.h[rows, cols], self.cell)
        rows, cols = self.box(line, reach)
        r, c = np.nonzero(self.there[rows, cols])
        r, c = r + rows.start, c + cols.start
        best = np.full(len(r), np.inf)
        for a, b in zip(line[:-1], line[1:]):
            best = np.minimum(best, distance2((c + self.c0 + 0.5) * self.cell, (r + self.r0 + 0.5) * self.cell, a, b))
        near = best <= reach * reach
        return Window({"row": r[near] + self.r0, "col": c[near] + self.c0, "h": self.h[r[near], c[near]]}, self.cell) if near.any() else None


#: Cells across a block of a raster (four by four make a tile), and lines that share a copy of a tile, about.
BLOCK, SHARED = 64, 256


def near_raster(lines_: DataFrame, cells: DataFrame, reach: float, cell: float) -> DataFrame:
    """The lines whose bounds are within reach of the raster's, by four numbers and without making the bounds of every line:
    a test that stops at the first point, before any other that most lines wouldn't need."""
    first, last = (cells.agg(F.min("row"), F.min("col"), F.max("row"), F.max("col")).first()[i : i + 2] for i in (0, 2))
    if first[0] is None:
        return lines_.filter(F.lit(False))
    for v, lo, hi in (("x", first[1], last[1]), ("y", first[0], last[0])):
        lines_ = lines_.filter(F.exists("pts", lambda p: p[v] <= (hi + 1) * cell + reach) & F.exists("pts", lambda p: p[v] >= lo * cell - reach))  # noqa: B023
    return lines_


def in_tiles(lines_: DataFrame, reach: float, cell: float) -> DataFrame:
    """Lines (id, pts) as (id, lx, ly, tr, tc): coordinates as arrays, and the tile that holds all within reach of the line.

    A tile is 256 cells wide and overlaps its neighbours by half. Both numbers are null where a line is too long for one.
    """
    c = F.col
    at = lambda v, by: F.floor((c(f"__b.{v}") + by) / cell)
    b = lines_.filter("id IS NOT NULL").select("id", "pts", g.bounds(c("pts")).alias("__b"))
    b = b.select("id", "pts", at("y0", -reach).alias("r0"), at("y1", reach).alias("r1"), at("x0", -reach).alias("c0"), at("x1", reach).alias("c1"))
    home = lambda a, z: F.floor((c(a) + c(z)) / (4 * BLOCK))
    held = lambda t, a, z: (c(a) >= (2 * c(t) - 1) * BLOCK) & (c(z) < (2 * c(t) + 3) * BLOCK)
    b = b.withColumn("tr", home("r0", "r1")).withColumn("tc", home("c0", "c1"))
    fits = held("tr", "r0", "r1") & held("tc", "c0", "c1")
    flat = [F.transform("pts", lambda p: p[v].cast("double")).alias(f"l{v}") for v in "xy"]  # noqa: B023
    return b.select(c("id").cast("long").alias("id"), *flat, *[F.when(fits, c(t)).alias(t) for t in ("tr", "tc")])


def _tile(blocks: pd.DataFrame, cell: float) -> Tile:
    pos, sizes = np.concatenate(blocks["pos"].to_list()).astype(np.int64), [len(x) for x in blocks["pos"]]
    row, col = (np.repeat(blocks[n].to_numpy(np.int64) * BLOCK, sizes) for n in ("br", "bc"))
    return Tile(row + pos // BLOCK, col + pos % BLOCK, np.concatenate(blocks["h"].to_list()), cell)


def per_line(dealt: DataFrame, cells: DataFrame, reach: float, run: Callable[[pd.DataFrame, Tile], pd.DataFrame], schema: str, cell: float, long: bool = True) -> DataFrame:
    """run over lines of in_tiles() and the tile they share: lines of a tile come with one copy of it, some hundred at a
    time, where a row for each line and block of raster near it would hold most cells hundreds of times.

    Lines too long for a tile are run one at a time over the cells near them; long: whether there are such.
    """
    c, keys = F.col, ["tr", "tc", "part"]
    parts = 4 * int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: AQE joins parts by bytes, which are few
    near = dealt.filter("tr IS NOT NULL")
    copies = near.groupBy("tr", "tc").agg(F.ceil(F.count(F.lit(1)) / SHARED).alias("__copies"))
    near = near.join(copies, ["tr", "tc"]).withColumn("part", F.pmod(F.xxhash64("id"), c("__copies"))).drop("__copies")
    by = lambda n: F.floor(c(n) / BLOCK)
    pos = (F.pmod(c("row"), F.lit(BLOCK)) * BLOCK + F.pmod(c("col"), F.lit(BLOCK))).cast("int").alias("pos")
    held = F.struct(pos, F.coalesce(c("h").cast("double"), F.lit(float("nan"))).alias("h"))
    blocks = cells.groupBy(by("row").alias("br"), by("col").alias("bc")).agg(F.collect_list(held).alias("v"))
    tiles = lambda b: F.explode(F.array(F.floor(c(b) / 2), F.floor((c(b) + 1) / 2) - F.when(c(b) % 2 == 0, 1).otherwise(0)))
    blocks = blocks.withColumn("tr", tiles("br")).withColumn("tc", tiles("bc")).join(copies.hint("merge"), ["tr", "tc"])
    blocks = blocks.select("tr", "tc", F.explode(F.sequence(F.lit(0).cast("long"), c("__copies") - 1)).alias("part"), "br", "bc", c("v.pos").alias("pos"), c("v.h").alias("h"))

    def shared(lines_: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        return run(lines_, _tile(blocks, cell)) if len(lines_) and len(blocks) else run(lines_[:0], None)

    out = near.repartition(parts, *keys).groupBy(*keys).cogroup(blocks.repartition(parts, *keys).groupBy(*keys)).applyInPandas(shared, schema)
    if not long:
        return out
    far = dealt.filter("tr IS NULL").withColumn("pts", F.zip_with("lx", "ly", g.point))

    def alone(one: dict) -> pd.DataFrame:
        return run(pd.DataFrame({k: [v] for k, v in one.items() if k not in ("row", "col", "h")}), Tile(*(np.asarray(one[k]) for k in ("row", "col", "h")), cell))

    return out.unionByName(per_feature(near_blocks(far, cells, reach), ["id"], alone, schema))


def array_of(pts) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in pts], float)


def points_of(a: np.ndarray | None) -> list[dict] | None:
    return None if a is None else [{"x": float(x), "y": float(y)} for x, y in a]


def path_length(a: np.ndarray) -> float:
    return float(np.hypot(*np.diff(a, axis=0).T).sum()) if len(a) > 1 else 0.0


def lcp(window: Window, line: np.ndarray, height: np.ndarray, **options) -> np.ndarray | None:
    """The least-cost path between a line's ends over a height window."""
    cost, _ = kernels.cost_of(height, cell=(window.cell, window.cell), **options)
    path = kernels.least_cost_path(cost, window.at(line[0]), window.at(line[-1]))
    return window.points(path, line[0], line[-1]) if len(path) >= 2 else None


def corridor_part(corridor: np.ndarray, ends: list[tuple[int, int]], cell: float) -> np.ndarray:
    """The cells of a corridor that hang together with its ends; parts of no more than 1 square unit go."""
    mask = corridor == 0
    label = kernels.label4(mask)
    keep = np.zeros(mask.shape, bool)
    for n in np.unique(label[label >= 0]):
        part = label == n
        if part.sum() * cell * cell > 1 or any(part[e] for e in ends):
            keep |= part
    return keep


def clipped(line: np.ndarray, by: float) -> np.ndarray | None:
    """A line less what is within a distance of its ends; None if nothing is left."""
    far = (np.hypot(*(line - line[0]).T) > by) & (np.hypot(*(line - line[-1]).T) > by)
    return line[far] if far.sum() >= 2 else None


def medial_path(window: Window, mask: np.ndarray, first, last) -> np.ndarray | None:
    """A path between two points that keeps to the middle of a cell set: cells are the cheaper the farther from its edge."""
    inner, depth = mask.copy(), np.zeros(mask.shape)
    while inner.any():
        depth += inner
        wide = np.pad(inner, 1)
        inner = inner & wide[:-2, 1:-1] & wide[2:, 1:-1] & wide[1:-1, :-2] & wide[1:-1, 2:]
    cost = np.where(mask, 1.0 / np.maximum(depth, 1) ** 2, np.nan)
    path = kernels.least_cost_path(cost, window.at(first), window.at(last))
    return window.points(path, first, last) if len(path) >= 2 else None


def centre_of(window: Window, mask: np.ndarray, path: np.ndarray) -> tuple[np.ndarray, int]:
    """The centreline of a corridor and how it was found; on failure the path itself."""
    found = medial_path(window, mask, path[0], path[-1]) if mask.any() else None
    found = clipped(found, END_CLIP) if found is not None else None
    if found is None:
        return path, FAILED
    whole = np.concatenate([[path[0]], found, [path[-1]]])
    if path_length(whole) >= path_length(path) / 2:
        return whole, SUCCESS
    half = path[len(path) // 2]
    one, two = medial_path(window, mask, path[0], half), medial_path(window, mask, half, path[-1])
    if one is None or two is None:
        return path, NOT_REGENERATED
    return np.concatenate([one, two[1:]]), REGENERATED


_LINES, _RASTER = Parameter("in_line", "vector"), Parameter("in_raster", "raster")


@tool("check_seed_line", _LINES, Parameter("use_angle_grouping", "bool", True, True))
def check_seed_line(in_line: DataFrame, use_angle_grouping: bool = True) -> dict[str, DataFrame]:
    """lines: (id, source, piece, pts, bt_group): lines cleaned, cut where they meet, and grouped into ways."""
    clean = lines.clean_lines(in_line)
    pieces = topology.split_lines(clean, topology.meetings(clean))
    flat = written(pieces.select(F.col("id").alias("source"), "piece", "pts").withColumn("id", F.xxhash64("source", "piece")), "pieces")
    table = topology.vertex_table(flat.select("id", "pts"), simplify=1.0)
    if not use_angle_grouping:
        table = table.withColumn("connected", topology.groups_at_vertex(F.transform("ends", lambda e: F.struct(e["id"].alias("id"), F.lit(-1).alias("grp")))))
    grouped = topology.line_groups(flat, table)
    return {"lines": flat.join(grouped, "id").select("id", "source", "piece", "pts", "bt_group")}


@tool("centerline", _LINES, _RASTER, Parameter("line_radius", "float", 15.0, True), Parameter("proc_segments", "bool", True), Parameter("cell", "float", 1.0, True))
def centerline(in_line: DataFrame, in_raster: DataFrame, line_radius: float = 15.0, proc_segments: bool = True, cell: float = 1.0) -> dict[str, DataFrame]:
    """centerline (id, seg, pts, cl_status), least_cost_path (id, seg, pts), corridor_polygon (id, seg, rings).

    A line without raster cells near it comes back as it is, with the status of a failure.
    """
    clean = lines.clean_lines(in_line.select("id", "pts"))
    work = lines.explode_segments(clean) if proc_segments else clean.withColumn("seg", F.lit(0))
    met = near_blocks(work, in_raster, 1.9 * line_radius + cell)

    def run(one: dict) -> pd.DataFrame:
        line, w = array_of(one["pts"]), Window(one, cell)
        path = lcp(w, line, w.within(line, line_radius))
        rings, found, status = None, line, FAILED
        if path is not None:
            cost, _ = kernels.cost_of(w.within(path, 0.9 * line_radius), cell=(cell, cell))
            ends = [w.at(path[0]), w.at(path[-1])]
            found, status = path, FAILED
            if all(np.isfinite(cost[e]) for e in ends):
                mask = corridor_part(kernels.corridor(cost, ends[0], ends[1], CORRIDOR, (cell, cell)), ends, cell)
                found, status = centre_of(w, mask, path)
                rings = [[{"x": (c + w.c0) * cell, "y": (r + w.r0) * cell} for r, c in ring] for ring in kernels.trace_rings(mask)]
        return pd.DataFrame({"id": [one["id"]], "seg": [one["seg"]], "lc": [points_of(path)], "pts": [points_of(found)], "cl_status": [status], "rings": [rings]})

    done = written(per_feature(met, ["id", "seg"], run, f"id bigint, seg int, lc {g.LINE}, pts {g.LINE}, cl_status int, rings array<{g.LINE}>"), "centerlines-near")
    alone = work.select("id", "seg", "pts").join(done.select("id", "seg"), ["id", "seg"], "left_anti")
    left = alone.select("id", "seg", F.lit(None).cast(g.LINE).alias("lc"), "pts", F.lit(FAILED).alias("cl_status"), F.lit(None).cast(f"array<{g.LINE}>").alias("rings"))
    every = done.unionByName(left)  # three layers from one run
    return {
        "centerline": every.select("id", "seg", "pts", "cl_status"),
        "least_cost_path": every.select("id", "seg", F.coalesce("lc", "pts").alias("pts")),
        "corridor_polygon": every.filter("rings IS NOT NULL").select("id", "seg", "rings"),
    }


def _class(corridor: np.ndarray, canopy: np.ndarray, width: int, cell: float) -> np.ndarray:
    """Cells that are in the corridor and not under canopy; closed by a width if cells are below 1."""
    with np.errstate(invalid="ignore"):
        mask = corridor + canopy == 0
    return kernels.closing(mask, width) == 1 if width > 0 and cell < 1 else mask


@tool("canopy_footprint_absolute", _LINES, _RASTER, Parameter("corridor_thresh", "float", 3.0, True), Parameter("max_ln_width", "float", 32.0, True), Parameter("exp_shk_cell", "int", 0, True), Parameter("cell", "float", 1.0, True))
def canopy_footprint_abs(in_line: DataFrame, in_raster: DataFrame, corridor_thresh: float = 3.0, max_ln_width: float = 32.0, exp_shk_cell: int = 0, cell: float = 1.0) -> dict[str, DataFrame]:
    """footprint (id, row, col): the open cells whose way along the line costs little more than the cheapest."""
    threshold = corridor_thresh if isinstance(corridor_thresh, (int, float)) and corridor_thresh >= 0 else 3.0
    met = near_blocks(lines.clean_lines(in_line.select("id", "pts")), in_raster, max_ln_width)

    def run(one: dict) -> pd.DataFrame:
        line, w = array_of(one["pts"]), Window(one, cell)
        cost, canopy = kernels.cost_of(w.h, cell=(cell, cell))
        corridor = kernels.corridor(cost, w.at(line[0]), w.at(line[-1]), threshold, (cell, cell))
        return w.cells(_class(corridor, canopy, exp_shk_cell, cell)).assign(id=one["id"])[["id", "row", "col"]]

    return {"footprint": per_feature(met, ["id"], run, "id bigint, row bigint, col bigint")}


def signed_distance(line: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How far points are from a line, above 0 on its left. Beyond its ends it goes on straight."""
    best, out = np.full(x.shape, np.inf), np.zeros(x.shape)
    last, turn = len(line) - 2, np.zeros(x.shape)
    for i, (a, b) in enumerate(zip(line[:-1], line[1:])):
        d = b - a
        n = np.hypot(*d)
        along, cross = ((x - a[0]) * d[0] + (y - a[1]) * d[1]) / n, (d[0] * (y - a[1]) - d[1] * (x - a[0])) / n
        over = np.maximum(np.maximum(-along, along - n), 0)
        far = np.hypot(cross, over)
        beyond = ((i == 0) & (along < 0)) | ((i == last) & (along > n))
        size = np.where(beyond | (over == 0), np.abs(cross), far)
        closer, tied = far < best - 1e-9, np.abs(far - best) <= 1e-9
        turn = np.where(closer, cross, np.where(tied, turn + cross, turn))  # at a bend its two segments
        out, best = np.where(closer, size, out), np.where(closer, far, best)
    return np.where(turn >= 0, out, -out)


@tool(
    "line_footprint_relative", _LINES, _RASTER, Parameter("max_ln_width", "float", 32.0, True), Parameter("tree_radius", "float", 1.5, True), Parameter("max_line_dist", "float", 1.5, True),
    Parameter("canopy_avoidance", "float", 0.0, True), Parameter("exponent", "int", 1, True), Parameter("canopy_thresh_percentage", "float", 50.0, True), Parameter("exp_shk_cell", "int", 0, True),
    Parameter("percentile", "float", 50.0, True), Parameter("cell", "float", 1.0, True),
)
def line_footprint_rel(in_line: DataFrame, in_raster: DataFrame, max_ln_width: float = 32.0, tree_radius: float = 1.5, max_line_dist: float = 1.5, canopy_avoidance: float = 0.0, exponent: int = 1,
                       canopy_thresh_percentage: float = 50.0, exp_shk_cell: int = 0, percentile: float = 50.0, cell: float = 1.0) -> dict[str, DataFrame]:
    """footprint (id, row, col), line_percentile (id, side, ring, n, p), thresholds: rings, sides and start cells along the whole line, each
    side by its own rings. A line without cells on both sides has no footprint.
    """
    reach = max(max_ln_width + 1, 15.0 + cell)
    near = near_raster(in_line.select("id", "pts"), in_raster, reach, cell)
    clean = lines.clean_lines(near).withColumn("pts", g.without_repeats(F.col("pts"))).filter(F.size("pts") >= 2)
    dealt = written(in_tiles(clean, reach, cell), "lines-in-tiles")
    long = dealt.filter("tr IS NULL").limit(1).count() > 0
    share = percentile if 0 < percentile <= 100 else 50.0
    margin = max(int(tree_radius / cell), int(max_line_dist / cell) + 1) + 2 * exp_shk_cell + 1 if exponent >= 0 else None

    def ringed(frame: pd.DataFrame, tile: Tile) -> pd.DataFrame:
        held, sides = [], []
        for i, (lx, ly) in enumerate(zip(frame["lx"], frame["ly"])):
            line = np.stack([lx, ly], 1)
            n, p = profile.rings_of(line, *tile.cells(line, 15.0), share / 100)
            if n.max() >= 0:
                held.append(i)
                sides.append([v if n[side].max() >= 0 else None for side in (0, 1) for v in (n[side], p[side])])
        out = frame.iloc[held][["id", "lx", "ly", "tr", "tc"]].reset_index(drop=True)
        return out.assign(**{name: pd.Series([s[k] for s in sides], dtype=object) for k, name in enumerate(("nl", "pl", "nr", "pr"))})

    lists = ", ".join(f"{n}{side} array<{kind}>" for side in "lr" for n, kind in (("n", "bigint"), ("p", "double")))
    rings = per_line(dealt, in_raster, 15.0 + cell, ringed, f"id bigint, lx array<double>, ly array<double>, tr bigint, tc bigint, {lists}", cell, long)
    rings = written(profile.thresholds_of(rings, "pl", "pr"), "rings")
    found = rings.filter("dyncanth IS NOT NULL")
    names = ["cl_cutht", "cr_cutht", "ldist_cut", "rdist_cut"]

    def run(frame: pd.DataFrame, tile: Tile) -> pd.DataFrame:
        ids, cells = [], []
        for key, lx, ly, *cuts in zip(*(frame[n] for n in ("id", "lx", "ly", *names))):
            line = np.stack([lx, ly], 1)
            limits = [far / cell if far >= 0 else CORRIDOR / cell for far in cuts[2:]]
            # No step costs less than 1, so a cell below the limit is no more steps than that from the line.
            w = tile.window(line, max_ln_width + 1, None if margin is None else math.ceil(max(limits)) + margin)
            out = footprint_in(w, line, cuts[:2], limits) if w is not None else None
            if out is not None:
                r, c = np.nonzero(out)
                ids.append(np.full(len(r), key))
                cells.append((r + w.r0, c + w.c0))
        row, col = (np.concatenate(v) for v in zip(*cells)) if cells else ([], [])
        return pd.DataFrame({"id": np.concatenate(ids) if ids else [], "row": row, "col": col}).astype("int64")

    def footprint_in(w: Window, line: np.ndarray, cuts: list[float], limits: list[float]) -> np.ndarray | None:
        px, py = np.meshgrid(w.x, w.y)
        side = signed_distance(line, px, py)
        every = np.zeros(w.h.shape, bool)
        for a, b in zip(line[:-1], line[1:]):
            t = np.linspace(0, 1, max(2, math.ceil(np.hypot(*(b - a))) + 1))[:, None]
            on = np.floor((a + (b - a) * t) / cell).astype(int)
            every[np.clip(on[:, 1] - w.r0, 0, w.h.shape[0] - 1), np.clip(on[:, 0] - w.c0, 0, w.h.shape[1] - 1)] = True
        out = np.zeros(w.h.shape, bool)
        for sign, cut, limit in zip((1, -1), cuts, limits):
            h = np.where((side * sign >= -1) & (side * sign <= max_ln_width + 1), w.h, np.nan)
            t = cut * canopy_thresh_percentage / 100
            cost, canopy = kernels.cost_of(h, t if t > 0 else 0.5, tree_radius, max_line_dist, canopy_avoidance, exponent, (cell, cell))
            starts = every & np.isfinite(cost)
            if not starts.any():
                return None
            acc = kernels.accumulate(cost, starts, (cell, cell), entered_only=True, within=limit)
            corridor = np.where(np.isfinite(cost), (acc >= limit).astype(float), np.nan)
            out |= _class(corridor, canopy, exp_shk_cell, cell)
        return out

    cells = per_line(found.select("id", "lx", "ly", "tr", "tc", *names), in_raster, max_ln_width + 1, run, "id bigint, row bigint, col bigint", cell, long)
    percentiles = [rings.select("id", F.lit(name).alias("side"), F.posexplode(F.arrays_zip(F.col(f"n{s}").alias("n"), F.col(f"p{s}").alias("p"))).alias("ring", "v")).filter("v.n >= 0").select("id", "side", "ring", "v.n", F.nanvl("v.p", F.lit(None).cast("double")).alias("p")) for name, s in (("left", "l"), ("right", "r"))]
    return {"footprint": cells, "line_percentile": percentiles[0].union(percentiles[1]), "thresholds": found.select("id", *names, "dyncanth")}


@tool(
    "ground_footprint", _LINES, Parameter("in_footprint", "vector"), Parameter("offset", "float", 30.0, True), Parameter("max_width", "bool", True, True), Parameter("width_percentile", "float", 75.0, True),
    Parameter("merge_group", "bool", True, True), Parameter("trim_output", "bool", True, True), Parameter("n_samples", "int", None, True), Parameter("cell", "float", 1.0, True),
)
def ground_footprint(in_line: DataFrame, in_footprint: DataFrame, offset: float = 30.0, max_width: bool = True, width_percentile: float = 75.0, merge_group: bool = True, trim_output: bool = True,
                     n_samples: int | None = None, cell: float = 1.0) -> dict[str, DataFrame]:
    """merged_lines (id, pts, avg_width, max_width, length), untrimmed_footprint and footprint (id, row, col), widths,
    perp_lines, footprint_no_holes; without merge_group also split_centerline, inter_points and invalid_splits.

    in_line: (id, pts) with bt_group, which is the id where it is missing; in_footprint: (id, ring) or (id, rings), whose
    holes don't count, with bt_group or without. Where both have a group, widths are measured in polygons of the line's
    own. Without merge_group lines are merged to ways, split where these meet and grouped anew, and the widths of a group
    are its largest. Loose ends are trimmed; without merge_group also the primary lines at their vertex, and the others near it.
    n_samples: how many stations to put transects at; None takes the line's own points.
    """
    clean = lines.clean_lines(in_line)
    clean = clean if "bt_group" in clean.columns else clean.withColumn("bt_group", F.col("id"))
    # Used up to five times below, and a file of short lines may be one task's: dealt out by number.
    clean = written(clean.repartition(int(clean.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id"), "clean")
    polygons = in_footprint if "ring" in in_footprint.columns else in_footprint.withColumn("ring", g.remove_holes(F.col("rings"))[0])
    extra = {"footprint_no_holes": polygons.select("id", "ring")}
    if merge_group:
        merged = topology.merge_lines(clean).withColumn("id", F.xxhash64("bt_group", "part"))
    else:
        ways = topology.line_groups(clean, topology.vertex_table(clean.select("id", "pts"), simplify=1.0))
        ways = topology.merge_lines(clean.select("id", "pts").join(ways, "id")).select(F.xxhash64("bt_group", "part").alias("id"), "pts")
        split = topology.split_layers(written(ways, "ways"))
        pieces = written(split["split_lines"].select(F.xxhash64("id", "piece").alias("id"), "pts"), "split")
        extra |= {"split_centerline": pieces, "inter_points": split["inter_points"], "invalid_splits": split["invalid_splits"]}
        regrouped = topology.line_groups(pieces, topology.vertex_table(pieces, simplify=1.0))
        merged = pieces.join(regrouped, "id")
    merged = written(merged.select("id", "bt_group", "pts"), "merged")  # used five times below
    plain = topology.simplified(merged, 0.1)
    if n_samples:
        t = plain.withColumn("m", g.measured(F.col("pts"))).withColumn("len", g.length(F.col("pts")))
        plain = t.select("id", F.transform(F.sequence(F.lit(0), F.lit(n_samples)), lambda k: g.interpolate(F.col("m"), F.col("len") * k / n_samples)).alias("pts"))
    groups = merged.select("id", "bt_group") if "bt_group" in polygons.columns and "bt_group" in in_line.columns else None
    across = footprint.transect_widths(plain if groups is None else plain.join(groups, "id"), polygons, offset, zeros=False)
    widths = footprint.line_widths(plain, across, width_percentile)
    sized = merged.join(footprint.imputed(widths, "avg_width", "max_width"), "id")
    sized = sized if merge_group else footprint.group_max(sized)
    sized = written(sized.withColumn("length", g.length(F.col("pts"))), "sized")
    radius = F.col("max_width") * 1.2 / 2 if max_width else F.col("avg_width") / 2
    cells = written(footprint.buffered_cells(sized.withColumn("r", radius), "r", cell), "cells")
    out = {"merged_lines": sized.select("id", "bt_group", "pts", "avg_width", "max_width", "n_widths", "length"), "untrimmed_footprint": cells, "widths": widths, "footprint": cells, "perp_lines": lines.transects(plain, offset)} | extra
    if trim_output:
        network = (clean if merge_group else merged).select("id", "pts")  # loose ends are those of the lines before merging
        table = written(topology.vertex_table(network, simplify=1.0), "vertices")
        trimmed = cells if merge_group else written(footprint.trim_primary_cells(cells, table, network, cell), "primary")
        trimmed = written(footprint.trim_end_cells(trimmed, table, network, cell), "ends")
        out["footprint"] = trimmed if merge_group else footprint.trim_intersections(trimmed, table, network, cell)
    return out


def _common_point(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """The mean of the points that two lines have in common."""
    hits = []
    for p, q in zip(a[:-1], a[1:]):
        for r, s in zip(b[:-1], b[1:]):
            d, e, f = q - p, s - r, r - p
            den = d[0] * e[1] - d[1] * e[0]
            if den == 0:
                continue
            t, u = (f[0] * e[1] - f[1] * e[0]) / den, (f[0] * d[1] - f[1] * d[0]) / den
            if 0 <= t <= 1 and 0 <= u <= 1:
                hits.append(np.round(p + t * d, 9))
    return np.unique(np.array(hits), axis=0).mean(axis=0) if hits else None


def _nearest_point(line: np.ndarray, p: np.ndarray) -> np.ndarray:
    best = None
    for a, b in zip(line[:-1], line[1:]):
        d = b - a
        n = float(d @ d)
        q = a + d * min(1.0, max(0.0, float((p - a) @ d) / n if n else 0.0))
        far = float((q - p) @ (q - p))
        best = (far, q) if best is None or far < best[0] else best
    return best[1]


def anchor_pairs(ends: DataFrame, box: tuple[float, float, float, float] | None = None, three_way: bool = False) -> DataFrame:
    """(kx, ky, x, y, ends, s1, e1, s2, e2): the pairs of anchors at each vertex; ends from lines.ends(), as columns id, end, p, slope, anchor.

    Four ends: first and third, second and fourth, by angle. Three, only with three_way: the two that are farthest apart,
    and the third with its mirror image. Two: both. One: it and its mirror image. Of four and three all anchors must be
    inside the box. Other vertices have none.
    """
    at = lambda n: F.round(F.col(f"p.{n}") / g.SMALL).cast("long")
    rows = ends.select(at("x").alias("kx"), at("y").alias("ky"), F.col("p"), F.struct("id", "end", "slope", "anchor").alias("e"))
    v = rows.groupBy("kx", "ky").agg(F.min("p").alias("p"), F.sort_array(F.collect_list("e")).alias("ends")).filter(F.size("ends") <= 4)
    e = lambda i: F.get("ends", F.lit(i))["anchor"]
    by_angle = F.array_sort(F.transform("ends", lambda o, i: F.struct(o["slope"].alias("slope"), i.alias("i"), o["anchor"].alias("anchor"))))
    v = v.withColumn("o", F.transform(by_angle, lambda o: o["anchor"]))
    o = lambda i: F.get("o", F.lit(i))
    gap = lambda i, j: F.abs(F.get("ends", F.lit(i))["slope"] - F.get("ends", F.lit(j))["slope"])
    turn = lambda d: F.when(d > math.pi, 2 * math.pi - d).otherwise(d)
    for name, i, j in (("g01", 0, 1), ("g02", 0, 2), ("g12", 1, 2)):
        v = v.withColumn(name, turn(gap(i, j)))
    v = v.withColumn("most", F.greatest("g01", "g02", "g12"))
    first = F.when(F.col("g01") == F.col("most"), F.lit(2)).when(F.col("g02") == F.col("most"), F.lit(1)).otherwise(0)  # the one left over
    v = v.withColumn("over", first)
    n, p = F.size("ends"), F.col("p")
    left = F.get("ends", F.col("over"))["anchor"]
    three = F.lit(three_way) & (n == 3)
    v = v.select(
        "kx", "ky", "p", "ends",
        F.when(n == 4, o(0)).when(three, F.when(F.col("over") == 0, e(1)).otherwise(e(0))).when(n <= 2, e(0)).alias("s1"),
        F.when(n == 4, o(2)).when(three, F.when(F.col("over") == 2, e(1)).otherwise(e(2))).when(n == 2, e(1)).when(n == 1, g.mirrored(e(0), p)).alias("e1"),
        F.when(n == 4, o(1)).when(three, left).alias("s2"),
        F.when(n == 4, o(3)).when(three, g.mirrored(left, p)).alias("e2"),
    )
    if box:
        inside = lambda c: (F.col(f"{c}.x") > box[0]) & (F.col(f"{c}.x") < box[2]) & (F.col(f"{c}.y") > box[1]) & (F.col(f"{c}.y") < box[3])
        v = v.filter((F.size("ends") <= 2) | (inside("s1") & inside("e1") & inside("s2") & inside("e2")))
    return v.filter("s1 IS NOT NULL AND e1 IS NOT NULL")


@tool("vertex_optimization", _LINES, _RASTER, Parameter("search_distance", "float", 30.0), Parameter("line_radius", "float", 35.0, True), Parameter("three_way", "bool", False, True), Parameter("cell", "float", 1.0, True))
def vertex_optimization(in_line: DataFrame, in_raster: DataFrame, search_distance: float = 30.0, line_radius: float = 35.0, three_way: bool = False, cell: float = 1.0) -> dict[str, DataFrame]:
    """lines (id, seg, pts) with their ends moved, vertices (x, y, nx, ny), anchors, lc_paths."""
    segments = lines.explode_segments(lines.clean_lines(in_line.select("id", "pts"))).withColumnRenamed("id", "source")
    segments = segments.withColumn("id", F.xxhash64("source", "seg"))
    b = in_raster.filter("h IS NOT NULL").agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if b[0] is None:
        return {"lines": segments.select(F.col("source").alias("id"), "seg", "pts")}
    box = (b[0] - cell / 2, b[1] - cell / 2, b[2] + cell / 2, b[3] + cell / 2)
    pairs = anchor_pairs(lines.ends(segments.select("id", "pts"), search_distance), box, three_way)
    both = F.when(F.col("s2").isNotNull(), F.array("s1", "e1", "e2", "s2")).otherwise(F.array("s1", "e1"))
    work = pairs.select("kx", "ky", "p", "s1", "e1", "s2", "e2", both.alias("pts"))
    met = near_blocks(work, in_raster, line_radius)

    def run(one: dict) -> pd.DataFrame:
        w = Window(one, cell)
        seeds = [array_of([one[s], one[e]]) for s, e in (("s1", "e1"), ("s2", "e2")) if one[s] is not None]
        paths = [lcp(w, s, w.within(s, line_radius)) for s in seeds]
        new = None
        if all(p is not None for p in paths):
            new = _common_point(*paths) if len(paths) == 2 else _nearest_point(paths[0], array_of([one["p"]])[0])
        new = None if new is None else {"x": float(new[0]), "y": float(new[1])}
        return pd.DataFrame({"kx": [one["kx"]], "ky": [one["ky"]], "new": [new], "paths": [[points_of(p) for p in paths if p is not None]]})

    found = per_feature(met, ["kx", "ky"], run, f"kx bigint, ky bigint, new {g.POINT}, paths array<{g.LINE}>")
    ends = pairs.select("kx", "ky", F.explode("ends").alias("e")).select("kx", "ky", F.col("e.id").alias("id"), F.col("e.end").alias("end"))
    moved = ends.join(found, ["kx", "ky"]).groupBy("id").agg(F.max_by("new", F.when(F.col("end") == 0, 1)).alias("head"), F.max_by("new", F.when(F.col("end") == -1, 1)).alias("tail"))
    out = segments.join(moved, "id", "left").withColumn("a", g.replace_end(F.col("pts"), 0, F.col("head"))).withColumn("b", g.replace_end(F.col("a"), -1, F.col("tail")))
    return {
        "lines": out.select(F.col("source").alias("id"), "seg", F.col("b").alias("pts")),
        "vertices": found.join(pairs.select("kx", "ky", "p"), ["kx", "ky"]).select(F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("new.x").alias("nx"), F.col("new.y").alias("ny")),
        "anchors": pairs.select("kx", "ky", "s1", "e1", "s2", "e2"),
        "lc_paths": found.select("kx", "ky", F.posexplode("paths").alias("n", "pts")),
    }


@tool("buffer_template", _LINES, Parameter("radius", "float", 10.0), Parameter("cell", "float", 1.0, True))
def buffer_template(in_line: DataFrame, radius: float = 10.0, cell: float = 1.0) -> dict[str, DataFrame]:
    """buffer (id, row, col): every feature widened; a pattern for new tools."""
    return {"buffer": footprint.buffered_cells(in_line.select("id", "pts").withColumn("r", F.lit(float(radius))), "r", cell)}
