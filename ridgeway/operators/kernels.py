"""Array kernels on small rasters, vectorised with numpy; they run inside Arrow batches or per line.

Rasters are float arrays with nan for nodata. The leading axis, where there is one, runs over tiles.
"""

from __future__ import annotations

import math

import numpy as np

#: Steps to the eight neighbours; the order breaks ties of paths.
STEPS = ((1, 0), (0, -1), (-1, 0), (0, 1), (1, -1), (1, 1), (-1, -1), (-1, 1))


def disc(radius: int) -> list[tuple[int, int]]:
    """Offsets of the cells whose centres are within a radius, in cells."""
    span = range(-radius, radius + 1)
    return [(r, c) for r in span for c in span if r * r + c * c <= radius * radius]


def focal(stack: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population standard deviation in a disc, without nodata; beyond the edge its nearest cell counts."""
    rows, cols = stack.shape[-2:]
    wide = np.pad(stack, [(0, 0)] * (stack.ndim - 2) + [(radius, radius)] * 2, mode="edge")
    n, total, square = (np.zeros(stack.shape) for _ in range(3))
    for r, c in disc(radius):
        part = wide[..., radius + r : radius + r + rows, radius + c : radius + c + cols]
        there = ~np.isnan(part)
        value = np.where(there, part, 0.0)
        n += there
        total += value
        square += value * value
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = total / n
        return mean, np.sqrt(np.maximum(square / n - mean * mean, 0.0))


def nodata_nearness(stack: np.ndarray, reach: float, cell: tuple[float, float] = (1.0, 1.0)) -> np.ndarray:
    """max(0, reach - distance to the nearest nodata cell) / reach; nodata itself stays nan. Distances are exact."""
    rows, cols = stack.shape[-2:]
    hole = np.isnan(stack)
    best = np.full(stack.shape, np.inf)
    down, over = int(reach / cell[1]) + 1, int(reach / cell[0]) + 1
    for r in range(-down, down + 1):
        for c in range(-over, over + 1):
            d = math.hypot(r * cell[1], c * cell[0])
            if d >= reach or abs(r) >= rows or abs(c) >= cols:
                continue
            here = (..., slice(max(0, -r), rows - max(0, r)), slice(max(0, -c), cols - max(0, c)))
            there = (..., slice(max(0, r), rows + min(0, r)), slice(max(0, c), cols + min(0, c)))
            best[here] = np.where(hole[there], np.minimum(best[here], d), best[here])
    return np.where(hole, np.nan, np.maximum(reach - best, 0.0) / reach)


def canopy_of(height: np.ndarray, threshold: float) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return np.where(np.isnan(height), np.nan, (height >= threshold).astype(float))


def cost_of(height: np.ndarray, threshold: float = 2.5, tree_radius: float = 2.5, line_dist: float = 2.5, avoidance: float = 0.4, exponent: float = 1.5, cell: tuple[float, float] = (1.0, 1.0)) -> tuple[np.ndarray, np.ndarray]:
    """(cost, canopy) of a height raster: cost is between 1 and e to the exponent, nan where there is no height."""
    avoidance = min(1.0, max(0.0, avoidance))
    canopy = canopy_of(height, threshold)
    mean, std = focal(canopy, int(tree_radius / cell[0]))
    near = nodata_nearness(canopy, line_dist, cell) if avoidance > 0 else 0.0
    both = mean + std
    with np.errstate(invalid="ignore", divide="ignore"):
        ratio = np.where(both != 0, (mean - std) / np.where(both != 0, both, 1.0), 0.0)
        cover = np.where(both <= 0, 0.0, (1 + ratio) / 2)
        open_cost = cover * (1 - avoidance) + near * avoidance
        cost = np.exp(np.where(canopy == 1, 1.0, open_cost)) ** exponent
    return np.where(np.isnan(height), np.nan, cost), canopy


def closing(mask: np.ndarray, width: int) -> np.ndarray:
    """Largest, then least value in a square of 2 * width + 1 cells; beyond the edge nothing counts."""

    def square(a, pick, empty):
        wide = np.pad(a.astype(float), [(0, 0)] * (a.ndim - 2) + [(width, width)] * 2, constant_values=empty)
        rows, cols = a.shape[-2:]
        out = None
        for r in range(2 * width + 1):
            for c in range(2 * width + 1):
                part = wide[..., r : r + rows, c : c + cols]
                out = part if out is None else pick(out, part)
        return out

    return square(square(mask, np.maximum, -np.inf), np.minimum, np.inf)


def accumulate(cost: np.ndarray, starts: np.ndarray, cell: tuple[float, float] = (1.0, 1.0), entered_only: bool = False, within: float = np.inf) -> np.ndarray:
    """Least accumulated cost from the start cells (a mask) to every cell, moving to eight neighbours.

    A step costs the mean of both cells times its length, or with entered_only the cell it enters. Cells with nan or
    infinite cost can't be entered. Works on a stack of rasters at once, by relaxing all cells until nothing changes.
    Cells that cost as much as `within` or more are infinite: nothing below it depends on them, and few rounds are needed.
    """
    rows, cols = cost.shape[-2:]
    fine = np.isfinite(cost)
    c = np.where(fine, cost, np.inf)
    d = np.where(starts & fine, 0.0, np.inf)
    moves = []
    for r, k in STEPS:
        to = (..., slice(max(0, r), rows + min(0, r)), slice(max(0, k), cols + min(0, k)))
        of = (..., slice(max(0, -r), rows - max(0, r)), slice(max(0, -k), cols - max(0, k)))
        far = math.hypot(r * cell[1], k * cell[0])
        moves.append((to, of, c[to] if entered_only else (c[of] + c[to]) / 2 * far))
    while True:
        before = d.copy()
        for to, of, step in moves:
            d[to] = np.minimum(d[to], d[of] + step)
        if within < np.inf:
            d[d >= within] = np.inf
        if np.array_equal(before, d):
            return d


def trace_back(d: np.ndarray, cost: np.ndarray, end: tuple[int, int], cell: tuple[float, float] = (1.0, 1.0)) -> list[tuple[int, int]]:
    """Cells from a start to the end along which `d` accumulated; empty if the end can't be reached."""
    if not np.isfinite(d[end]):
        return []
    path = [end]
    while d[path[-1]] > 0:
        r, c = path[-1]
        best = None
        for i, (dr, dc) in enumerate(STEPS):
            n = (r - dr, c - dc)
            if 0 <= n[0] < d.shape[0] and 0 <= n[1] < d.shape[1] and np.isfinite(d[n]) and d[n] < d[r, c]:
                through = d[n] + (cost[n] + cost[r, c]) / 2 * math.hypot(dr * cell[1], dc * cell[0])
                if best is None or (through, i) < best[:2]:
                    best = (through, i, n)
        if best is None:
            break
        path.append(best[2])
    return path[::-1]


def least_cost_path(cost: np.ndarray, start: tuple[int, int], end: tuple[int, int], impassable: float = 9999.0) -> list[tuple[int, int]]:
    """Cells of the cheapest way between two cells, in unit steps. Ends are free; nodata is passable at a high cost.

    Start and end are held within the raster, rows and columns apart. Equal cells give a doubled one.
    """
    rows, cols = cost.shape
    clamp = lambda p: (min(max(p[0], 0), rows - 1), min(max(p[1], 0), cols - 1))
    start, end = clamp(start), clamp(end)
    if start == end:
        return [start, end]
    c = np.where(np.isfinite(cost) & (cost >= 0), cost, impassable)
    c[start] = c[end] = 0.0
    starts = np.zeros(c.shape, bool)
    starts[start] = True
    d = accumulate(c, starts)
    path = trace_back(d, c, end)
    if path and path[0] != start:
        path = [start, *path]
    return path


def corridor(cost: np.ndarray, source: tuple[int, int], target: tuple[int, int], threshold: float, cell: tuple[float, float] = (1.0, 1.0)) -> np.ndarray:
    """0 where the way over a cell costs less than the cheapest plus a threshold, else 1; nan where no way leads over it."""
    out = []
    for p in (source, target):
        m = np.zeros(cost.shape, bool)
        m[p] = True
        out.append(accumulate(cost, m, cell))
    both = out[0] + out[1]
    both[~np.isfinite(both)] = np.nan
    if np.isnan(both).all():
        return both
    over = both - np.nanmin(both)
    return np.where(np.isnan(both), np.nan, (over >= threshold).astype(float))


def label4(mask: np.ndarray) -> np.ndarray:
    """The smallest cell number (in row order) of each cell's 4-connected component; -1 off the mask. Stacks of rasters too."""
    rows, cols = mask.shape[-2:]
    big = rows * cols
    out = np.where(mask, np.arange(big).reshape(rows, cols), big)
    while True:
        before = out
        out = out.copy()
        for axis in (-2, -1):
            a, b = [slice(None)] * out.ndim, [slice(None)] * out.ndim
            a[axis], b[axis] = slice(1, None), slice(None, -1)
            a, b = tuple(a), tuple(b)
            out[a] = np.where(mask[a], np.minimum(out[a], out[b]), big)
            out[b] = np.where(mask[b], np.minimum(out[b], out[a]), big)
        if np.array_equal(before, out):
            return np.where(mask, out, -1)


def trace_rings(mask: np.ndarray) -> list[list[tuple[int, int]]]:
    """Closed rings (row, column of cell corners) around the cells of a mask: the mask lies to the right of each step.

    Outer rings and holes run opposite ways, so signed areas add up to the number of cells. Corners on a straight line
    are left out.
    """
    edges: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def add(a, b):
        edges.setdefault(a, []).append(b)

    wide = np.pad(mask.astype(bool), 1)
    for r, c in zip(*np.nonzero(mask)):
        r, c = int(r), int(c)
        if not wide[r, c + 1]:
            add((r, c), (r, c + 1))
        if not wide[r + 1, c + 2]:
            add((r, c + 1), (r + 1, c + 1))
        if not wide[r + 2, c + 1]:
            add((r + 1, c + 1), (r + 1, c))
        if not wide[r + 1, c]:
            add((r + 1, c), (r, c))
    rings = []
    while edges:
        start = min(edges)
        ring, at, way = [start], start, None
        while True:
            options = edges[at]
            # Where two cells touch at a corner, turn right: components stay 4-connected.
            if len(options) > 1 and way is not None:
                right = (way[1], -way[0])
                options.sort(key=lambda b: (b[0] - at[0], b[1] - at[1]) != right)
            new = options.pop(0)
            if not options:
                del edges[at]
            step = (new[0] - at[0], new[1] - at[1])
            if way == step:
                ring[-1] = new
            else:
                ring.append(new)
            way, at = step, new
            if at == start:
                break
        rings.append(ring)
    return rings


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker: the points farther than a tolerance from the chord between kept ones; ends always stay."""
    points = np.asarray(points, float).reshape(-1, 2)
    n = len(points)
    if n < 3:
        return points
    keep = np.zeros(n, bool)
    keep[[0, -1]] = True
    work = [(0, n - 1)]
    while work:
        i, j = work.pop()
        if j - i < 2:
            continue
        a, d = points[i], points[j] - points[i]
        rel = points[i + 1 : j] - a
        size = float(d @ d)
        t = np.clip(rel @ d / size, 0, 1) if size > 0 else np.zeros(len(rel))
        gap = rel - t[:, None] * d
        far = (gap * gap).sum(axis=1)
        k = int(far.argmax())
        if far[k] > tolerance * tolerance:
            keep[i + 1 + k] = True
            work += [(i, i + 1 + k), (i + 1 + k, j)]
    return points[keep]
