import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeway.functions import geom as g
from ridgeway.operators import footprint, kernels, profile, topology


def dijkstra(cost, start):
    d, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        at, (r, c) = heapq.heappop(heap)
        if at > d[r, c]:
            continue
        for dr, dc in kernels.STEPS:
            n = (r + dr, c + dc)
            if 0 <= n[0] < cost.shape[0] and 0 <= n[1] < cost.shape[1] and np.isfinite(cost[n]):
                new = at + (cost[r, c] + cost[n]) / 2 * math.hypot(dr, dc)
                if new < d.get(n, np.inf):
                    d[n] = new
                    heapq.heappush(heap, (new, n))
    return d


@pytest.mark.parametrize("seed", range(4))
def test_accumulated_cost_is_that_of_a_queue(seed):
    rng = np.random.default_rng(seed)
    cost = rng.uniform(1, 4, (17, 23))
    cost[rng.random(cost.shape) < 0.2] = np.nan
    cost[0, 0] = 1
    m = np.zeros(cost.shape, bool)
    m[0, 0] = True
    d, want = kernels.accumulate(cost, m), dijkstra(cost, (0, 0))
    assert {p: d[p] for p in want} == pytest.approx(want) and np.isfinite(d).sum() == len(want)
    end = max(want)
    path = kernels.trace_back(d, cost, end)
    assert path[0] == (0, 0) and path[-1] == end
    along = sum((cost[a] + cost[b]) / 2 * math.hypot(a[0] - b[0], a[1] - b[1]) for a, b in zip(path, path[1:]))
    assert along == pytest.approx(want[end])


def test_least_cost_path_edges():
    c = np.ones((3, 3))
    assert kernels.least_cost_path(c, (1, 1), (1, 1)) == [(1, 1), (1, 1)]
    assert kernels.least_cost_path(c, (-5, 0), (9, 9)) == [(0, 0), (1, 1), (2, 2)]
    wall = np.ones((3, 3))
    wall[1] = np.nan
    assert len(kernels.least_cost_path(wall, (0, 0), (2, 0))) == 3  # nodata can be crossed at a high cost


def test_corridor_minimum_is_open():
    rng = np.random.default_rng(0)
    corridor = kernels.corridor(rng.uniform(1, 4, (12, 12)), (0, 0), (11, 11), 2.5)
    assert corridor[0, 0] == 0 and corridor[11, 11] == 0 and set(np.unique(corridor)) <= {0.0, 1.0}


def test_cost_is_bounded():
    rng = np.random.default_rng(1)
    h = rng.uniform(0, 10, (4, 20, 20))
    h[rng.random(h.shape) < 0.1] = np.nan
    cost, canopy = kernels.cost_of(h)
    fine = ~np.isnan(h)
    assert (cost[fine] >= 1).all() and (cost[fine] <= math.exp(1.5) + 1e-9).all() and np.isnan(cost[~fine]).all()
    assert (cost[canopy == 1] == pytest.approx(math.exp(1.5)))


def test_rings_of_cells():
    mask = np.zeros((6, 7), bool)
    mask[1:5, 1:6] = True
    mask[2, 3] = False
    mask[3, 4] = False  # touches the other hole at a corner
    rings = kernels.trace_rings(mask)
    area = sum(sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(r, r[1:])) for r in rings) / 2
    assert abs(area) == mask.sum() and all(r[0] == r[-1] for r in rings)
    assert kernels.trace_rings(np.ones((2, 3), bool)) == [[(0, 0), (0, 3), (2, 3), (2, 0), (0, 0)]]
    assert kernels.trace_rings(np.zeros((2, 2), bool)) == []


def test_labels_are_components():
    rng = np.random.default_rng(2)
    mask = rng.random((3, 9, 9)) < 0.5
    label = kernels.label4(mask)
    for m, lab in zip(mask, label):
        for r, c in zip(*np.nonzero(m)):
            for dr, dc in ((0, 1), (1, 0)):
                if r + dr < 9 and c + dc < 9 and m[r + dr, c + dc]:
                    assert lab[r, c] == lab[r + dr, c + dc]
        assert (lab[~m] == -1).all() and all(lab.ravel()[n] == n for n in np.unique(lab[m]))


def plain_simplify(points, tolerance):
    if len(points) < 3:
        return points
    a, b = np.array(points[0]), np.array(points[-1])
    d = b - a
    far = []
    for p in points[1:-1]:
        t = min(1, max(0, float((np.array(p) - a) @ d) / float(d @ d))) if (d @ d) else 0
        far.append(float(np.hypot(*(a + t * d - np.array(p)))))
    k = int(np.argmax(far))
    if far[k] <= tolerance:
        return [points[0], points[-1]]
    return plain_simplify(points[: k + 2], tolerance)[:-1] + plain_simplify(points[k + 1 :], tolerance)


def test_simplify():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 40):
        p = [tuple(x) for x in rng.uniform(0, 10, (n, 2))]
        assert [tuple(x) for x in kernels.simplify(p, 1.5)] == plain_simplify(p, 1.5)


def line(*p):
    return np.array(p, float)


def test_merge_of_parts():
    merge = lambda *p: [m.tolist() for m in topology.merge_parts(list(p))]
    assert merge(line((0, 0), (1, 0)), line((2, 0), (1, 0)), line((2, 0), (3, 1))) == [[[0, 0], [1, 0], [2, 0], [3, 1]]]
    star = merge(line((0, 0), (5, 0)), line((5, 0), (9, 0)), line((5, 0), (5, 9)))
    assert len(star) == 3
    gap = merge(line((0, 0), (5, 0)), line((5.5, 0), (9, 0)))
    assert gap == [[[0, 0], [5, 0], [9, 0]]]  # ends within 1 are one node
    assert merge(line((0, 0), (5, 0)), line((50, 0), (90, 0))) == [[[0, 0], [5, 0]], [[50, 0], [90, 0]]]
    ring = merge(line((0, 0), (4, 0)), line((4, 0), (4, 4)), line((4, 4), (0, 0)))
    assert len(ring) == 1 and ring[0][0] == ring[0][-1]
    assert merge(line((0, 0), (0, 0))) == [] and merge() == []
    rng = np.random.default_rng(5)
    path = np.cumsum(rng.uniform(2, 5, (9, 2)), axis=0)
    parts = [path[i : i + 2][:: rng.choice([1, -1])] for i in rng.permutation(8)]
    joined = topology.merge_parts(parts)
    assert len(joined) == 1 and np.hypot(*np.diff(joined[0], axis=0).T).sum() == pytest.approx(np.hypot(*np.diff(path, axis=0).T).sum())


def test_cutting_rings():
    square = line((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))
    parts = footprint.cut_ring(square, (3, -5), (3, 15))
    assert sorted(footprint.ring_area(p) for p in parts) == [30, 70]
    assert footprint.ring_area(footprint.trim_ring(square, ((3, -5), (3, 15)))) == 70
    assert len(footprint.cut_ring(square, (3, 5), (3, 15))) == 1 and len(footprint.cut_ring(square, (20, 0), (20, 9))) == 1


CASES = [
    ([0.0] * 15, 4.0, 0.5),  # median at most 0.5
    ([3.0] * 15, 4.5, 3.0),
    ([7.5] * 15, 5.5, 7.0),
    ([12.0] * 15, 6.0, 12.0),
    ([20.0] * 15, 5.0, 15.5),
    ([0.0, 0.0, 2.0] + [2.0] * 12, 3.0, 2.0),
    ([0.0] * 6 + [0.6] * 8 + [9.0], 4.5, 0.0),  # the last ring is never tested; 0.6 is no rise by a level
    ([16.0] * 4 + [18.0] * 11, 5.0, 15.5),
    ([16.0, 18.0] + [18.0] * 13, 2.0, 18.0),
    ([0.0] * 5 + [1.45] + [1.45] * 9, 6.0, 1.0),
    ([1.0, 2.15] + [2.15] * 13, 4.5, 2.0),  # 1.15 is below all levels
]


def test_change_points(spark):
    rows = [(i, p, d, h) for i, (p, d, h) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, p array<double>, d double, h double").select("i", "d", "h", profile.rate_of_change(F.col("p")).alias("c"))
    for r in df.collect():
        want = (r.d, r.h) if r.i != 6 else (4.5, 0.0)
        assert (r.c["dist"], r.c["height"]) == want, r.i
    none = spark.createDataFrame([([None] * 15,)], "p array<double>").select(profile.rate_of_change(F.col("p")).alias("c")).first().c
    assert (none["dist"], none["height"]) == (3.0, 0.5)


def test_splitting_keeps_lengths(spark):
    pts = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    rows = [(1, pts((0, 0), (10, 0), (10, 10))), (2, pts((5, -5), (5, 5))), (3, pts((10, 5), (20, 5))), (4, pts((2, 0), (8, 0))), (5, pts((50, 50), (60, 60)))]
    df = spark.createDataFrame(rows, f"id bigint, pts {g.LINE}")
    met = topology.meetings(df)
    found = {(r.a, r.b): (len(r.points), len(r.overlaps)) for r in met.collect()}
    assert found == {(1, 2): (1, 0), (1, 3): (1, 0), (1, 4): (0, 1), (2, 4): (1, 0)}
    out = topology.split_lines(df, met)
    total = {r.id: r.t for r in out.groupBy("id").agg(F.sum(g.length(F.col("pts"))).alias("t")).collect()}
    assert total == pytest.approx({r.id: r.t for r in df.select("id", g.length(F.col("pts")).alias("t")).collect()})
    assert {r.id: r["count"] for r in out.groupBy("id").count().collect()} == {1: 3, 2: 2, 3: 1, 4: 2, 5: 1}
