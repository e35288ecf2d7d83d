"""Plans and kernels that larger tables need: what every candidate pair pays, and that no step is one task's or one row's."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ridgeway.functions import geom as g
from ridgeway.operators import components, footprint, kernels, profile, topology
from ridgeway.plans import tools

P = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]


def test_meetings_test_bounds_only_in_the_join(spark):
    rows = [(1, P((0, 0), (10, 0), (10, 10))), (2, P((5, -5), (5, 5))), (3, P((4, 0), (6, 0))), (4, P((0, 3), (12, 3), (12, 6), (8, 6))), (5, P((10, 0), (20, 0))), (6, P((2, 0), (3, 0), (3, 1), (7, 1), (7, 0), (8, 0)))]
    met = topology.meetings(spark.createDataFrame(rows, f"id bigint, pts {g.LINE}"))
    joins = [x for x in met._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert joins and not any(" * " in x for x in joins)  # no cross product for a candidate that only shares a grid cell
    found = {(r.a, r.b): ([(p.x, p.y) for p in r.points], [(p.x, p.y) for p in r.overlaps]) for r in met.collect()}
    assert found[1, 4] == ([(10, 3), (10, 6)], []) and found[1, 3] == ([], [(5, 0)]) and found[1, 5] == ([(10, 0)], [])
    assert found[1, 6] == ([], [(2.5, 0), (7.5, 0)]) and found[2, 4] == ([(5, 3)], []) and found[2, 6] == ([(5, 1)], [])


def test_blocks_hold_the_cells_that_are_near(spark):
    r = np.random.default_rng(5)
    raster = spark.createDataFrame([(y, x, x + 0.5, y + 0.5, None if (x + y) % 7 == 0 else float(x * y)) for y in range(-5, 70) for x in range(-5, 40)], "row int, col long, x double, y double, h float")
    rows = [(i, P(*r.integers(-20, 90, (int(r.integers(2, 5)), 2)))) for i in range(12)] + [(90, P((900, 900), (910, 900))), (91, P((3, 3), (3, 3))), (92, P((4, 4))), (93, None), (94, [])]
    features = spark.createDataFrame(rows, f"id bigint, pts {g.LINE}").withColumn("name", F.concat(F.lit("n"), "id"))
    plain = {(x.id, x.row, x.col, x.h) for x in tools.near_cells(features, raster, 9.0).collect()}
    met = tools.near_blocks(features, raster, 9.0)
    held = met.select("id", "name", F.explode(F.arrays_zip("row", "col", "h")).alias("c")).collect()
    assert len(held) == len(plain) > 1000 and {x.name for x in held} == {f"n{x[0]}" for x in plain}
    assert {(x.id, x.c.row, x.c.col, None if np.isnan(x.c.h) else x.c.h) for x in held} == plain
    assert met.count() < len(plain) / 50  # a row for a block, not for a cell

    def run(one):
        return pd.DataFrame({"id": [one["id"]], "name": [one["name"]], "n": [len(one["row"])], "h": [float(np.nansum(one["h"]))]})

    done = tools.per_feature(met, ["id"], run, "id bigint, name string, n int, h double").collect()
    assert {x.id: x.n for x in done} == {i: sum(1 for x in plain if x[0] == i) for i in {x[0] for x in plain}}


def test_components_by_contraction(spark, monkeypatch):
    r = np.random.default_rng(3)
    chain, star = [(i, i + 1) for i in range(1000, 1400)], [(5000, 5001 + i) for i in range(300)]
    edges = [(int(x), int(y)) for x, y in r.integers(0, 900, (400, 2))] + chain + chain[:9] + star + [(7, 7), (-9, 3), (2**62, -(2**61)), (None, 4), (6, None)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for x, y in edges:
        if x is not None and y is not None and x != y:
            x, y = root(x), root(y)
            parent[max(x, y)] = min(x, y)
    want = {x: root(x) for x in parent}
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    for few in (1 << 21, 40, 0):
        monkeypatch.setattr(components, "FEW", few)
        assert {x.id: x.component for x in components.connected_components(df).collect()} == want
    assert components.connected_components(df.limit(0)).count() == 0


def test_components_of_a_small_table_take_no_rounds(spark):
    chain = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("components", "components")
    assert components.connected_components(chain).filter("component = 0").count() == 3001
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup("components")) < 15


def test_simplified_leaves_short_lines(spark, monkeypatch):
    rows = [(1, P((0, 0), (5, 5))), (2, P((0, 0), (1, 0.1), (2, 0), (9, 9))), (3, []), (4, None), (5, P((1, 1)))]
    df = spark.createDataFrame(rows, f"id bigint, pts {g.LINE}")
    found = {r.id: [(p.x, p.y) for p in r.pts] for r in topology.simplified(df, 1.0).collect()}
    assert found == {1: [(0, 0), (5, 5)], 2: [(0, 0), (2, 0), (9, 9)], 3: [], 4: [], 5: [(1, 1)]}
    assert "MapInArrow" in topology.simplified(df, 1.0)._jdf.queryExecution().toString()  # no row of Python objects for a line


def test_merging_takes_groups_in_batches(spark):
    r = np.random.default_rng(8)
    rows, want = [], {}
    for group in range(300):
        parts = [np.cumsum(r.integers(-2, 3, (int(r.integers(2, 4)), 2)), axis=0).astype(float) for _ in range(int(r.integers(1, 6)))]
        ids = r.permutation(1000)[: len(parts)] + 1000 * group
        rows += [(group, int(i), P(*p)) for i, p in zip(ids, parts)]
        want |= {(group, n): [tuple(q) for q in m] for n, m in enumerate(topology.merge_parts([parts[k] for k in np.argsort(ids)]))}
    rows += [(999, 5, P((1, 1))), (998, 6, P((1, 1), (1, 1))), (997, 7, P((0, 0), (0.5, 0)))]
    want[997, 0] = [(0, 0), (0.5, 0)]
    out = topology.merge_lines(spark.createDataFrame(rows, f"bt_group bigint, id bigint, pts {g.LINE}"))
    assert {(x.bt_group, x.part): [(p.x, p.y) for p in x.pts] for x in out.collect()} == want
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()


def test_left_over_cells_keep_the_part_with_the_middle(spark):
    square = [(r, c) for r in range(-3, 4) for c in range(9)]
    wall = [(r, 4) for r in range(-9, 9)]  # of another footprint, partly outside
    rows = [(i, [r for r, _ in square], [c for _, c in square], *([[r for r, _ in wall], [c for _, c in wall], *mid] if mid else [None] * 4)) for i, mid in ((1, (0, 7)), (2, (0, 1)), (3, None), (4, (0, 4)), (5, (99, 0)), (6, (None, None)))]
    df = spark.createDataFrame(rows, "id bigint, row array<bigint>, col array<bigint>, grow array<bigint>, gcol array<bigint>, mr bigint, mc bigint").coalesce(1)
    got = {}
    for x in df.mapInArrow(footprint._left_over, "id bigint, row bigint, col bigint").collect():
        got.setdefault(x.id, set()).add((x.row, x.col))
    cut = set(square) - set(wall)
    assert got == {1: {x for x in cut if x[1] > 4}, 2: {x for x in cut if x[1] < 4}, 3: set(square), 4: cut, 5: cut, 6: cut}


def _raster(spark, height, width):
    return spark.createDataFrame([(y, x, x + 0.5, y + 0.5, None if (x + y) % 7 == 0 else float((x * 31 + y * 17) % 23)) for y in range(-5, height) for x in range(-5, width) if (x // 9 + y // 5) % 11], "row int, col long, x double, y double, h double")


def test_lines_of_a_tile_share_its_cells(spark):
    raster = _raster(spark, 60, 150)
    r = np.random.default_rng(6)
    rows = [(i, P(*r.integers(-20, 90, (int(r.integers(2, 5)), 2)))) for i in range(12)] + [(90, P((900, 900), (910, 900))), (91, P((-90, 10), (300, 30))), (92, P((140, 10), (60, 20))), (None, P((1, 1), (9, 9)))]
    features = spark.createDataFrame(rows, f"id bigint, pts {g.LINE}")
    plain = {(x.id, x.row, x.col, x.h) for x in tools.near_cells(features.filter("id IS NOT NULL"), raster, 9.0).collect()}
    dealt = tools.in_tiles(tools.near_raster(features, raster, 9.0, 1.0), 9.0, 1.0)
    assert {x.id for x in dealt.filter("tr IS NULL").collect()} == {91} and dealt.filter("id = 90").count() == 0

    def run(frame, tile):
        out = []
        for i, lx, ly in zip(frame["id"], frame["lx"], frame["ly"]):
            w = tile.window(np.stack([lx, ly], 1), 9.0)
            if w is not None:
                r, c = np.nonzero(~np.isnan(w.h))
                out.append(pd.DataFrame({"id": i, "row": r + w.r0, "col": c + w.c0, "h": w.h[r, c]}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "row": [], "col": [], "h": []})

    met = tools.per_line(dealt, raster, 9.0, run, "id bigint, row bigint, col bigint, h double", 1.0)
    assert {tuple(x) for x in met.collect()} == {x for x in plain if x[3] is not None}
    assert {x[0] for x in plain} >= {91, 92}


def test_rings_and_thresholds_of_a_line_in_numpy(spark):
    raster = _raster(spark, 60, 60)
    r = np.random.default_rng(7)
    rows = [(i, P(*r.integers(-10, 70, (int(r.integers(2, 6)), 2)))) for i in range(25)] + [(90, P((5, 5), (40, 5))), (91, P((5, 5), (30, 5), (30, 30))), (92, P((-4, 3), (50, 3)))]
    features = spark.createDataFrame(rows, f"id bigint, pts {g.LINE}").withColumn("pts", g.without_repeats(F.col("pts"))).filter(F.size("pts") >= 2)
    percentiles = profile.ring_percentiles(profile.ring_cells_along(features, raster), 40.0).cache()
    want = {(x.id, x.side, x.ring, x.n, x.p) for x in percentiles.collect()}
    cuts = {x.id: tuple(x)[1:] for x in profile.thresholds(profile.profile(percentiles)).collect()}
    out = tools.line_footprint_rel(features, raster, percentile=40.0)
    assert {tuple(x) for x in out["line_percentile"].collect()} == want and len(want) > 300
    assert {x.id: tuple(x)[1:] for x in out["thresholds"].collect()} == {i: v for i, v in cuts.items() if v[-1] is not None}
    assert "FlatMapCoGroupsInPandas" in out["footprint"]._jdf.queryExecution().toString()  # no row for a line and a cell


def test_costs_within_a_limit(spark):
    r = np.random.default_rng(4)
    cost = np.where(r.random((30, 40)) < 0.1, np.nan, 1 + r.random((30, 40)))
    starts = r.random(cost.shape) < 0.01
    whole, some = kernels.accumulate(cost, starts, entered_only=True), kernels.accumulate(cost, starts, entered_only=True, within=5.0)
    assert np.array_equal(some, np.where(whole < 5.0, whole, np.inf)) and np.isinf(some).any() and (whole < 5.0).any()


def _cut_alone(rows, cols, a, b):
    """One footprint cut on a grid of its cells (even places) and the steps between them (odd ones)."""
    y, x = rows - rows.min(), cols - cols.min()
    mask = np.zeros((2 * y.max() + 1, 2 * x.max() + 1), bool)
    mask[2 * y, 2 * x] = True
    mask[1::2, ::2] = mask[:-1:2, ::2] & mask[2::2, ::2]
    mask[::2, 1::2] = mask[::2, :-1:2] & mask[::2, 2::2]
    before = kernels.label4(mask)[2 * y, 2 * x]
    a, b = (np.array([p[0] - 0.5 - cols.min(), p[1] - 0.5 - rows.min()]) for p in (a, b))
    d = b - a
    for step, ex, ey in ((mask[::2, 1::2], 1.0, 0.0), (mask[1::2, ::2], 0.0, 1.0)):
        py, px = np.nonzero(step)
        side = lambda x, y: d[0] * (y - a[1]) - d[1] * (x - a[0]) >= 0
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((px - a[0]) * ey - (py - a[1]) * ex) / (d[0] * ey - d[1] * ex)
        crossed = (side(px, py) != side(px + ex, py + ey)) & (t >= 0) & (t <= 1)
        step[py[crossed], px[crossed]] = False
    after = kernels.label4(mask)[2 * y, 2 * x]
    if len(np.unique(after)) != len(np.unique(before)) + 1:
        return np.ones(len(rows), bool)
    split = [c for c in np.unique(before) if len(np.unique(after[before == c])) == 2][0]
    parts, sizes = np.unique(after[before == split], return_counts=True)
    return after != parts[sizes.argmin()]


def test_footprints_of_a_batch_are_cut_at_once(spark):
    r = np.random.default_rng(9)
    cells, cuts, want = [], [], set()
    for i in range(60):
        rows, cols = r.integers(-6, 3, 70), r.integers(4, 4 + int(r.integers(1, 9)), 70)
        rows, cols = np.unique(np.stack([rows, cols]), axis=1)
        if i % 5 == 0:  # a cell that is told twice counts twice
            rows, cols = np.append(rows, rows[:9]), np.append(cols, cols[:9])
        cells += [(i, int(a), int(b)) for a, b in zip(rows, cols)]
        for n in range(int(r.integers(0, 4))):
            a, b = r.integers(-8, 14, (2, 2)).astype(float).tolist()
            cuts.append((i, n, {"a": {"x": a[0], "y": a[1]}, "b": {"x": b[0], "y": b[1]}}))
            keep = _cut_alone(rows, cols, a, b)
            rows, cols = rows[keep], cols[keep]
        want |= {(i, int(a), int(b)) for a, b in zip(rows, cols)}
    cuts.append((3, 9, None))
    df = spark.createDataFrame(cells, "id bigint, row bigint, col bigint")
    out = footprint._cut_all(df, spark.createDataFrame(cuts, f"id bigint, n int, t struct<a:{g.POINT},b:{g.POINT}>"), 1.0)
    assert {tuple(x) for x in out.collect()} == want and len(want) < len(set(cells))
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
