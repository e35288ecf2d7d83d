import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeway.functions import geom as g
from ridgeway.operators import components, footprint, raster, spatial_join, topology
from ridgeway.plans import fixtures as fx
from ridgeway.plans import tools
from ridgeway.sources import layers
from ridgeway.streaming import ingest

P = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]


def lines_of(spark, *rows):
    return spark.createDataFrame(list(rows), f"id bigint, pts {g.LINE}")


def test_layers_go_to_a_dataset_and_back(spark, tmp_path):
    df = lines_of(spark, (5, P((0, 0), (1, 1))), (3, P((2, 2), (3, 3))), (9, []), (7, None))
    path, aux = str(tmp_path / "main"), str(tmp_path / "aux")
    layers.write_layers({"centerline": df, "least_cost_path": df}, path, ("centerline",), aux)
    assert layers.list_layers(spark, path) == ["centerline"] and layers.list_layers(spark, aux) == ["least_cost_path"]
    assert layers.optional_layer(spark, path, "least_cost_path") is None and layers.list_layers(spark, str(tmp_path / "none")) == []
    assert sorted((r.id, r.bt_uid) for r in layers.read_layer(spark, path, "centerline").collect()) == [(3, 0), (5, 1)]


def test_reference_systems(spark):
    a, b = spark.createDataFrame([(1, 26912)], "id int, srid int"), spark.createDataFrame([(1, 3857)], "id int, srid int")
    assert layers.same_srid(a, a, spark.range(1)) == 26912 and layers.same_srid(spark.range(1)) is None
    with pytest.raises(ValueError, match="reference systems"):
        layers.same_srid(a, b)


def test_geojson(spark, tmp_path):
    features = [
        {"type": "Feature", "properties": {"fid": 1}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0, 9], [4, 0, 9], [4, 4, 9], [0, 0, 9]]]]}},
        {"type": "Feature", "properties": {"fid": 2}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [3, 4]]}},
        {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
        {"type": "Feature", "properties": {}, "geometry": None},
    ]
    (tmp_path / "x.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    r = {x.id: x for x in layers.read_geojson(spark, str(tmp_path / "x.geojson")).collect()}
    assert [(p.x, p.y) for p in r[0].parts[0]] == [(0, 0), (4, 0), (4, 4), (0, 0)] and r[0].properties["fid"] == "1"
    assert [(p.x, p.y) for p in r[1].parts[0]] == [(0, 0), (3, 4)] and [(p.x, p.y) for p in r[2].parts[0]] == [(1, 2)] and r[3].parts is None
    out = json.loads(layers.geojson_features(lines_of(spark, (7, P((0, 0), (3, 4)))), "id").first().value)
    assert out["properties"] == {"id": 7} and out["geometry"]["coordinates"] == [[0.0, 0.0], [3.0, 4.0]]


def test_raster_tables(spark, small, tmp_path):
    cells = fx.mosaic(spark, small)
    layers.write_raster(cells, str(tmp_path / "r"), 8)
    assert layers.read_raster(spark, str(tmp_path / "r")).count() == cells.count()
    part = layers.read_raster(spark, str(tmp_path / "r"), (3, 9), 8)
    assert part.count() == cells.filter("row BETWEEN 3 AND 9").count()
    assert "PartitionFilters: [isnotnull(trow" in part._jdf.queryExecution().toString()
    wide = raster.focal_mosaic(cells, 2.5, 2, 5).agg(F.sum("mean"), F.sum("std")).first()
    assert tuple(wide) == pytest.approx(tuple(raster.focal_mosaic(cells, 2.5, 2, 64).agg(F.sum("mean"), F.sum("std")).first()))


def test_components_and_grid_joins(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (None, 4), (3, 1), (7, 8)], "a bigint, b bigint")
    assert {r.id: r.component for r in components.connected_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7}
    assert components.connected_components(edges.limit(0)).count() == 0
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components.connected_components(chain).select("component").distinct().count() == 1
    box = spark.createDataFrame([(1, 0.0, 0.0, 70.0, 70.0)], "i int, x0 double, y0 double, x1 double, y1 double")
    other = spark.createDataFrame([(2, -5.0, -5.0, 90.0, 3.0)], "j int, u0 double, v0 double, u1 double, v1 double")
    assert spatial_join.grid_join(box, other, ["x0", "y0", "x1", "y1"], ["u0", "v0", "u1", "v1"], 8.0).count() == 1


def strip(spark, width=40, height=30):
    """A raster of tall cells with an open strip of five rows along y = 15."""
    rows = [(r, c, c + 0.5, r + 0.5, 1.0 if 13 <= r <= 17 else 12.0) for r in range(height) for c in range(width)]
    return spark.createDataFrame(rows, "row bigint, col bigint, x double, y double, h double")


def test_tools_find_an_open_strip(spark):
    cells, seeds = strip(spark), lines_of(spark, (1, P((2.5, 14.2), (37.5, 16.4))), (2, P((500, 500), (540, 500))))
    out = tools.centerline(seeds, cells)
    got = {r.id: r for r in out["centerline"].collect()}
    assert got[1].cl_status == tools.SUCCESS and got[2].cl_status == tools.FAILED
    assert (got[1].pts[0].x, got[1].pts[-1].x) == (2.5, 37.5) and all(13 <= p.y <= 18 for p in got[1].pts)
    assert out["corridor_polygon"].count() == 1 and {r.id for r in out["least_cost_path"].collect()} == {1, 2}
    foot = tools.canopy_footprint_abs(seeds, cells)["footprint"].toPandas()
    assert set(foot.id) == {1} and foot.row.between(13, 17).all() and len(foot) > 60
    rel = tools.line_footprint_rel(seeds, cells)
    assert rel["thresholds"].count() == 1 and rel["footprint"].filter("row BETWEEN 13 AND 17").count() > 60
    assert rel["footprint"].filter("row NOT BETWEEN 13 AND 17").count() == 0


def test_widths_of_a_rectangle(spark):
    line = lines_of(spark, (1, P((0, 5), (5, 5.5), (10, 5), (15, 5.2), (20, 5))))
    rect = spark.createDataFrame([(9, P((-5, 2), (25, 2), (25, 8), (-5, 8), (-5, 2)))], f"id bigint, ring {g.LINE}")
    out = tools.ground_footprint(line, rect)
    r = out["merged_lines"].first()
    assert r.n_widths == 3 and 6.0 <= r.avg_width <= 6.1 and out["footprint"].count() > 100
    alone = tools.ground_footprint(line, rect.limit(0))["merged_lines"].first()
    assert alone.avg_width == footprint.DEFAULT_WIDTH
    sampled = tools.ground_footprint(line, rect, n_samples=10)["merged_lines"].first()
    assert sampled.n_widths == 9


def test_vertices_move_into_the_strip(spark):
    cells = strip(spark)
    seeds = lines_of(spark, (1, P((4.5, 15.5), (20, 19.5))), (2, P((20, 19.5), (35.5, 15.5))))
    out = tools.vertex_optimization(seeds, cells, 10.0, 12.0)
    v = {(r.x, r.y): (r.nx, r.ny) for r in out["vertices"].collect()}
    assert abs(v[20.0, 19.5][1] - 15.5) < 4.0 and out["anchors"].count() == 3
    moved = {r.id: r.pts for r in out["lines"].collect()}
    assert (moved[1][-1].x, moved[1][-1].y) == (moved[2][0].x, moved[2][0].y) == v[20.0, 19.5]


def test_three_way_vertices(spark):
    from ridgeway.operators import lines

    e = lines.ends(lines_of(spark, (1, P((0, 0), (10, 0))), (2, P((0, 0), (-10, 1))), (3, P((0, 0), (0, 10)))), 5.0)
    assert tools.anchor_pairs(e).filter("x = 0" if False else "size(ends) = 3").count() == 0
    r = tools.anchor_pairs(e, three_way=True).filter("size(ends) = 3").first()
    assert (round(r.s2.x, 6), round(r.s2.y, 6), round(r.e2.x, 6), round(r.e2.y, 6)) == (0, 5, 0, -5)


def test_seed_lines_are_cut_and_grouped(spark):
    seeds = lines_of(spark, (1, P((0, 0), (20, 0))), (2, P((10, -10), (10, 10))), (3, P((0, 50), (0, 50))))
    out = tools.check_seed_line(seeds)["lines"].collect()
    assert len(out) == 4 and {r.source for r in out} == {1, 2}
    assert len({r.bt_group for r in out if r.source == 1}) == 1 and len({r.bt_group for r in out}) == 2


def test_tool_parameters(spark):
    assert tools.checked("ground_footprint", {"max_width": "false", "offset": "20"})["max_width"] is False
    assert tools.checked("centerline", {})["line_radius"] == 15.0
    with pytest.raises(ValueError, match="no parameter"):
        tools.checked("centerline", {"x": 1})
    assert {r.tool for r in tools.parameters(spark).select("tool").distinct().collect()} == set(tools.TOOLS)


def test_stream_equals_batch(spark, tmp_path):
    df = lines_of(spark, *[(i, P((i, 0), (i, i), (i + 1, i))) for i in range(20)])
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ingest.ingest_lines(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    from ridgeway.operators import lines

    want = lines.explode_segments(lines.clean_lines(df))
    got = ingest.stored_segments(spark, str(tmp_path / "out"))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_command_line(spark, tmp_path):
    from ridgeway.plans import cli

    lines_of(spark, (1, P((0, 0), (20, 0))), (2, P((10, -10), (10, 10)))).write.parquet(str(tmp_path / "in" / "lines"))
    said = json.dumps({"in_line": str(tmp_path / "in"), "out": str(tmp_path / "out"), "use_angle_grouping": "true"})
    assert cli.main(["check_seed_line", "-i", said]) == ["lines"]
    assert spark.read.parquet(str(tmp_path / "out" / "lines")).count() == 4


def test_ground_footprints_are_trimmed_at_loose_ends(spark):
    seeds = lines_of(spark, (1, P((10, 10), (20, 10), (30, 10), (40, 10))), (2, P((40, 10), (70, 10))))
    rect = spark.createDataFrame([(9, P((0, 6), (90, 6), (90, 14), (0, 14), (0, 6)))], f"id bigint, ring {g.LINE}")
    for merge in (True, False):
        out = tools.ground_footprint(seeds, rect, merge_group=merge)
        whole, left = (out[n].toPandas() for n in ("untrimmed_footprint", "footprint"))
        assert whole.col.min() < 9 and whole.col.max() > 71
        assert left.col.min() == 10 and left.col.max() == 69 and set(left.id) == set(whole.id)
        inner = whole[whole.col.between(10, 69)]
        assert len(left.drop_duplicates(["row", "col"])) == len(inner.drop_duplicates(["row", "col"]))
        assert len(tools.ground_footprint(seeds, rect, merge_group=merge, trim_output=False)["footprint"].toPandas()) == len(whole)


def test_primary_footprints_are_cut_at_their_vertex(spark):
    seeds = lines_of(spark, (1, P((0, 30), (40, 30))), (2, P((40, 30), (80, 30))), (3, P((40, 30), (42, 70))))
    cells = footprint.buffered_cells(seeds.withColumn("r", F.lit(5.0)), "r")
    table = topology.vertex_table(seeds)
    out = footprint.trim_primary_cells(cells, table, seeds).toPandas()
    assert out[out.id == 1].col.max() == 39 and out[out.id == 2].col.min() == 40
    assert len(out[out.id == 3]) == cells.filter("id = 3").count()


def test_a_segment_cuts_cells_only_where_it_parts_them():
    r, c = (x.ravel() for x in np.mgrid[0:10, 0:10])
    assert footprint.cut_cells(r, c, (3, -5), (3, 15)).sum() == 70
    assert footprint.cut_cells(r, c, (3, 5), (3, 15)).all() and footprint.cut_cells(r, c, (20, 0), (20, 9)).all()


def test_relative_footprints_follow_the_whole_line(spark):
    cells = strip(spark)
    seeds = lines_of(spark, (1, P((2.5, 15.5), (37.5, 15.5))), (2, P((2.5, 15.5), (12.5, 15.5), (25.5, 15.5), (37.5, 15.5))), (3, P((2.5, 15.5), (2.5, 15.5), (37.5, 15.5))))
    out = tools.line_footprint_rel(seeds, cells)
    got = out["footprint"].toPandas().groupby("id").apply(lambda f: sorted(zip(f.row, f.col)), include_groups=False)
    assert len(got[1]) > 60 and got[1] == got[2] == got[3]
    p = {i: sorted(map(tuple, f.drop(columns="id").to_numpy().tolist())) for i, f in out["line_percentile"].toPandas().groupby("id")}
    assert p[1] == p[2] == p[3]


def test_rings_and_sides_around_a_bend(spark):
    from ridgeway.operators import profile

    bend = lines_of(spark, (1, P((0, 0), (10, 0), (10, 10))))
    cells = spark.createDataFrame([(x, y, h) for h, (x, y) in enumerate([(5.0, 2.5), (5.0, -2.5), (13.0, -4.0), (12.5, 5.0), (7.5, 5.0), (5.0, 12.0), (-1.0, 1.0)])], "x double, y double, h int")
    got = {r.h: (r.side, r.ring) for r in profile.ring_cells_along(bend, cells).collect()}
    assert got == {0: ("left", 2), 1: ("right", 2), 2: ("right", 5), 3: ("right", 2), 4: ("left", 2)}  # the last two are beyond the ends
    d = tools.signed_distance(np.array([(0.0, 0), (10, 0), (10, 10)]), np.array([5.0, 5, 13, 12.5, 7.5]), np.array([2.5, -2.5, -4, 5, 5]))
    assert d.tolist() == [2.5, -2.5, -5.0, -2.5, 2.5]


def test_split_ways_and_their_layers(spark):
    seeds = lines_of(spark, (1, P((0, 0), (20, 0))), (2, P((20, 0), (40, 0))), (3, P((10, -20), (10, 20))))
    rect = spark.createDataFrame([(9, [P((-5, -3), (45, -3), (45, 3), (-5, 3), (-5, -3)), P((5, -1), (6, -1), (6, 1), (5, -1))])], f"id bigint, rings array<{g.LINE}>")
    out = tools.ground_footprint(seeds, rect, merge_group=False, n_samples=4)
    assert out["merged_lines"].count() == 4 == out["split_centerline"].count()  # the way 1-2 is cut once, and so is 3
    assert [(r.x, r.y) for r in out["inter_points"].collect()] == [(10.0, 0.0)] and out["invalid_splits"].count() == 0
    assert len(out["footprint_no_holes"].first().ring) == 5 and out["perp_lines"].count() > 0
    of = {r.bt_group: r.max_width for r in out["merged_lines"].collect()}
    assert all(r.max_width == of[r.bt_group] for r in out["merged_lines"].collect()) and len(of) == 2  # the widths of a way are its largest
    together = tools.ground_footprint(seeds, rect, merge_group=True, trim_output=False)
    assert together["merged_lines"].count() == 3 and "inter_points" not in together


def test_widths_count_polygons_of_the_own_group_only(spark):
    line = lines_of(spark, (1, P((0, 5), (5, 5.5), (10, 5)))).withColumn("bt_group", F.lit(7))
    ring = P((-5, 2), (25, 2), (25, 8), (-5, 8), (-5, 2))
    for group, n in ((7, 1), (8, 0)):
        rect = spark.createDataFrame([(9, ring, group)], f"id bigint, ring {g.LINE}, bt_group int")
        assert tools.ground_footprint(line, rect, trim_output=False)["merged_lines"].first().n_widths == n


def test_cells_near_lines_are_those_of_a_plain_version(spark):
    rng = np.random.default_rng(2)
    made = [(i, [tuple(map(float, p)) for p in rng.integers(-30, 30, (int(rng.integers(2, 5)), 2))]) for i in range(30)] + [(40, [(0.0, 0.0), (300.0, 300.0)]), (41, [(1.0, 1.0), (1.0, 1.0)])]
    rows = lines_of(spark, *[(i, P(*pts)) for i, pts in made]).withColumn("r", F.col("id") % 4 + 0.5)
    for cell in (1.0, 2.5):
        found = {}
        for r in footprint.buffered_cells(rows, "r", cell).collect():
            assert (r.row, r.col) not in found.setdefault(r.id, set())
            found[r.id].add((r.row, r.col))
        for i, pts in made[:-1]:
            radius, want = i % 4 + 0.5, set()
            xs, ys = zip(*pts)
            for row in range(int((min(ys) - radius) // cell), int((max(ys) + radius) // cell) + 1):
                for col in range(int((min(xs) - radius) // cell), int((max(xs) + radius) // cell) + 1):
                    for a, b in zip(np.array(pts[:-1]), np.array(pts[1:])):
                        d, p = b - a, np.array([(col + 0.5) * cell, (row + 0.5) * cell])
                        if d.any() and ((a + d * min(1, max(0, float((p - a) @ d) / float(d @ d))) - p) ** 2).sum() <= radius * radius:
                            want.add((row, col))
            assert found.get(i, set()) == want, i
        assert 41 not in found


def test_shared_folder_is_asked_for_off_local_mode(spark):
    from types import SimpleNamespace

    from ridgeway import session

    none = SimpleNamespace(isDefined=lambda: False)
    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://a:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none))))
    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(far)


def test_dissolved_cells_carry_their_group_instead_of_a_join(spark, small):
    from ridgeway.registry import registered

    rows = spark.createDataFrame([(1, P((0, 0), (3, 0)), 1.0, 7), (2, P((1, 0), (4, 0)), 1.0, 7), (3, P((0, 9), (2, 9)), 1.0, 8)], f"id bigint, pts {g.LINE}, r double, grp bigint")
    cells = footprint.buffered_cells(rows, "r", keep=("grp",))
    assert {(r.id, r.grp) for r in cells.collect()} == {(1, 7), (2, 7), (3, 8)}
    first = {(r.grp, r.row, r.col): r.id for r in footprint.dissolve_cells(cells, "grp", "id").collect()}
    assert first.keys() == {tuple(r) for r in footprint.dissolve_cells(cells, "grp").collect()}
    assert first[7, 0, 0] == 1 and first[7, 0, 4] == 2 and {v for k, v in first.items() if k[0] == 8} == {3}
    # There are hundreds of cells a line, which no estimate knows: nothing above them may be a join, which could broadcast them.
    plan = registered()["dissolve"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan[: plan.index("MapInArrow")]


def test_lines_dissolve_square_by_square_to_the_union_of_their_cells(spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = [(i, P(*rng.integers(-400, 400, (int(rng.integers(1, 4)), 2)).tolist()), float(rng.integers(0, 6)), None if i % 7 == 0 else i % 3) for i in range(60)]
    data += [(60, P((255, -20), (257, 20)), 0.4, 8), (61, P((3, 3), (3, 3)), 5.0, 9), (None, P((0, 0), (9, 9)), 2.0, 9), (62, P((0, 0), (9, 9)), None, 9), (63, None, 2.0, 9)]
    rows = spark.createDataFrame(data, f"id bigint, pts {g.LINE}, r double, grp bigint")
    for cell in (1.0, 2.5):
        want: dict = {}
        for x in footprint.buffered_cells(rows, "r", cell, keep=("grp",)).collect():
            cells = want.setdefault((x.grp, x.row // 256, x.col // 256), {})
            cells[x.row, x.col] = min(x.id, cells.get((x.row, x.col), x.id))
        got = footprint.dissolve_lines(rows, "r", "grp", cell).collect()
        assert len(got) == len(want) and 9 not in {x.grp for x in got}
        for x in got:
            cells = want[x.grp, x.row // 256, x.col // 256]
            assert [(x.row + i // 256, x.col + i % 256) for i in x.cells] == sorted(cells) and x.first == min(cells.values())


def test_the_union_of_a_square_goes_on_over_batches_and_parts_of_them(monkeypatch):
    monkeypatch.setattr(footprint, "_UNITED", 100)
    n = 50
    columns = {"grp": ["a"] * 45 + [None] * 5, "row": [0] * n, "col": [0] * 40 + [256] * 10, "id": list(range(100, 100 + n)), "r": [2.0] * n}
    columns |= {"ax": [240.0] * n, "ay": [float(i % 9) for i in range(n)], "bx": [270.0] * n, "by": [float(i % 5) for i in range(n)]}
    table = footprint.pa.table(columns)
    units = [x for b in footprint._united(iter(table.to_batches(max_chunksize=7)), 1.0) for x in b.to_pylist()]
    assert [(x["grp"], x["col"], x["first"]) for x in units] == [("a", 0, 100), ("a", 256, 140), (None, 256, 145)]
    for x, (i, j) in zip(units, ((0, 40), (40, 45), (45, 50))):
        seg = [np.array(columns[c][i:j]) for c in ("ax", "ay", "bx", "by", "r")]
        _, row, col = footprint.capsule_cells(*seg)
        assert x["cells"] == sorted({int(a) * 256 + int(b) - x["col"] for a, b in zip(row, col) if 0 <= a < 256 and x["col"] <= b < x["col"] + 256})


def test_dissolve_deals_no_cells(spark, small):
    from ridgeway.registry import registered

    plan = registered()["dissolve"](spark, small)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    dealt = next(i for i, x in enumerate(plan) if "RepartitionByExpression" in x)
    assert "MapInArrow" in plan[dealt + 1] and "cells" not in plan[dealt + 1]


def test_no_side_of_a_grid_join_is_broadcast_as_a_whole(spark, small):
    from ridgeway.registry import registered

    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        for name in ("vertex_in_polygon", "widths", "group_max", "containing_polygon", "clip_polygons"):
            plan = registered()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
            joins = [x for x in plan.splitlines() if "hx#" in x and "Join" in x]
            assert joins and all("SortMergeJoin" in x for x in joins), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_a_sparse_grid_join_gives_the_same_pairs(spark):
    box = spark.createDataFrame([(i, 7.0 * i, 0.0, 7.0 * i + 9, 9.0) for i in range(20)], "id int, x0 double, y0 double, x1 double, y1 double")
    cell = spark.createDataFrame([(10 * i, 4.0 + 20 * i, 4.0) for i in range(3)] + [(99, -50.0, 4.0)], "c int, x double, y double")
    got = [sorted(tuple(r) for r in spatial_join.grid_join(box, cell, ["x0", "y0", "x1", "y1"], ["x", "y", "x", "y"], 8.0, sparse=s).select("id", "c").collect()) for s in (False, True)]
    assert got[0] == got[1] == sorted((i, 10 * k) for i in range(20) for k in range(3) if 7 * i <= 4 + 20 * k <= 7 * i + 9)


def test_stations_as_an_array_are_those_of_densified_lines(spark):
    from ridgeway.operators import lines

    rows = lines_of(spark, (1, P((0, 0), (2.5, 0), (2.5, 0), (3, 4))), (2, P((0, 0), (0.5, 0))), (3, P((1, 1))))
    whole = {r.id: r.pts for r in lines.densify(rows).collect()}
    dense = {r.id: r.p for r in rows.select("id", lines.dense(F.col("pts")).alias("p")).collect()}
    assert dense.pop(3) == [] and dense == whole
    ring = spark.createDataFrame([(7, P((0, 0), (12, 0), (12, 9), (9, 9), (9, 3), (3, 3), (3, 9), (0, 9), (0, 0)))], f"id bigint, ring {g.LINE}")
    across = lines_of(spark, (1, P((1, 8), (11, 8))), (2, P((1, 2), (11, 2))))  # the first leaves the ring between its ends
    found = footprint.containing_polygon(across, ring)
    assert [tuple(r) for r in found.collect()] == [(2, 7)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1  # stations are made after the join, without a shuffle of their own


def test_features_get_their_cells_as_arrays_dealt_by_number(spark):
    import pandas as pd

    feature = lines_of(spark, (1, P((1, 1), (6, 1))), (2, P((3, 3), (3, 9))), (3, P((900, 900), (910, 900))))
    raster_cells = spark.createDataFrame([(r, c, c + 0.5, r + 0.5, None if r == c else float(r)) for r in range(10) for c in range(10)], "row long, col long, x double, y double, h double")
    met = tools.near_cells(feature, raster_cells, 2.0)
    plain = {i: {(r.row, r.col, r.h) for r in met.filter(F.col("id") == i).collect()} for i in (1, 2)}
    assert met.filter("id = 3").count() == 0 and all(plain.values())

    def run(one):
        return pd.DataFrame({"id": one["id"], "n": len(one["pts"]), "row": one["row"], "col": one["col"], "h": one["h"]})

    out = tools.per_feature(met, ["id"], run, "id bigint, n int, row bigint, col bigint, h double")
    got = {}
    for r in out.collect():
        assert r.n == 2
        got.setdefault(r.id, set()).add((r.row, r.col, None if r.h is None or r.h != r.h else r.h))
    assert got == plain
    # Neither the join nor the kernels may be left to the few tasks that their bytes ask for.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 3
