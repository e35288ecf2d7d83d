"""Queries of the tools, over whole layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeway.functions import geom as g
from ridgeway.functions.geom import r6
from ridgeway.operators import lines, topology, footprint
from ridgeway.plans import fixtures as fx
from ridgeway.plans import tools
from ridgeway.plans.line_queries import R, q
from ridgeway.plans.network_queries import _SL, clean_seg
from ridgeway.registry import query
from ridgeway.sources import layers


@q("number_rows", "SELECT id, row_number() OVER (ORDER BY id) - 1 AS bt_uid FROM seg", fx.SEG)
def number_rows(spark, sf):
    return layers.numbered(fx.seg(spark, sf).select("id"), "id").select("id", "bt_uid")


@q(
    "anchor_pairs",
    f"""SELECT x, y, CAST(n AS INTEGER) AS n, {R('CASE WHEN n = 4 THEN o1x ELSE e1x END', 's1x')}, {R('CASE WHEN n = 4 THEN o1y ELSE e1y END', 's1y')},
               {R('CASE WHEN n = 4 THEN o3x WHEN n = 2 THEN e2x ELSE 2 * x - e1x END', 'e1x')}, {R('CASE WHEN n = 4 THEN o3y WHEN n = 2 THEN e2y ELSE 2 * y - e1y END', 'e1y')},
               {R('CASE WHEN n = 4 THEN o2x END', 's2x')}, {R('CASE WHEN n = 4 THEN o2y END', 's2y')}
        FROM piv WHERE n IN (1, 2) OR (n = 4 AND least(o1x, o2x, o3x, o4x) > -100 AND greatest(o1x, o2x, o3x, o4x) < 3000 AND least(o1y, o2y, o3y, o4y) > -100 AND greatest(o1y, o2y, o3y, o4y) < 10000)""",
    fx.SEG,
    _SL,
    """en AS (SELECT id, 0 AS "end", x1 AS x, y1 AS y, x2 AS qx, y2 AS qy FROM sl UNION ALL SELECT id, -1, x2, y2, x1, y1 FROM sl),
an AS (SELECT *, x + (qx - x) * 30 / sqrt((qx-x)*(qx-x)+(qy-y)*(qy-y)) AS ax, y + (qy - y) * 30 / sqrt((qx-x)*(qx-x)+(qy-y)*(qy-y)) AS ay,
              CASE WHEN abs(qx - x) <= 1e-8 + 1e-5 * abs(qx) THEN CASE WHEN qy < y THEN -pi() / 2 ELSE pi() / 2 END ELSE atan((qy - y) / (qx - x)) + CASE WHEN qx < x THEN pi() ELSE 0 END END AS slope FROM en),
rk AS (SELECT *, count(*) OVER (PARTITION BY x, y) AS n, row_number() OVER (PARTITION BY x, y ORDER BY id, "end") AS k, row_number() OVER (PARTITION BY x, y ORDER BY slope, id, "end") AS s FROM an),
piv AS (SELECT x, y, any_value(n) AS n, max(ax) FILTER (WHERE k = 1) AS e1x, max(ay) FILTER (WHERE k = 1) AS e1y, max(ax) FILTER (WHERE k = 2) AS e2x, max(ay) FILTER (WHERE k = 2) AS e2y,
               max(ax) FILTER (WHERE s = 1) AS o1x, max(ay) FILTER (WHERE s = 1) AS o1y, max(ax) FILTER (WHERE s = 2) AS o2x, max(ay) FILTER (WHERE s = 2) AS o2y,
               max(ax) FILTER (WHERE s = 3) AS o3x, max(ay) FILTER (WHERE s = 3) AS o3y, max(ax) FILTER (WHERE s = 4) AS o4x, max(ay) FILTER (WHERE s = 4) AS o4y FROM rk GROUP BY x, y)""",
)
def anchor_pairs(spark, sf):
    v = tools.anchor_pairs(lines.ends(clean_seg(spark, sf), 30.0), (-100.0, -100.0, 3000.0, 10000.0))
    named = {"s1x": "s1.x", "s1y": "s1.y", "e1x": "e1.x", "e1y": "e1.y", "s2x": "s2.x", "s2y": "s2.y"}
    return v.select(F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.size("ends").alias("n"), *[r6(F.col(c)).alias(n) for n, c in named.items()])


@q("simplify_dp", f"SELECT id, {R('sqrt((fx-lx)*(fx-lx)+(fy-ly)*(fy-ly))', 'chord')} FROM (SELECT id, arg_min(x, i) AS fx, arg_min(y, i) AS fy, arg_max(x, i) AS lx, arg_max(y, i) AS ly FROM track GROUP BY id)", fx.TRACK)
def simplify_dp(spark, sf):
    """Ends stay, whatever the tolerance; tests hold the points between against a plain version."""
    s = topology.simplified(fx.track(spark, sf), 5.0)
    return s.select("id", r6(g.point_distance(F.element_at("pts", 1), F.element_at("pts", -1))).alias("chord"))


@query("simplify_dp_kept")
def simplify_dp_kept(spark, sf):
    """What is left of each line: how many points, how long, and a digest of the points. SQL has no such recursion over a line."""
    s = topology.simplified(fx.track(spark, sf), 150.0)
    told = F.array_join(F.transform("pts", lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ",")
    return s.select("id", F.size("pts").alias("n_points"), r6(g.length(F.col("pts"))).alias("length"), F.md5(told.cast("binary")).alias("digest"))


@query("tool_check_seed_line")
def tool_check_seed_line(spark, sf):
    out = tools.check_seed_line(fx.seg_lines(spark, sf))["lines"]
    return out.select("source", "piece", "bt_group", r6(g.length(F.col("pts"))).alias("length"))


@query("tool_centerline")
def tool_centerline(spark, sf):
    out = tools.centerline(fx.seg_lines(spark, sf), fx.mosaic(spark, sf))["centerline"]
    return out.select("id", "seg", "cl_status", F.size("pts").alias("n_points"), r6(g.length(F.col("pts"))).alias("length"))


@query("tool_footprint_abs")
def tool_footprint_abs(spark, sf):
    out = tools.canopy_footprint_abs(fx.seg_lines(spark, sf), fx.mosaic(spark, sf))["footprint"]
    return out.groupBy("id").agg(F.count(F.lit(1)).alias("n_cells"))


@query("tool_footprint_rel")
def tool_footprint_rel(spark, sf):
    out = tools.line_footprint_rel(fx.seg_lines(spark, sf), fx.mosaic(spark, sf))["footprint"]
    return out.groupBy("id").agg(F.count(F.lit(1)).alias("n_cells"))


@query("tool_footprint_rel_track")
def tool_footprint_rel_track(spark, sf):
    """Lines of several points: every twentieth track, on a twentieth of its scale."""
    pts = F.transform("pts", lambda p: g.point(p["x"] / 20, p["y"] / 20))
    out = tools.line_footprint_rel(fx.track(spark, sf).filter("id % 20 = 0").select("id", pts.alias("pts")), fx.mosaic(spark, sf))["footprint"]
    return out.groupBy("id").agg(F.count(F.lit(1)).alias("n_cells"))


@query("tool_ground_footprint")
def tool_ground_footprint(spark, sf):
    out = tools.ground_footprint(clean_seg(spark, sf), fx.rings(spark, sf), cell=4.0)
    cells = out["footprint"].groupBy("id").agg(F.count(F.lit(1)).alias("n_cells"))
    return out["merged_lines"].join(cells, "id", "left").select("id", "bt_group", r6("avg_width").alias("avg_width"), r6("max_width").alias("max_width"), r6("length").alias("length"), "n_cells")


@query("tool_vertex_opt")
def tool_vertex_opt(spark, sf):
    out = tools.vertex_optimization(fx.seg_lines(spark, sf), fx.mosaic(spark, sf), search_distance=10.0, line_radius=5.0)["lines"]
    return out.select("id", "seg", r6(g.length(F.col("pts"))).alias("length"))


@query("lc_path")
def lc_path(spark, sf):
    out = tools.centerline(fx.seg_lines(spark, sf), fx.mosaic(spark, sf), proc_segments=False)["least_cost_path"]
    return out.select("id", F.size("pts").alias("n_points"), r6(g.length(F.col("pts"))).alias("length"))


def _fans(spark, sf):
    """Lines that meet, each with a square of its own around it, for trimming."""
    s = clean_seg(spark, sf)
    b = g.bounds(F.col("pts"))
    box = s.withColumn("b", b).select("id", *[(F.col(f"b.{n}") + (3 if n[1] == "1" else -3)).alias(n) for n in ("x0", "y0", "x1", "y1")])
    return s, box.select("id", fx.rectangle().alias("ring"))


@query("trim_ends")
def trim_ends(spark, sf):
    s, polys = _fans(spark, sf)
    out = footprint.trim_ends(polys, topology.vertex_table(s), s)
    return out.select("id", r6(g.ring_area(F.col("ring"))).alias("area"))


@query("trim_intersections")
def trim_intersections(spark, sf):
    s = clean_seg(spark, sf)
    cells = footprint.buffered_cells(s.withColumn("r", F.lit(2.0)), "r")
    return footprint.trim_intersections(cells, topology.vertex_table(s), s).groupBy("id").agg(F.count(F.lit(1)).alias("n_cells"))


@q("tool_parameters", "SELECT 1 AS one, CAST(42 AS BIGINT) AS n")
def tool_parameters(spark, sf):
    return tools.parameters(spark).agg(F.count(F.lit(1)).alias("n")).select(F.lit(1).alias("one"), "n")
