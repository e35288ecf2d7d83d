"""Queries of the topology and footprint operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeway.functions import geom as g
from ridgeway.functions.geom import r6
from ridgeway.operators import footprint, lines, topology
from ridgeway.plans import fixtures as fx
from ridgeway.plans.line_queries import R, q
from ridgeway.registry import query


def clean_seg(spark, sf):
    return lines.clean_lines(fx.seg_lines(spark, sf))


_SL = "sl AS (SELECT * FROM seg WHERE x1 <> x2 OR y1 <> y2)"
_BOX = "bx AS (SELECT *, least(x1, x2) AS lx, greatest(x1, x2) AS hx, least(y1, y2) AS ly, greatest(y1, y2) AS hy FROM sl)"
_NEAR = "JOIN bx b ON a.id < b.id AND a.lx <= b.hx AND b.lx <= a.hx AND a.ly <= b.hy AND b.ly <= a.hy"


@q(
    "crossings",
    f"""SELECT a, b, {R('ax + dx * t', 'x')}, {R('ay + dy * t', 'y')} FROM (
          SELECT a.id AS a, b.id AS b, a.x1 AS ax, a.y1 AS ay, a.x2 - a.x1 AS dx, a.y2 - a.y1 AS dy,
                 ((b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1)) / ((a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1)) AS t
          FROM bx a {_NEAR}
          WHERE ((a.x2-a.x1)*(b.y1-a.y1) - (a.y2-a.y1)*(b.x1-a.x1)) * ((a.x2-a.x1)*(b.y2-a.y1) - (a.y2-a.y1)*(b.x2-a.x1)) < 0
            AND ((b.x2-b.x1)*(a.y1-b.y1) - (b.y2-b.y1)*(a.x1-b.x1)) * ((b.x2-b.x1)*(a.y2-b.y1) - (b.y2-b.y1)*(a.x2-b.x1)) < 0)""",
    fx.SEG,
    _SL,
    _BOX,
)
def crossings(spark, sf):
    return topology.crossings(clean_seg(spark, sf)).select("a", "b", r6("x").alias("x"), r6("y").alias("y"))


#: What two lines have in common, for two-point lines or the segments of longer ones (id, x1, y1, x2, y2).
_MEET = f"""pr AS (
  SELECT a.id AS a, b.id AS b, a.x1 AS ax, a.y1 AS ay, a.x2 - a.x1 AS dx, a.y2 - a.y1 AS dy, b.x2 - b.x1 AS ex, b.y2 - b.y1 AS ey, b.x1 - a.x1 AS fx, b.y1 - a.y1 AS fy
  FROM bx a {_NEAR}),
pd AS (SELECT *, dx * ey - dy * ex AS d, dx * dx + dy * dy AS n FROM pr),
pt AS (SELECT *, CASE WHEN d <> 0 THEN (fx * ey - fy * ex) / d END AS t, CASE WHEN d <> 0 THEN (fx * dy - fy * dx) / d END AS u,
              greatest(least((fx * dx + fy * dy) / n, ((fx + ex) * dx + (fy + ey) * dy) / n), 0) AS lo, least(greatest((fx * dx + fy * dy) / n, ((fx + ex) * dx + (fy + ey) * dy) / n), 1) AS hi,
              d = 0 AND fx * dy - fy * dx = 0 AS aligned FROM pd),
hit AS (SELECT a, b, ax, ay, dx, dy, CASE WHEN d <> 0 THEN CASE WHEN t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 THEN t END WHEN aligned AND lo = hi THEN lo END AS tt,
               CASE WHEN aligned AND lo < hi THEN (lo + hi) / 2 END AS mid, lo, hi FROM pt),
met AS (SELECT a, b, round(ax + dx * coalesce(tt, mid), 6) AS x, round(ay + dy * coalesce(tt, mid), 6) AS y, mid IS NOT NULL AS overlap,
               round(ax + dx * lo, 6) AS ex0, round(ay + dy * lo, 6) AS ey0, round(ax + dx * hi, 6) AS ex1, round(ay + dy * hi, 6) AS ey1
        FROM hit WHERE tt IS NOT NULL OR mid IS NOT NULL)"""


@q(
    "split_lines",
    f"""SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY "from") - 1 AS INTEGER) AS piece, {R('"from"', '"from"')}, {R('"to" - "from"', 'length')}
        FROM (SELECT id, c AS "from", lead(c) OVER (PARTITION BY id ORDER BY c) AS "to" FROM cut) WHERE "to" - "from" > 0.001""",
    fx.SEG,
    _SL,
    _BOX,
    _MEET,
    """pc AS (SELECT a AS id, x, y FROM met UNION SELECT b, x, y FROM met),
cut AS (
  SELECT id, len * least(greatest(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (len * len), 0), 1) AS c
  FROM (SELECT s.*, x, y, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) AS len FROM pc JOIN sl s USING (id))
  WHERE least(sqrt((x-x1)*(x-x1)+(y-y1)*(y-y1)), sqrt((x-x2)*(x-x2)+(y-y2)*(y-y2))) >= 1e-5
  UNION ALL SELECT id, CAST(0 AS DOUBLE) FROM sl UNION ALL SELECT id, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) FROM sl)""",
)
def split_lines(spark, sf):
    s = clean_seg(spark, sf)
    out = topology.split_lines(s, topology.meetings(s))
    first = s.select("id", F.col("pts")[0].alias("o"))
    out = out.join(first, "id").select("id", "piece", r6(g.point_distance(F.col("o"), F.col("pts")[0])).alias("from"), r6(g.length(F.col("pts"))).alias("length"))
    return out


def bent(spark, sf):
    """Lines of three points: each order's line and a short way back beside it, so that pairs meet more than once."""
    s = fx.seg(spark, sf)
    p = F.array(g.point(F.col("x1"), F.col("y1")), g.point(F.col("x2"), F.col("y2")), g.point(F.col("x1") + 3, F.col("y1") - 2))
    return s.select("id", g.without_repeats(p).alias("pts")).filter(F.size("pts") >= 2)


@q(
    "inter_status",
    """SELECT DISTINCT sl0.id, CASE WHEN bad.id IS NULL THEN 1 ELSE 0 END AS inter_status FROM (SELECT DISTINCT id FROM sl) sl0 LEFT JOIN bad ON bad.id = sl0.id""",
    fx.SEG,
    """sl AS (SELECT id, x1, y1, x2, y2 FROM seg WHERE x1 <> x2 OR y1 <> y2
           UNION ALL SELECT id, x2, y2, x1 + 3, y1 - 2 FROM seg WHERE x2 <> x1 + 3 OR y2 <> y1 - 2)""",
    _BOX,
    _MEET,
    """mp AS (SELECT DISTINCT m.a, m.b, m.x, m.y FROM met m WHERE NOT overlap AND NOT EXISTS (SELECT 1 FROM met o WHERE o.a = m.a AND o.b = m.b AND o.overlap
             AND ((o.ex0 = m.x AND o.ey0 = m.y) OR (o.ex1 = m.x AND o.ey1 = m.y)))),
mo AS (SELECT a, b, count(DISTINCT (x, y)) AS k FROM met WHERE overlap GROUP BY 1, 2),
mk AS (SELECT a, b, count(*) AS k FROM mp GROUP BY 1, 2),
md AS (SELECT p.a, p.b, min(sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y))) AS d FROM mp p JOIN mp q ON p.a = q.a AND p.b = q.b AND (p.x, p.y) < (q.x, q.y) GROUP BY 1, 2),
bp AS (SELECT a, b FROM md LEFT JOIN mo USING (a, b) WHERE mo.k IS NULL AND d <= 2
       UNION SELECT a, b FROM mo LEFT JOIN mk USING (a, b) WHERE mo.k > 1 OR coalesce(mk.k, 0) > 0),
bad AS (SELECT a AS id FROM bp UNION SELECT b FROM bp)""",
)
def inter_status(spark, sf):
    s = bent(spark, sf)
    return topology.intersection_status(s, topology.meetings(s))


_V = """ve AS (SELECT id, 0 AS "end", x1 AS x, y1 AS y, atan2(y2 - y1, x2 - x1) AS ang FROM sl UNION ALL SELECT id, -1, x2, y2, atan2(y1 - y2, x1 - x2) FROM sl),
vn AS (SELECT *, count(*) OVER (PARTITION BY x, y) AS n, row_number() OVER (PARTITION BY x, y ORDER BY id, "end") AS k FROM ve)"""
_PAIRS = """prs AS (
  SELECT a.x, a.y, a.id AS a, b.id AS b FROM vn a JOIN vn b ON a.x = b.x AND a.y = b.y AND a.n = 2 AND a.k = 1 AND b.k = 2
  UNION ALL
  SELECT x, y, arg_min(a, ka), b FROM (
    SELECT a.x, a.y, a.id AS a, a.k AS ka, b.id AS b, b.k AS kb, abs(a.ang - b.ang) AS d FROM vn a JOIN vn b ON a.x = b.x AND a.y = b.y AND a.n > 2 AND a.k < b.k)
  WHERE CASE WHEN d <= pi() THEN d ELSE d - pi() END < pi() / 10 OR (d > pi() - pi() / 10 AND d < pi() + pi() / 10) GROUP BY x, y, b, kb)"""


@q("snap_vertices", """SELECT x, y, CAST(count(*) AS INTEGER) AS n_ends, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id, "end") AS lines FROM ve GROUP BY x, y""", fx.SEG, _SL, _V)
def snap_vertices(spark, sf):
    v = topology.vertices(topology.line_ends(clean_seg(spark, sf)))
    return v.select("x", "y", F.size("ends").alias("n_ends"), F.array_join(F.transform("ends", lambda e: e["id"].cast("string")), ",").alias("lines"))


@q("pair_by_angle", "SELECT x, y, a, b FROM prs", fx.SEG, _SL, _V, _PAIRS)
def pair_by_angle(spark, sf):
    v = topology.vertices(topology.line_ends(clean_seg(spark, sf)))
    return v.select("x", "y", F.explode(topology.pairs_by_angle(F.col("ends"))).alias("p")).select("x", "y", "p.a", "p.b")


@q(
    "pair_by_group",
    """SELECT x, y, arg_max(a.id, a.k) AS a, b.id AS b FROM (SELECT vn.*, o_custkey % 3 AS grp FROM vn JOIN orders ON o_orderkey = id) a
       JOIN (SELECT vn.*, o_custkey % 3 AS grp FROM vn JOIN orders ON o_orderkey = id) b USING (x, y) WHERE a.k < b.k AND a.grp = b.grp AND NOT EXISTS (
         SELECT 1 FROM vn c JOIN orders ON o_orderkey = c.id WHERE c.x = a.x AND c.y = a.y AND c.k < a.k AND o_custkey % 3 = a.grp) GROUP BY x, y, b.id, b.k""",
    fx.SEG,
    _SL,
    _V,
)
def pair_by_group(spark, sf):
    ends = topology.line_ends(clean_seg(spark, sf))
    group = fx.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 3).alias("grp"))
    v = topology.vertices(ends.join(group, "id"), keep=("grp",))
    return v.select("x", "y", F.explode(topology.groups_at_vertex(F.col("ends"))).alias("p")).select("x", "y", "p.a", "p.b")


@q(
    "vertex_class",
    """SELECT v.x, v.y, CAST(n AS INTEGER) AS n_ends, CAST(coalesce(k, 0) AS INTEGER) AS n_pairs,
              CASE WHEN n = 1 THEN 10 WHEN n = 2 AND coalesce(k, 0) = 0 THEN 1 WHEN n = 3 AND coalesce(k, 0) < 2 THEN 2 + coalesce(k, 0)
                   WHEN n = 4 AND coalesce(k, 0) < 3 THEN 4 + coalesce(k, 0) WHEN n = 5 AND coalesce(k, 0) < 3 THEN 7 + coalesce(k, 0) END AS class,
              CAST(n_ids - coalesce(used, 0) AS INTEGER) AS n_unconnected
       FROM (SELECT x, y, count(*) AS n, count(DISTINCT id) AS n_ids FROM ve GROUP BY 1, 2) v LEFT JOIN (SELECT x, y, count(*) AS k FROM prs GROUP BY 1, 2) USING (x, y)
       LEFT JOIN (SELECT x, y, count(DISTINCT id) AS used FROM (SELECT x, y, a AS id FROM prs UNION ALL SELECT x, y, b FROM prs) GROUP BY 1, 2) USING (x, y)""",
    fx.SEG,
    _SL,
    _V,
    _PAIRS,
)
def vertex_class(spark, sf):
    t = topology.vertex_table(clean_seg(spark, sf))
    return t.select("x", "y", F.size("ends").alias("n_ends"), F.size("connected").alias("n_pairs"), "class", F.size("not_connected").alias("n_unconnected"))


_GROUPS = """ed AS (SELECT a, b FROM prs WHERE a <> b UNION SELECT b, a FROM prs WHERE a <> b),
l(id, g) USING KEY (id) AS (
  SELECT id, id FROM sl
  UNION
  SELECT e.b, min(l.g) FROM l JOIN ed e ON e.a = l.id JOIN recurring.l r ON r.id = e.b WHERE l.g < r.g GROUP BY e.b)"""


@query("line_groups", f"WITH RECURSIVE {fx.SEG}, {_SL}, {_V}, {_PAIRS}, {_GROUPS} SELECT id, g AS bt_group FROM l")
def line_groups(spark, sf):
    s = clean_seg(spark, sf)
    return topology.line_groups(s, topology.vertex_table(s))


@query(
    "merge_lines",
    f"WITH RECURSIVE {fx.SEG}, {_SL}, {_V}, {_PAIRS}, {_GROUPS} SELECT g AS bt_group, {R('sum(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))', 'length')} FROM l JOIN sl USING (id) GROUP BY g",
)
def merge_lines(spark, sf):
    s = clean_seg(spark, sf)
    merged = topology.merge_lines(s.join(topology.line_groups(s, topology.vertex_table(s)), "id"))
    return merged.groupBy("bt_group").agg(r6(F.sum(g.length(F.col("pts")))).alias("length"))


@q(
    "merge_or_explode",
    f"""SELECT o_custkey AS id, {R('sum(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))', 'length')} FROM sl JOIN orders ON o_orderkey = sl.id GROUP BY 1""",
    fx.SEG,
    _SL,
)
def merge_or_explode(spark, sf):
    s = clean_seg(spark, sf).join(fx.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust")), "id")
    parts = s.groupBy(F.col("cust").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "pts"))), lambda r: r["pts"]).alias("parts"))
    return topology.merge_or_explode(parts).groupBy("id").agg(r6(F.sum(g.length(F.col("pts")))).alias("length"))


@q(
    "close_points",
    """SELECT a.id AS a, a."end" AS a_end, b.id AS b, b."end" AS b_end FROM ve a JOIN ve b ON a.x < b.x + 2 AND a.x > b.x - 2 AND a.y < b.y + 2 AND a.y > b.y - 2 AND a.id < b.id""",
    fx.SEG,
    _SL,
    _V,
)
def close_points(spark, sf):
    from ridgeway.operators.spatial_join import grid_join

    e = topology.line_ends(clean_seg(spark, sf)).select("id", "end", "x", "y")
    far = g.CLOSE
    a = e.select(F.col("id").alias("a"), F.col("end").alias("a_end"), "x", "y", (F.col("x") - far).alias("x0"), (F.col("y") - far).alias("y0"), (F.col("x") + far).alias("x1"), (F.col("y") + far).alias("y1"))
    b = e.select(F.col("id").alias("b"), F.col("end").alias("b_end"), F.col("x").alias("u"), F.col("y").alias("v"))
    near = (F.abs(F.col("x") - F.col("u")) < far) & (F.abs(F.col("y") - F.col("v")) < far) & (F.col("a") < F.col("b"))
    return grid_join(a, b, ["x0", "y0", "x1", "y1"], ["u", "v", "u", "v"], 8.0, near).select("a", "a_end", "b", "b_end")


@q(
    "line_intersections",
    f"""SELECT a, b, {R('avg(x)', 'x')}, {R('avg(y)', 'y')} FROM (SELECT DISTINCT a, b, x, y FROM met) GROUP BY a, b""",
    fx.SEG,
    _SL,
    _BOX,
    _MEET,
)
def line_intersections(spark, sf):
    met = topology.meetings(clean_seg(spark, sf))
    p = met.select("a", "b", F.explode(F.concat("points", "overlaps")).alias("p"))
    return p.groupBy("a", "b").agg(r6(F.avg("p.x")).alias("x"), r6(F.avg("p.y")).alias("y"))


@q(
    "lines_x_polys",
    """SELECT s.id, p.id AS poly_id FROM bx s JOIN poly p ON s.lx <= p.x1 AND p.x0 <= s.hx AND s.ly <= p.y1 AND p.y0 <= s.hy""",
    fx.SEG,
    _SL,
    _BOX,
    fx.POLY,
)
def lines_x_polys(spark, sf):
    return footprint.lines_by_polygons(clean_seg(spark, sf), fx.rings(spark, sf))


@q(
    "lines_x_polys_group",
    """SELECT s.id, p.id AS poly_id FROM bx s JOIN poly p ON s.lx <= p.x1 AND p.x0 <= s.hx AND s.ly <= p.y1 AND p.y0 <= s.hy WHERE s.id % 10 = p.id % 10""",
    fx.SEG,
    _SL,
    _BOX,
    fx.POLY,
)
def lines_x_polys_group(spark, sf):
    s = clean_seg(spark, sf).withColumn("bt_group", F.col("id") % 10)
    return footprint.lines_by_polygons(s, fx.rings(spark, sf).withColumn("bt_group", F.col("id") % 10))


@q("vertex_in_polygon", "SELECT s.id, p.id AS poly_id FROM seg s JOIN poly p ON x2 > x0 AND x2 < p.x1 AND y2 > y0 AND y2 < p.y1", fx.SEG.replace("seg AS (", "seg0 AS (", 1), "seg AS (SELECT id, x2 + CAST(0.25 AS DOUBLE) AS x2, y2 + CAST(0.25 AS DOUBLE) AS y2 FROM seg0)", fx.POLY)
def vertex_in_polygon(spark, sf):
    s = fx.seg(spark, sf).select("id", (F.col("x2") + 0.25).alias("x"), (F.col("y2") + 0.25).alias("y"))
    return footprint.points_in_polygons(s, fx.rings(spark, sf)).select("id", "poly_id")


_TRAN = """tri AS (
  SELECT * FROM (SELECT id, i, x, y, lag(x) OVER w AS hx, lag(y) OVER w AS hy, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM track WINDOW w AS (PARTITION BY id ORDER BY i))
  WHERE hx IS NOT NULL AND nx IS NOT NULL),
tran AS (SELECT id, i, x + 15 * cos(a) AS ax, y + 15 * sin(a) AS ay, x - 15 * cos(a) AS bx, y - 15 * sin(a) AS bz
         FROM (SELECT *, atan2(hy - y, hx - x) + (atan2(ny - y, nx - x) - atan2(hy - y, hx - x)) / 2 AS a FROM tri)),
tp AS (
  SELECT t.id, t.i, ax, ay, bx, bz, x0, y0, x1, y1, bx - ax AS dx, bz - ay AS dy FROM tran t JOIN poly p
  ON least(ax, bx) <= x1 AND x0 <= greatest(ax, bx) AND least(ay, bz) <= y1 AND y0 <= greatest(ay, bz)),
lb AS (
  SELECT id, i, dx, dy, greatest(0, CASE WHEN dx <> 0 THEN least((x0 - ax) / dx, (x1 - ax) / dx) WHEN ax > x0 AND ax < x1 THEN 0 ELSE 2 END,
                                    CASE WHEN dy <> 0 THEN least((y0 - ay) / dy, (y1 - ay) / dy) WHEN ay > y0 AND ay < y1 THEN 0 ELSE 2 END) AS t0,
         least(1, CASE WHEN dx <> 0 THEN greatest((x0 - ax) / dx, (x1 - ax) / dx) ELSE 1 END, CASE WHEN dy <> 0 THEN greatest((y0 - ay) / dy, (y1 - ay) / dy) ELSE 1 END) AS t1 FROM tp),
wid AS (SELECT id, i, max((t1 - t0) * sqrt(dx * dx + dy * dy)) AS w FROM lb WHERE t1 > t0 GROUP BY 1, 2),
lw AS (
  SELECT t.id, coalesce(a, 5) AS avg_width, coalesce(m, 5) AS max_width, CAST(coalesce(n, 0) AS BIGINT) AS n_widths FROM (SELECT DISTINCT id FROM track) t
  LEFT JOIN (SELECT id, quantile_cont(w, 0.75) AS a, quantile_cont(w, 0.9) AS m, count(*) AS n FROM wid WHERE w > 1e-9 GROUP BY 1) USING (id))"""


_SHIFTED = fx.POLY.replace("poly AS (", "poly0 AS (", 1) + """,
poly AS (SELECT id, x0 + CAST(0.125 AS DOUBLE) AS x0, y0 + CAST(0.125 AS DOUBLE) AS y0, x1 + CAST(0.125 AS DOUBLE) AS x1, y1 + CAST(0.125 AS DOUBLE) AS y1 FROM poly0)"""


def _widths(spark, sf):
    t, p = fx.track(spark, sf), fx.poly(spark, sf)
    for c in ("x0", "y0", "x1", "y1"):  # off the lines' whole numbers, so that no transect runs along an edge
        p = p.withColumn(c, F.col(c) + 0.125)
    return footprint.line_widths(t, footprint.transect_widths(t, p.select("id", fx.rectangle().alias("ring")), 30.0, zeros=False))


@q("widths", f"SELECT id, {R('avg_width', 'avg_width')}, {R('max_width', 'max_width')}, n_widths FROM lw", fx.TRACK, _SHIFTED, _TRAN)
def widths(spark, sf):
    return _widths(spark, sf).select("id", r6("avg_width").alias("avg_width"), r6("max_width").alias("max_width"), "n_widths")


@q(
    "group_max",
    f"SELECT id, id % 100 AS bt_group, {R('max(avg_width) OVER (PARTITION BY id % 100)', 'avg_width')}, {R('max(max_width) OVER (PARTITION BY id % 100)', 'max_width')} FROM lw",
    fx.TRACK,
    _SHIFTED,
    _TRAN,
)
def group_max(spark, sf):
    w = _widths(spark, sf).withColumn("bt_group", F.col("id") % 100)
    return footprint.group_max(w).select("id", "bt_group", r6("avg_width").alias("avg_width"), r6("max_width").alias("max_width"))


@q(
    "impute_widths",
    f"SELECT tile, pos, {R('CASE WHEN w IS NULL OR w = 0 THEN avg(w) OVER () ELSE w END', 'width')} FROM v",
    fx.CELL_ND,
    "v AS (SELECT tile, pos, CASE WHEN h < 1 THEN CAST(0 AS DOUBLE) ELSE h END AS w FROM cell)",
)
def impute_widths(spark, sf):
    c = fx.cells(spark, sf, nodata=True).select("tile", "pos", F.when(F.col("h") < 1, 0.0).otherwise(F.col("h")).alias("width"))
    return footprint.imputed(c, "width").select("tile", "pos", r6("width").alias("width"))


_BUF = """rr AS (SELECT *, CAST(1 + id % 5 AS DOUBLE) AS r FROM sl),
rg AS (SELECT *, unnest(range(CAST(floor(least(y1, y2) - r) AS BIGINT), CAST(floor(greatest(y1, y2) + r) AS BIGINT) + 1)) AS "row" FROM rr),
cg AS (SELECT *, unnest(range(CAST(floor(least(x1, x2) - r) AS BIGINT), CAST(floor(greatest(x1, x2) + r) AS BIGINT) + 1)) AS col FROM rg),
ct AS (SELECT *, least(greatest(((col + 0.5 - x1) * (x2 - x1) + ("row" + 0.5 - y1) * (y2 - y1)) / ((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)), 0), 1) AS t FROM cg),
buf AS (SELECT id, "row", col FROM ct WHERE (x1 + (x2-x1)*t - col - 0.5) * (x1 + (x2-x1)*t - col - 0.5) + (y1 + (y2-y1)*t - "row" - 0.5) * (y1 + (y2-y1)*t - "row" - 0.5) <= r * r)"""


def _buffers(spark, sf):
    s = clean_seg(spark, sf).withColumn("r", (1 + F.col("id") % 5).cast("double"))
    return footprint.buffered_cells(s, "r")


@q("fixed_footprint", """SELECT id, count(*) AS n_cells, CAST(min("row") AS BIGINT) AS r0, CAST(max(col) AS BIGINT) AS c1 FROM buf GROUP BY id""", fx.SEG, _SL, _BUF)
def fixed_footprint(spark, sf):
    return _buffers(spark, sf).groupBy("id").agg(F.count(F.lit(1)).alias("n_cells"), F.min("row").alias("r0"), F.max("col").alias("c1"))


@q("dissolve", """SELECT o_custkey AS bt_group, count(DISTINCT ("row", col)) AS n_cells, min(id) AS first_id FROM buf JOIN orders ON o_orderkey = id GROUP BY 1""", fx.SEG, _SL, _BUF)
def dissolve(spark, sf):
    groups = fx.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("bt_group"))
    s = clean_seg(spark, sf).join(groups, "id").withColumn("r", (1 + F.col("id") % 5).cast("double"))
    union = footprint.dissolve_lines(s, "r", "bt_group")
    return union.groupBy("bt_group").agg(F.sum(F.size("cells")).alias("n_cells"), F.min("first").alias("first_id"))


@q("valid_split", "SELECT 'valid' AS layer, count(*) AS n FROM (SELECT o_custkey FROM orders GROUP BY 1) UNION ALL SELECT 'invalid', count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)")
def valid_split(spark, sf):
    parts = fx.read(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("parts"))
    split = footprint.split_valid(parts, "parts")
    return footprint.concat_layers(*[d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("layer"), "n") for k, d in split.items()])


@q(
    "concat_layers",
    """SELECT id, 'seg' AS kind, x1, CAST(NULL AS DOUBLE) AS w FROM seg UNION ALL SELECT id, 'poly', CAST(NULL AS DOUBLE), x1 - x0 FROM poly""",
    fx.SEG,
    fx.POLY,
)
def concat_layers(spark, sf):
    a = fx.seg(spark, sf).select("id", F.lit("seg").alias("kind"), "x1")
    b = fx.poly(spark, sf).select("id", F.lit("poly").alias("kind"), (F.col("x1") - F.col("x0")).alias("w"))
    return footprint.concat_layers(a, b)


@q(
    "containing_polygon",
    """SELECT seg.id, min(poly.id) AS poly_id FROM sl seg JOIN poly ON greatest(greatest(x0 - seg.x1, 0, seg.x1 - poly.x1) * greatest(x0 - seg.x1, 0, seg.x1 - poly.x1) + greatest(y0 - seg.y1, 0, seg.y1 - poly.y1) * greatest(y0 - seg.y1, 0, seg.y1 - poly.y1),
         greatest(x0 - seg.x2, 0, seg.x2 - poly.x1) * greatest(x0 - seg.x2, 0, seg.x2 - poly.x1) + greatest(y0 - seg.y2, 0, seg.y2 - poly.y1) * greatest(y0 - seg.y2, 0, seg.y2 - poly.y1)) <= 1 GROUP BY 1""",
    fx.SEG,
    _SL,
    _SHIFTED,
)
def containing_polygon(spark, sf):
    """The first rectangle that holds a line to within 1. They are convex: the SQL looks at the ends only."""
    p = fx.poly(spark, sf)
    for c in ("x0", "y0", "x1", "y1"):
        p = p.withColumn(c, F.col(c) + 0.125)
    return footprint.containing_polygon(clean_seg(spark, sf), p.select("id", fx.rectangle().alias("ring")))


@q(
    "vertices_of_changed",
    """SELECT x, y, count(*) AS n_ends FROM (SELECT id, x1 AS x, y1 AS y FROM sl UNION ALL SELECT id, x2, y2 FROM sl) GROUP BY 1, 2 HAVING count(*) FILTER (WHERE id % 10 = 0) > 0""",
    fx.SEG,
    _SL,
)
def vertices_of_changed(spark, sf):
    s = clean_seg(spark, sf)
    at = topology.vertices_of(topology.vertex_table(s), s.filter("id % 10 = 0"))
    return at.select("x", "y", F.size("ends").cast("long").alias("n_ends"))


@q(
    "snap_end_to_end",
    """SELECT id, CASE WHEN a1 <= b1 THEN ax ELSE bx END AS x1, CASE WHEN a1 <= b1 THEN ay ELSE by_ END AS y1, CASE WHEN a2 <= b2 THEN ax ELSE bx END AS x2, CASE WHEN a2 <= b2 THEN ay ELSE by_ END AS y2
       FROM (SELECT *, (x1-ax)*(x1-ax) + (y1-ay)*(y1-ay) AS a1, (x1-bx)*(x1-bx) + (y1-by_)*(y1-by_) AS b1, (x2-ax)*(x2-ax) + (y2-ay)*(y2-ay) AS a2, (x2-bx)*(x2-bx) + (y2-by_)*(y2-by_) AS b2
             FROM (SELECT *, x2 + id % 7 AS ax, y2 - 2 AS ay, x1 + 1 AS bx, y1 + id % 5 AS by_ FROM sl))""",
    fx.SEG,
    _SL,
)
def snap_end_to_end(spark, sf):
    """Each line against one that runs the other way, a little off."""
    c = F.col
    s = clean_seg(spark, sf).withColumn("a", F.element_at("pts", 1)).withColumn("b", F.element_at("pts", -1))
    s = s.withColumn("ref", F.array(g.point(c("b.x") + c("id") % 7, c("b.y") - 2), g.point(c("a.x") + 1, c("a.y") + c("id") % 5)))
    out = lines.snap_end_to_end(s, "ref")
    return out.select("id", c("pts")[0]["x"].alias("x1"), c("pts")[0]["y"].alias("y1"), c("pts")[1]["x"].alias("x2"), c("pts")[1]["y"].alias("y2"))


@q("valid_results", "SELECT o_custkey AS id, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey % 5 <> 0 GROUP BY 1")
def valid_results(spark, sf):
    """Results by customer, some of them empty and some null."""
    parts = fx.read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey"))).alias("parts"))
    parts = parts.withColumn("parts", F.when(F.col("id") % 5 != 0, F.col("parts")))
    return footprint.valid_results(parts, "parts").select("id", F.size("parts").cast("long").alias("n"))
