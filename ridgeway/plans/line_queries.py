"""Queries of the operators on lines and polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeway.functions import geom as g
from ridgeway.functions.geom import r6
from ridgeway.operators import lines
from ridgeway.plans import fixtures as fx
from ridgeway.registry import query

PI = "pi()"
_C = F.col


def xy(col: str, x: str, y: str):
    return [r6(F.col(f"{col}.x")).alias(x), r6(F.col(f"{col}.y")).alias(y)]


def pair(col: str):
    return [*xy(f"{col}.a", "ax", "ay"), *xy(f"{col}.b", "bx", "by")]


def q(name: str, sql: str, *ctes: str):
    return query(name, (f"WITH {', '.join(ctes)} " if ctes else "") + sql)


def R(x: str, name: str) -> str:
    return f"round({x}, 6) + CAST(0 AS DOUBLE) AS {name}"


@q("line_segments", "SELECT id, CAST(i - 1 AS INTEGER) AS seg, x1, y1, x2, y2 FROM tseg", fx.TRACK)
def line_segments(spark, sf):
    out = lines.explode_segments(fx.track(spark, sf))
    return out.select("id", "seg", _C("pts")[0]["x"].alias("x1"), _C("pts")[0]["y"].alias("y1"), _C("pts")[1]["x"].alias("x2"), _C("pts")[1]["y"].alias("y2"))


@q("line_clean", f"SELECT id, {R('len', 'length')} FROM (SELECT id, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) AS len FROM seg) WHERE len > 0.001", fx.SEG)
def line_clean(spark, sf):
    out = lines.clean_lines(fx.seg_lines(spark, sf))
    return out.select("id", r6(g.length(_C("pts"))).alias("length"))


@q(
    "line_length_area",
    f"""SELECT 'line' AS kind, id, {R('sum(len)', 'length')}, CAST(0 AS DOUBLE) AS area, min(least(x1, x2)) AS x0, min(least(y1, y2)) AS y0,
               max(greatest(x1, x2)) AS x1, max(greatest(y1, y2)) AS y1, {R('sum(len * (x1 + x2) / 2) / sum(len)', 'cx')}, {R('sum(len * (y1 + y2) / 2) / sum(len)', 'cy')}
        FROM tlen GROUP BY id
        UNION ALL
        SELECT 'polygon', id, {R('2 * (x1 - x0) + 2 * (y1 - y0)', 'length')}, {R('(x1 - x0) * (y1 - y0)', 'area')}, x0, y0, x1, y1,
               {R('(x0 + x1) / 2', 'cx')}, {R('(y0 + y1) / 2', 'cy')} FROM poly""",
    fx.TRACK,
    fx.POLY,
)
def line_length_area(spark, sf):
    def measures(df, kind, area):
        b, c = g.bounds(_C("pts")), g.line_centroid(_C("pts"))
        rows = df.withColumn("b", b).withColumn("c", c)
        return rows.select(F.lit(kind).alias("kind"), "id", r6(g.length(_C("pts"))).alias("length"), r6(area).alias("area"), "b.x0", "b.y0", "b.x1", "b.y1", r6("c.x").alias("cx"), r6("c.y").alias("cy"))

    polys = fx.rings(spark, sf).withColumnRenamed("ring", "pts")
    return measures(fx.track(spark, sf), "line", F.lit(0.0)).unionByName(measures(polys, "polygon", g.ring_area(_C("pts"))))


_ENDS = """ends AS (
  SELECT id, 0 AS "end", x1 AS px, y1 AS py, x2 AS qx, y2 AS qy FROM tlen WHERE i = 1
  UNION ALL SELECT id, -1, x2, y2, x1, y1 FROM tlen WHERE i = n - 1),
ang AS (
  SELECT *, CASE WHEN abs(qx - px) <= 1e-8 + 1e-5 * abs(qx) THEN CASE WHEN qy < py THEN -pi() / 2 ELSE pi() / 2 END
                 ELSE atan((qy - py) / (qx - px)) + CASE WHEN qx < px THEN pi() ELSE 0 END END AS slope,
         atan2(qy - py, qx - px) AS azimuth, sqrt((qx-px)*(qx-px)+(qy-py)*(qy-py)) AS d FROM ends)"""


@q("end_angles", f"""SELECT id, "end", {R('slope', 'slope')}, {R('azimuth', 'azimuth')} FROM ang""", fx.TRACK, _ENDS)
def end_angles(spark, sf):
    return lines.ends(fx.track(spark, sf)).select("id", "end", r6("slope").alias("slope"), r6("azimuth").alias("azimuth"))


@q("anchors", f"""SELECT id, "end", {R('px + (qx - px) * 30 / d', 'ax')}, {R('py + (qy - py) * 30 / d', 'ay')} FROM ang""", fx.TRACK, _ENDS)
def anchors(spark, sf):
    return lines.ends(fx.track(spark, sf), 30.0).select("id", "end", *xy("anchor", "ax", "ay"))


_TRIPLES = """tri AS (
  SELECT * FROM (SELECT id, i, n, x, y, lag(x) OVER w AS hx, lag(y) OVER w AS hy, lead(x) OVER w AS nx, lead(y) OVER w AS ny
                 FROM track WINDOW w AS (PARTITION BY id ORDER BY i)) WHERE hx IS NOT NULL AND nx IS NOT NULL),
tran AS (SELECT id, CAST(i - 1 AS INTEGER) AS i, x, y, atan2(hy - y, hx - x) + (atan2(ny - y, nx - x) - atan2(hy - y, hx - x)) / 2 AS a FROM tri)"""


@q(
    "perp_transects",
    f"SELECT id, i, {R('x + 15 * cos(a)', 'ax')}, {R('y + 15 * sin(a)', 'ay')}, {R('x - 15 * cos(a)', 'bx')}, {R('y - 15 * sin(a)', 'by')} FROM tran",
    fx.TRACK,
    _TRIPLES,
)
def perp_transects(spark, sf):
    return lines.transects(fx.track(spark, sf), 30.0).select("id", "i", *pair("t"))


@q(
    "normal_transects",
    f"""SELECT id, {R('x2 + 10 * cos(a)', 'ax')}, {R('y2 + 10 * sin(a)', 'ay')}, {R('x2 - 10 * cos(a)', 'bx')}, {R('y2 - 10 * sin(a)', 'by')}
        FROM (SELECT *, CASE WHEN x1 = x2 THEN pi() / 2 ELSE atan((y1 - y2) / (x1 - x2)) END + pi() / 2 AS a FROM seg)""",
    fx.SEG,
)
def normal_transects(spark, sf):
    return fx.seg_lines(spark, sf).select("id", g.normal_transect(_C("pts")[0], _C("pts")[1], 20.0).alias("t")).select("id", *pair("t"))


@q(
    "end_transects",
    f"""SELECT id, "end", {R('px - (qy - py) / d * 40', 'ax')}, {R('py + (qx - px) / d * 40', 'ay')}, {R('px + (qy - py) / d * 40', 'bx')}, {R('py - (qx - px) / d * 40', 'by')} FROM ang""",
    fx.TRACK,
    _ENDS,
)
def end_transects(spark, sf):
    return lines.ends(fx.track(spark, sf)).select("id", "end", g.end_transect(_C("p"), _C("q"), 40.0).alias("t")).select("id", "end", *pair("t"))


_SEGD = "sd AS (SELECT *, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) AS d FROM seg)"


@q(
    "parallel_lines",
    f"""SELECT id, {R('(x1+x2)/2 - (x2-x1)/d*20', 'ax')}, {R('(y1+y2)/2 - (y2-y1)/d*20', 'ay')}, {R('(x1+x2)/2 + (x2-x1)/d*20', 'bx')}, {R('(y1+y2)/2 + (y2-y1)/d*20', 'by')},
               {R('x1 - (y2-y1)/d*5', 'ox')}, {R('y1 + (x2-x1)/d*5', 'oy')} FROM sd WHERE d > 0""",
    fx.SEG,
    _SEGD,
)
def parallel_lines(spark, sf):
    s = fx.seg_lines(spark, sf)
    a, b = _C("pts")[0], _C("pts")[1]
    middle = g.point((a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2)
    s = s.select("id", g.parallel_centered(a, b, middle, 40.0).alias("t"), g.offset_segment(a, b, 5.0).alias("o")).filter("t IS NOT NULL")
    return s.select("id", *pair("t"), *xy("o.a", "ox", "oy"))


_MID = """tot AS (SELECT id, sum(len) AS total FROM tlen GROUP BY id),
mid AS (SELECT m.id, arg_min(x1 + (x2 - x1) * (total / 2 - m) / len, i) AS mx, arg_min(y1 + (y2 - y1) * (total / 2 - m) / len, i) AS my, any_value(total) AS total,
               any_value(m.n) AS n, min(i) AS i
        FROM tmeas m JOIN tot USING (id) WHERE m <= total / 2 AND total / 2 <= m + len GROUP BY m.id)"""


@q("midpoints", f"SELECT id, {R('mx', 'x')}, {R('my', 'y')} FROM mid", fx.TRACK, _MID)
def midpoints(spark, sf):
    t = fx.track(spark, sf).select("id", g.measured(_C("pts")).alias("m"), (g.length(_C("pts")) / 2).alias("half"))
    return t.select("id", g.interpolate(_C("m"), _C("half")).alias("p")).select("id", *xy("p", "x", "y"))


@q(
    "line_halves",
    f"""SELECT id, {R('total / 2', 'first')}, {R('total / 2', 'second')} FROM tot""",
    fx.TRACK,
    _MID,
)
def line_halves(spark, sf):
    h = lines.halves(fx.track(spark, sf))
    return h.select("id", r6(g.length(_C("first"))).alias("first"), r6(g.length(_C("second"))).alias("second"))


@q(
    "closest_point",
    f"""SELECT id, {R('arg_min(fx, (d2, i))', 'x')}, {R('arg_min(fy, (d2, i))', 'y')}, {R('sqrt(min(d2))', 'dist')} FROM (
          SELECT id, i, x1 + (x2-x1)*t AS fx, y1 + (y2-y1)*t AS fy, (x1 + (x2-x1)*t - 500)*(x1 + (x2-x1)*t - 500) + (y1 + (y2-y1)*t - 500)*(y1 + (y2-y1)*t - 500) AS d2
          FROM (SELECT *, least(greatest(((500-x1)*(x2-x1) + (500-y1)*(y2-y1)) / (len*len), 0), 1) AS t FROM tlen)) GROUP BY id""",
    fx.TRACK,
)
def closest_point(spark, sf):
    p = g.point(F.lit(500.0), F.lit(500.0))
    t = fx.track(spark, sf).select("id", g.nearest(g.measured(_C("pts")), p).alias("p"))
    return t.select("id", *xy("p", "x", "y"), r6(F.sqrt("p.d2")).alias("dist"))


@q(
    "resample_1m",
    f"""SELECT id, CAST(k AS INTEGER) AS k, CASE WHEN k = ceil(d) THEN x2 ELSE {R('x1 + (x2-x1) * k / d', 'x')[:-5]} END AS x, CASE WHEN k = ceil(d) THEN y2 ELSE {R('y1 + (y2-y1) * k / d', 'y')[:-5]} END AS y
        FROM (SELECT *, unnest(range(0, CAST(ceil(d) AS BIGINT) + 1)) AS k FROM sd)""",
    fx.SEG,
    _SEGD,
)
def resample_1m(spark, sf):
    return lines.stations(fx.seg_lines(spark, sf), 1.0).select("id", "k", *xy("p", "x", "y"))


@q(
    "cut_by_length",
    f"""SELECT id, CAST(piece AS INTEGER) AS piece, CAST(piece * 250 AS DOUBLE) AS "start", {R('CASE WHEN piece = n - 1 THEN len ELSE (piece + 1) * 250 END', '"end"')}
        FROM (SELECT *, unnest(range(0, n)) AS piece FROM (
          SELECT id, len, CAST(CASE WHEN n > 1 AND len - (n - 1) * 250 < 0.5 THEN n - 1 ELSE n END AS BIGINT) AS n
          FROM (SELECT id, len, ceil(len / 250 - 1e-9) AS n FROM (SELECT id, sum(len) AS len FROM tlen GROUP BY id) WHERE len > 250)))""",
    fx.TRACK,
)
def cut_by_length(spark, sf):
    return lines.cut_by_length(fx.track(spark, sf), 250.0).select("id", "piece", "start", r6("end").alias("end"))


@q(
    "split_npart",
    f"""SELECT p.id, CAST(p.piece AS INTEGER) AS piece, {R('arg_min(x1 + (x2-x1) * (p.at - m) / len, i)', 'ax')}, {R('arg_min(y1 + (y2-y1) * (p.at - m) / len, i)', 'ay')}
        FROM (SELECT id, piece, total * piece / (np - 1) AS at FROM (SELECT *, unnest(range(0, CAST(np AS BIGINT) - 1)) AS piece
              FROM (SELECT id, total, ceil(total / 500) AS np FROM tot) WHERE np > 1)) p
        JOIN tmeas t ON t.id = p.id AND t.m <= p.at AND p.at <= t.m + t.len GROUP BY p.id, p.piece""",
    fx.TRACK,
    _MID,
)
def split_npart(spark, sf):
    return lines.split_npart(fx.track(spark, sf), 500.0).select("id", "piece", *xy("a", "ax", "ay"))


@q(
    "densify",
    f"""SELECT id, CAST(sum(greatest(ceil(len), 1)) + 1 AS BIGINT) AS n_points, {R('sum(len)', 'length')}, {R('max(len / greatest(ceil(len), 1))', 'longest')} FROM tlen GROUP BY id""",
    fx.TRACK,
)
def densify(spark, sf):
    d = lines.densified(fx.track(spark, sf), 1.0).groupBy("id")
    return d.agg(F.count(F.lit(1)).alias("n_points"), r6(F.sum("step")).alias("length"), r6(F.max("step")).alias("longest"))


@q("segment_seq", f"SELECT id, CAST(i - 1 AS INTEGER) AS olnseg, {R('len', 'length')}, {R('m', 'before')} FROM tmeas", fx.TRACK)
def segment_seq(spark, sf):
    m = fx.track(spark, sf).select("id", F.posexplode(g.measured(_C("pts"))).alias("olnseg", "s"))
    return m.select("id", "olnseg", r6("s.len").alias("length"), r6("s.from").alias("before"))


@q(
    "multipart_explode",
    f"""SELECT o_custkey AS olnfid, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY id) - 1 AS INTEGER) AS olnseg, id, {R('sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))', 'length')}
        FROM seg JOIN orders ON o_orderkey = id""",
    fx.SEG,
)
def multipart_explode(spark, sf):
    s = fx.seg_lines(spark, sf).join(fx.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("olnfid")), "id")
    parts = s.groupBy("olnfid").agg(F.sort_array(F.collect_list(F.struct("id", "pts"))).alias("parts"))
    out = lines.explode_parts(parts, "parts", "part", "olnseg")
    return out.select("olnfid", "olnseg", _C("part.id").alias("id"), r6(g.length(_C("part.pts"))).alias("length"))


@q(
    "update_line_end",
    f"""SELECT id, x1, y1, x2 + 1.5 AS x2, y2 - 2.5 AS y2, {R('sqrt((x2+1.5-x1)*(x2+1.5-x1)+(y2-2.5-y1)*(y2-2.5-y1))', 'length')} FROM seg""",
    fx.SEG,
)
def update_line_end(spark, sf):
    s = fx.seg_lines(spark, sf)
    new = g.point(_C("pts")[1]["x"] + 1.5, _C("pts")[1]["y"] - 2.5)
    s = s.select("id", g.replace_end(_C("pts"), -1, new).alias("pts"))
    return s.select("id", _C("pts")[0]["x"].alias("x1"), _C("pts")[0]["y"].alias("y1"), _C("pts")[1]["x"].alias("x2"), _C("pts")[1]["y"].alias("y2"), r6(g.length(_C("pts"))).alias("length"))


@q(
    "remove_holes",
    f"""SELECT id, CASE WHEN x1 - x0 > 6 AND y1 - y0 > 6 THEN 2 ELSE 1 END AS rings, {R('(x1-x0)*(y1-y0) - CASE WHEN x1 - x0 > 6 AND y1 - y0 > 6 THEN 4 ELSE 0 END', 'before')}, {R('(x1-x0)*(y1-y0)', 'area')} FROM poly""",
    fx.POLY,
)
def remove_holes(spark, sf):
    p = fx.poly(spark, sf).withColumn("outer", fx.rectangle())
    for c in ("x0", "y0"):
        p = p.withColumn(f"h{c}", _C(c) + 2).withColumn(f"k{c}", _C(c) + 4)
    hole = fx.rectangle("hx0", "hy0", "kx0", "ky0")
    p = p.withColumn("rings", F.when((_C("x1") - _C("x0") > 6) & (_C("y1") - _C("y0") > 6), F.array("outer", hole)).otherwise(F.array("outer")))
    return p.select("id", F.size("rings").alias("rings"), r6(g.polygon_area(_C("rings"))).alias("before"), r6(g.polygon_area(g.remove_holes(_C("rings")))).alias("area"))


@q("quantize", "SELECT id, CAST(round(x1 / 10) AS BIGINT) AS kx, CAST(round(y1 / 10) AS BIGINT) AS ky, count(*) OVER (PARTITION BY round(x1 / 10), round(y1 / 10)) AS n FROM seg", fx.SEG)
def quantize(spark, sf):
    from ridgeway.operators.spatial_join import snap_key

    s = fx.seg(spark, sf).select("id", *snap_key("x1", "y1", 10.0))
    n = s.groupBy("kx", "ky").agg(F.count(F.lit(1)).alias("n"))
    return s.join(n, ["kx", "ky"]).select("id", "kx", "ky", "n")


@q("has_multipart", "SELECT max(n) > 1 AS any_multipart, count(*) FILTER (WHERE n > 1) AS multipart, count(*) AS features FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def has_multipart(spark, sf):
    n = fx.read(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.bool_or(_C("n") > 1).alias("any_multipart"), F.count(F.when(_C("n") > 1, 1)).alias("multipart"), F.count(F.lit(1)).alias("features"))
