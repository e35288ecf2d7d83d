"""Queries of the raster and profile operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeway.functions import geom as g
from ridgeway.functions.geom import r6
from ridgeway.operators import profile, raster
from ridgeway.plans import fixtures as fx
from ridgeway.plans.line_queries import R, q

N = fx.TILE
_CAN = """can AS (SELECT *, CASE WHEN h IS NULL THEN NULL WHEN h >= 2.5 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS k FROM cell)"""
_FOC = """off AS (SELECT dr, dc FROM range(-2, 3) a(dr), range(-2, 3) b(dc) WHERE dr * dr + dc * dc <= 4),
foc AS (SELECT c.tile, c.pos, avg(n.k) AS m, stddev_pop(n.k) AS s
        FROM can c CROSS JOIN off JOIN can n ON n.tile = c.tile AND n."row" = least(greatest(c."row" + dr, 0), 7) AND n.col = least(greatest(c.col + dc, 0), 7)
        GROUP BY 1, 2)"""
_NEAR = """noff AS (SELECT dr, dc, sqrt(dr * dr + dc * dc) AS d FROM range(-2, 3) a(dr), range(-2, 3) b(dc) WHERE dr * dr + dc * dc < 6.25),
near AS (SELECT c.tile, c.pos, CASE WHEN any_value(c.h) IS NULL THEN NULL ELSE coalesce(max(2.5 - d) FILTER (WHERE n.pos IS NOT NULL AND n.h IS NULL), 0) / 2.5 END AS near
         FROM can c CROSS JOIN noff LEFT JOIN can n ON n.tile = c.tile AND n."row" = c."row" + dr AND n.col = c.col + dc GROUP BY 1, 2)"""


@q("canopy_map", "SELECT tile, pos, k AS canopy FROM can", fx.CELL_ND, _CAN)
def canopy_map(spark, sf):
    return fx.cells(spark, sf, nodata=True).select("tile", "pos", raster.canopy(F.col("h"), 2.5).alias("canopy"))


@q("focal_stats", f"SELECT tile, pos, {R('m', 'mean')}, {R('s', 'std')} FROM foc", fx.CELL_ND, _CAN, _FOC)
def focal_stats(spark, sf):
    out = raster.focal_stats(fx.tiles(spark, sf, nodata=True), 2.5, 2, N, N)
    return raster.exploded(out, "mean", "std").select("tile", "pos", r6("mean").alias("mean"), r6("std").alias("std"))


@q(
    "focal_mosaic",
    f"""SELECT c."row", c.col, {R('avg(n.k)', 'mean')}, {R('stddev_pop(n.k)', 'std')} FROM nb c JOIN mk n ON n."row" = c.nr AND n.col = c.nc GROUP BY 1, 2""",
    fx.MOSAIC,
    """mk AS (SELECT "row", col, CASE WHEN h >= 2.5 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS k FROM mosaic),
off AS (SELECT dr, dc FROM range(-2, 3) a(dr), range(-2, 3) b(dc) WHERE dr * dr + dc * dc <= 4),
nb AS MATERIALIZED (
  SELECT c."row", c.col, least(greatest(c."row" + dr, (SELECT min("row") FROM mk)), (SELECT max("row") FROM mk)) AS nr,
         least(greatest(c.col + dc, (SELECT min(col) FROM mk)), (SELECT max(col) FROM mk)) AS nc FROM mk c CROSS JOIN off)""",
)
def focal_mosaic(spark, sf):
    out = raster.focal_mosaic(fx.mosaic(spark, sf), 2.5, 2)
    return out.select("row", "col", r6("mean").alias("mean"), r6("std").alias("std"))


@q("dist_smooth", f"SELECT tile, pos, {R('near', 'near')} FROM near", fx.CELL_ND, _CAN, _NEAR)
def dist_smooth(spark, sf):
    out = raster.nodata_nearness(fx.tiles(spark, sf, nodata=True), 2.5, N, N)
    return raster.exploded(out, "near").select("tile", "pos", r6("near").alias("near"))


@q(
    "cost_raster",
    f"""SELECT tile, pos, {R('CASE WHEN k IS NULL THEN NULL ELSE pow(exp(CASE WHEN k = 1 THEN 1 ELSE cover * 0.6 + near * 0.4 END), 1.5) END', 'cost')}, k AS canopy
        FROM (SELECT c.tile, c.pos, c.k, near, CASE WHEN m + s <= 0 THEN 0 ELSE (1 + CASE WHEN m + s <> 0 THEN (m - s) / (m + s) ELSE 0 END) / 2 END AS cover
              FROM can c JOIN foc USING (tile, pos) JOIN near USING (tile, pos))""",
    fx.CELL_ND,
    _CAN,
    _FOC,
    _NEAR,
)
def cost_raster(spark, sf):
    out = raster.cost_raster(fx.tiles(spark, sf, nodata=True), N, N)
    return raster.exploded(out, "cost", "canopy").select("tile", "pos", r6("cost").alias("cost"), "canopy")


@q(
    "closing",
    """SELECT c.tile, c.pos, min(n.g) AS open FROM grown c CROSS JOIN sq JOIN grown n ON n.tile = c.tile AND n."row" = c."row" + dr AND n.col = c.col + dc GROUP BY 1, 2""",
    fx.CELL,
    """sq AS (SELECT dr, dc FROM range(-1, 2) a(dr), range(-1, 2) b(dc)),
o AS (SELECT *, CASE WHEN h < 2.5 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS k FROM cell),
grown AS (SELECT c.tile, c.pos, any_value(c."row") AS "row", any_value(c.col) AS col, max(n.k) AS g
          FROM o c CROSS JOIN sq JOIN o n ON n.tile = c.tile AND n."row" = c."row" + dr AND n.col = c.col + dc GROUP BY 1, 2)""",
)
def closing(spark, sf):
    return raster.exploded(raster.closing(fx.tiles(spark, sf), 2.5, 1, N, N), "open")


_SEG_CELL = """sc AS (
  SELECT id, h, CASE WHEN n > 0 THEN least(greatest(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / n, 0), 1) ELSE 0 END AS t, x, y, x1, y1, x2, y2
  FROM (SELECT *, (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS n FROM seg) s JOIN mosaic m
  ON m.x BETWEEN least(x1, x2) - 3 AND greatest(x1, x2) + 3 AND m.y BETWEEN least(y1, y2) - 3 AND greatest(y1, y2) + 3)"""


@q(
    "clip_cells",
    f"""SELECT id, count(*) AS n, {R('sum(h)', 'total')} FROM sc WHERE (x1 + (x2 - x1) * t - x) * (x1 + (x2 - x1) * t - x) + (y1 + (y2 - y1) * t - y) * (y1 + (y2 - y1) * t - y) <= 9 GROUP BY id""",
    fx.SEG,
    fx.MOSAIC,
    _SEG_CELL,
)
def clip_cells(spark, sf):
    met = raster.clip(fx.mosaic(spark, sf), fx.seg(spark, sf), 3.0)
    return met.groupBy("id").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("h")).alias("total"))


@q(
    "clip_polygons",
    f"""SELECT id, count(*) AS n, {R('sum(h)', 'total')} FROM poly JOIN mosaic ON x > x0 AND x < x1 AND y > y0 AND y < y1 GROUP BY id""",
    fx.POLY,
    fx.MOSAIC,
)
def clip_polygons(spark, sf):
    met = raster.clip_polygons(fx.mosaic(spark, sf), fx.poly(spark, sf), fx.rectangle())
    return met.groupBy("id").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("h")).alias("total"))


@q(
    "rowcol_xy",
    """SELECT id, CAST(floor((1000 - y2) / 0.5) AS BIGINT) AS "row", CAST(floor((x2 + 30) / 0.5) AS BIGINT) AS col,
              -30 + (floor((x2 + 30) / 0.5) + 0.5) * 0.5 AS x, 1000 - (floor((1000 - y2) / 0.5) + 0.5) * 0.5 AS y FROM seg""",
    fx.SEG,
)
def rowcol_xy(spark, sf):
    s = fx.seg(spark, sf).select("id", g.row_of(F.col("y2"), 1000.0, 0.5).alias("row"), g.col_of(F.col("x2"), -30.0, 0.5).alias("col"))
    return s.select("id", "row", "col", (-30 + (F.col("col") + 0.5) * 0.5).alias("x"), (1000 - (F.col("row") + 0.5) * 0.5).alias("y"))


@q(
    "raster_footprint",
    """SELECT tile, CAST(min(col) AS DOUBLE) AS x0, CAST(min("row") AS DOUBLE) AS y0, CAST(max(col) + 1 AS DOUBLE) AS x1, CAST(max("row") + 1 AS DOUBLE) AS y1, count(*) AS n FROM cell WHERE h IS NOT NULL GROUP BY tile""",
    fx.CELL_ND,
)
def raster_footprint(spark, sf):
    c = fx.cells(spark, sf, nodata=True).filter("h IS NOT NULL").groupBy("tile")
    d = lambda x: x.cast("double")
    return c.agg(d(F.min("col")).alias("x0"), d(F.min("row")).alias("y0"), d(F.max("col") + 1).alias("x1"), d(F.max("row") + 1).alias("y1"), F.count(F.lit(1)).alias("n"))


@q(
    "histogram_threshold",
    """SELECT tile, CASE WHEN min(bin) = 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(min(bin) - 1 AS DOUBLE) END AS threshold FROM (
         SELECT tile, bin, sum(n) OVER (PARTITION BY tile ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY tile) AS total
         FROM (SELECT tile, least(floor(h), 99) AS bin, count(*) AS n FROM cell WHERE h BETWEEN 0 AND 100 GROUP BY 1, 2)) WHERE upto > total / 2.0 GROUP BY tile""",
    fx.CELL,
)
def histogram_threshold(spark, sf):
    return raster.histogram_threshold(fx.cells(spark, sf))


def _edges(weight: str) -> str:
    return f"""edge AS (SELECT a.tile, a.pos AS a, b.pos AS b, {weight} AS w
  FROM (SELECT *, 1 + h AS c FROM cell) a JOIN (SELECT *, 1 + h AS c FROM cell) b ON a.tile = b.tile AND a.pos <> b.pos AND abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1)"""


_GEOMETRIC = """(a.c + b.c) / 2 * CASE WHEN a."row" <> b."row" AND a.col <> b.col THEN sqrt(2) ELSE 1 END"""


def _acc(name: str, start: int) -> str:
    return f"""{name}(tile, pos, acc) USING KEY (tile, pos) AS (
  SELECT tile, pos, CAST(0 AS DOUBLE) FROM cell WHERE pos = {start}
  UNION
  SELECT e.tile, e.b, min(d.acc + e.w) FROM {name} d JOIN edge e ON e.tile = d.tile AND e.a = d.pos LEFT JOIN recurring.{name} r ON r.tile = e.tile AND r.pos = e.b
  WHERE r.acc IS NULL OR d.acc + e.w < r.acc GROUP BY e.tile, e.b)"""


def _recursive(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ", ".join(ctes) + " " + body


from ridgeway.registry import query  # noqa: E402


@query("least_cost", _recursive(f"SELECT tile, pos, {R('acc', 'acc')} FROM d", fx.CELL, _edges(_GEOMETRIC), _acc("d", 0)))
def least_cost(spark, sf):
    out = raster.accumulated(fx.tiles(spark, sf), N, N, lambda h: 1 + h, (0, 0))
    return raster.exploded(out, "acc").select("tile", "pos", r6("acc").alias("acc"))


@query("least_cost_entered", _recursive(f"SELECT tile, pos, {R('acc', 'acc')} FROM d", fx.CELL, _edges("b.c"), _acc("d", 27)))
def least_cost_entered(spark, sf):
    out = raster.accumulated(fx.tiles(spark, sf), N, N, lambda h: 1 + h, (3, 3), entered_only=True)
    return raster.exploded(out, "acc").select("tile", "pos", r6("acc").alias("acc"))


@query(
    "corridor",
    _recursive(
        f"""SELECT tile, pos, {R('o', 'over')}, CASE WHEN o >= 2.5 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS corridor
            FROM (SELECT tile, pos, a.acc + b.acc - min(a.acc + b.acc) OVER (PARTITION BY tile) AS o FROM d a JOIN z b USING (tile, pos))""",
        fx.CELL,
        _edges(_GEOMETRIC),
        _acc("d", 0),
        _acc("z", 63),
    ),
)
def corridor(spark, sf):
    out = raster.corridors(fx.tiles(spark, sf), N, N, lambda h: 1 + h, (0, 0), (N - 1, N - 1), 2.5)
    return raster.exploded(out, "over", "corridor").select("tile", "pos", r6("over").alias("over"), "corridor")


@query(
    "vectorize_components",
    _recursive(
        """SELECT tile, label, count(*) AS n_cells, min(pos) AS first_pos, max(pos) AS last_pos FROM l GROUP BY tile, label""",
        fx.CELL,
        """o AS (SELECT * FROM cell WHERE h < 2.5),
edge AS (SELECT a.tile, a.pos AS a, b.pos AS b FROM o a JOIN o b ON a.tile = b.tile AND abs(a."row" - b."row") + abs(a.col - b.col) = 1),
l(tile, pos, label) USING KEY (tile, pos) AS (
  SELECT tile, pos, CAST(pos AS BIGINT) FROM o
  UNION
  SELECT e.tile, e.b, min(l.label) FROM l JOIN edge e ON e.tile = l.tile AND e.a = l.pos JOIN recurring.l r ON r.tile = e.tile AND r.pos = e.b
  WHERE l.label < r.label GROUP BY e.tile, e.b)""",
    ),
)
def vectorize_components(spark, sf):
    cells = raster.exploded(raster.components(fx.tiles(spark, sf), 2.5, N, N), "label").filter("label IS NOT NULL")
    return cells.groupBy("tile", F.col("label").cast("long").alias("label")).agg(F.count(F.lit(1)).alias("n_cells"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query(
    "component_polygons",
    _recursive(
        """SELECT tile, label, CAST(count(*) AS DOUBLE) AS area FROM l GROUP BY tile, label HAVING count(*) > 1""",
        fx.CELL,
        """o AS (SELECT * FROM cell WHERE h < 2.5),
edge AS (SELECT a.tile, a.pos AS a, b.pos AS b FROM o a JOIN o b ON a.tile = b.tile AND abs(a."row" - b."row") + abs(a.col - b.col) = 1),
l(tile, pos, label) USING KEY (tile, pos) AS (
  SELECT tile, pos, CAST(pos AS BIGINT) FROM o
  UNION
  SELECT e.tile, e.b, min(l.label) FROM l JOIN edge e ON e.tile = l.tile AND e.a = l.pos JOIN recurring.l r ON r.tile = e.tile AND r.pos = e.b
  WHERE l.label < r.label GROUP BY e.tile, e.b)""",
    ),
)
def component_polygons(spark, sf):
    """Corridor parts as polygons, specks of one cell left out; the area is that of the outer ring less its holes."""
    out = raster.polygons(fx.tiles(spark, sf), 2.5, N, N)
    return out.select("tile", "label", g.polygon_area(F.col("rings")).alias("area")).filter("area > 1")


_RING = """rc AS (
  SELECT id, (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) AS crs, len, h
  FROM (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len FROM seg) s JOIN mosaic m
  ON m.x BETWEEN least(x1, x2) - 15 AND greatest(x1, x2) + 15 AND m.y BETWEEN least(y1, y2) - 15 AND greatest(y1, y2) + 15
  WHERE len > 0 AND (x - x1) * (x2 - x1) + (y - y1) * (y2 - y1) BETWEEN 0 AND len * len),
ringed AS (SELECT id, CASE WHEN crs >= 0 THEN 'left' ELSE 'right' END AS side, CAST(floor(abs(crs) / len) AS INTEGER) AS ring, h FROM rc WHERE floor(abs(crs) / len) < 15)"""


@q("rings", "SELECT id, side, ring, count(*) AS n FROM ringed GROUP BY ALL", fx.SEG, fx.MOSAIC, _RING)
def rings(spark, sf):
    return profile.ring_cells(fx.seg(spark, sf), fx.mosaic(spark, sf)).groupBy("id", "side", "ring").agg(F.count(F.lit(1)).alias("n"))


@q("ring_percentile", f"SELECT id, side, ring, count(h) AS n, {R('quantile_cont(h, 0.5)', 'p')} FROM ringed GROUP BY id, side, ring", fx.SEG, fx.MOSAIC, _RING)
def ring_percentile(spark, sf):
    out = profile.ring_percentiles(profile.ring_cells(fx.seg(spark, sf), fx.mosaic(spark, sf)))
    return out.select("id", "side", "ring", "n", r6("p").alias("p"))


@q("tile_percentiles", f"SELECT tile, {R('quantile_cont(h, 0.5)', 'p50')}, {R('quantile_cont(h, 0.9)', 'p90')}, {R('median(h)', 'median')}, count(h) AS n FROM cell GROUP BY tile", fx.CELL_ND)
def tile_percentiles(spark, sf):
    c = fx.cells(spark, sf, nodata=True).groupBy("tile")
    return c.agg(r6(F.percentile("h", F.lit(0.5))).alias("p50"), r6(F.percentile("h", F.lit(0.9))).alias("p90"), r6(F.median("h")).alias("median"), F.count("h").alias("n"))


_CHANGE = """ch AS (SELECT *, coalesce(p - lag(p) OVER (PARTITION BY id, side ORDER BY ring), 0) AS change FROM profile),
lv AS (SELECT id, side, median(p) AS m, coalesce(min(ring) FILTER (WHERE p >= 0.5 AND ring < 14 AND change >= 1.5), min(ring) FILTER (WHERE p >= 0.5 AND ring < 14 AND change >= 1.4),
       min(ring) FILTER (WHERE p >= 0.5 AND ring < 14 AND change >= CAST('1.2999999999999998' AS DOUBLE)), min(ring) FILTER (WHERE p >= 0.5 AND ring < 14 AND change >= CAST('1.1999999999999997' AS DOUBLE))) AS hit
       FROM ch GROUP BY id, side),
roc AS (
  SELECT lv.id, lv.side, CASE WHEN hit IS NOT NULL THEN CAST(hit + 1 AS DOUBLE) WHEN m <= 0.5 THEN 4 WHEN m <= 5 THEN 4.5 WHEN m <= 10 THEN 5.5 WHEN m <= 15 THEN 6 ELSE 5 END AS dist,
         CASE WHEN hit IS NOT NULL THEN CASE WHEN floor(p) <= 0.5 AND hit + 1 > 5 THEN 2 WHEN floor(p) > 15 AND hit + 1 > 4 THEN 15.5 ELSE floor(p) END
              WHEN m <= 0.5 THEN 0.5 WHEN m <= 15 THEN floor(m) ELSE 15.5 END AS height
  FROM lv LEFT JOIN profile p ON p.id = lv.id AND p.side = lv.side AND p.ring = lv.hit)"""


@q("rate_of_change", "SELECT id, side, CAST(dist AS DOUBLE) AS dist, CAST(height AS DOUBLE) AS height FROM roc", fx.PROFILE, _CHANGE)
def rate_of_change(spark, sf):
    p = fx.profiles(spark, sf)
    return p.select("id", "side", profile.rate_of_change(F.col("p")).alias("c")).select("id", "side", "c.dist", "c.height")


@q(
    "dyn_threshold",
    """SELECT l.id, CAST(l.height AS DOUBLE) AS cl_cutht, CAST(r.height AS DOUBLE) AS cr_cutht, CAST(l.dist AS DOUBLE) AS ldist_cut, CAST(r.dist AS DOUBLE) AS rdist_cut,
              (CAST(l.height AS DOUBLE) + CAST(r.height AS DOUBLE)) / 2 AS dyncanth FROM roc l JOIN roc r ON l.id = r.id AND l.side = 0 AND r.side = 1""",
    fx.PROFILE,
    _CHANGE,
)
def dyn_threshold(spark, sf):
    p = fx.profiles(spark, sf).withColumn("side", F.when(F.col("side") == 0, "left").otherwise("right"))
    return profile.thresholds(p)
