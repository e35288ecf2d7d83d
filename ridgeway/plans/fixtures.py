"""Layers made from the given tables, as DataFrames and as SQL, so that every operator has lines, cells and polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeway.functions import geom as g


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x1, y1, x2, y2): one two-point line for each order."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    x, y = (F.col("o_custkey") % 100) * 25, F.floor(F.col("o_custkey") / 100) * 25
    return o.select(
        F.col("o_orderkey").alias("id"),
        x.cast("double").alias("x1"),
        y.cast("double").alias("y1"),
        (x + (F.col("o_orderkey") * 7919 % 61) - 30).cast("double").alias("x2"),
        (y + (F.col("o_orderkey") * 104729 % 61) - 30).cast("double").alias("y2"),
    )


SEG = """seg AS (
  SELECT o_orderkey AS id, CAST((o_custkey % 100) * 25 AS DOUBLE) AS x1, CAST((o_custkey // 100) * 25 AS DOUBLE) AS y1,
         CAST((o_custkey % 100) * 25 + (o_orderkey * 7919 % 61) - 30 AS DOUBLE) AS x2,
         CAST((o_custkey // 100) * 25 + (o_orderkey * 104729 % 61) - 30 AS DOUBLE) AS y2
  FROM orders)"""


def seg_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, pts): the same as lines."""
    return seg(spark, sf_dir).select("id", F.array(g.point(F.col("x1"), F.col("y1")), g.point(F.col("x2"), F.col("y2"))).alias("pts"))


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, pts): one line of several points for each order in lineitem; one shuffle, by the line's id."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct(*order))).alias("v"))
    pts = F.transform("v", lambda p: g.point(p["l_partkey"] % 1000, p["l_suppkey"] * 7 % 1000))
    return rows.select("id", pts.alias("pts")).select("id", g.without_repeats(F.col("pts")).alias("pts")).filter(F.size("pts") >= 2)


TRACK = """t0 AS (
  SELECT l_orderkey AS id, CAST(l_partkey % 1000 AS DOUBLE) AS x, CAST(l_suppkey * 7 % 1000 AS DOUBLE) AS y,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS rn
  FROM lineitem),
t1 AS (SELECT *, lag(x) OVER (PARTITION BY id ORDER BY rn) AS px, lag(y) OVER (PARTITION BY id ORDER BY rn) AS py FROM t0),
t2 AS (SELECT id, x, y, row_number() OVER (PARTITION BY id ORDER BY rn) AS i, count(*) OVER (PARTITION BY id) AS n
       FROM t1 WHERE px IS NULL OR x <> px OR y <> py),
track AS (SELECT * FROM t2 WHERE n >= 2),
tseg AS (
  SELECT * FROM (SELECT id, i, n, x AS x1, y AS y1, lead(x) OVER (PARTITION BY id ORDER BY i) AS x2, lead(y) OVER (PARTITION BY id ORDER BY i) AS y2
                 FROM track) WHERE x2 IS NOT NULL),
tlen AS (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len FROM tseg),
tmeas AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CAST(0 AS DOUBLE)) AS m FROM tlen)"""

#: Rows, columns and values of a tile; cells are 1 by 1.
TILE = 8


def cells(spark: SparkSession, sf_dir: str, nodata: bool = False) -> DataFrame:
    """(tile, pos, row, col, h): an 8 by 8 height raster for each vector."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tile"), F.posexplode("embedding").alias("pos", "v"))
    h = F.round(F.abs(F.col("v").cast("double")) * 40, 3)
    if nodata:
        h = F.when((F.col("tile") + F.col("pos")) % 17 != 0, h)
    return e.select("tile", "pos", F.floor(F.col("pos") / TILE).cast("int").alias("row"), (F.col("pos") % TILE).alias("col"), h.alias("h"))


CELL = """cell AS (
  SELECT vec_id AS tile, CAST(pos AS INTEGER) AS pos, CAST(pos // 8 AS INTEGER) AS "row", CAST(pos % 8 AS INTEGER) AS col,
         round(abs(CAST(embedding[pos + 1] AS DOUBLE)) * 40, 3) AS h
  FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS pos FROM embeddings))"""
CELL_ND = CELL.replace("cell AS (", "cell0 AS (", 1) + """,
cell AS (SELECT tile, pos, "row", col, CASE WHEN (tile + pos) % 17 <> 0 THEN h END AS h FROM cell0)"""


def tiles(spark: SparkSession, sf_dir: str, nodata: bool = False) -> DataFrame:
    """(tile, h): the same rasters as arrays in row order, one row each; no shuffle."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tile"), "embedding")

    def height(v, i):
        h = F.round(F.abs(v.cast("double")) * 40, 3)
        return F.when((F.col("tile") + i) % 17 != 0, h) if nodata else h

    return e.select("tile", F.transform("embedding", height).alias("h"))


#: Tiles side by side in the mosaic.
ACROSS = 25


def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, x, y, h): all tiles in one raster, 25 across, rows going down from y = 0 upwards."""
    c = cells(spark, sf_dir)
    row, col = F.floor(F.col("tile") / ACROSS) * TILE + F.col("row"), F.col("tile") % ACROSS * TILE + F.col("col")
    return c.select(row.cast("long").alias("row"), col.cast("long").alias("col"), (col + 0.5).cast("double").alias("x"), (row + 0.5).cast("double").alias("y"), "h")


MOSAIC = CELL + """,
mosaic AS (SELECT (tile // 25) * 8 + "row" AS "row", tile % 25 * 8 + col AS col, CAST(tile % 25 * 8 + col AS DOUBLE) + CAST(0.5 AS DOUBLE) AS x,
                  CAST((tile // 25) * 8 + "row" AS DOUBLE) + CAST(0.5 AS DOUBLE) AS y, h FROM cell)"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, side, p): medians of the 15 rings on either side of a line, as arrays; side 0 is left."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    p = lambda s: F.transform(F.slice("embedding", 15 * s + 1, 15), lambda v: F.round(F.abs(v.cast("double")) * 40, 3))
    return e.select("id", F.posexplode(F.array(p(0), p(1))).alias("side", "p"))


PROFILE = """profile AS (
  SELECT vec_id AS id, CAST(pos // 15 AS INTEGER) AS side, CAST(pos % 15 AS INTEGER) AS ring, round(abs(CAST(embedding[pos + 1] AS DOUBLE)) * 40, 3) AS p
  FROM (SELECT vec_id, embedding, unnest(range(30)) AS pos FROM embeddings))"""


def poly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x0, y0, x1, y1): a rectangle for each part."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    x, y = (F.col("p_partkey") % 100) * 25, F.floor(F.col("p_partkey") / 100) * 25
    return p.select(
        F.col("p_partkey").alias("id"), x.cast("double").alias("x0"), y.cast("double").alias("y0"),
        (x + 5 + F.col("p_size")).cast("double").alias("x1"), (y + 5 + F.col("p_size") % 17).cast("double").alias("y1"),
    )


POLY = """poly AS (
  SELECT p_partkey AS id, CAST((p_partkey % 100) * 25 AS DOUBLE) AS x0, CAST((p_partkey // 100) * 25 AS DOUBLE) AS y0,
         CAST((p_partkey % 100) * 25 + 5 + p_size AS DOUBLE) AS x1, CAST((p_partkey // 100) * 25 + 5 + p_size % 17 AS DOUBLE) AS y1
  FROM part)"""


def rectangle(x0="x0", y0="y0", x1="x1", y1="y1"):
    """A closed ring from the bounds in four columns."""
    c = F.col
    return F.array(g.point(c(x0), c(y0)), g.point(c(x1), c(y0)), g.point(c(x1), c(y1)), g.point(c(x0), c(y1)), g.point(c(x0), c(y0)))


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ring): the rectangles as closed rings."""
    return poly(spark, sf_dir).select("id", rectangle().alias("ring"))
