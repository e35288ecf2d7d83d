"""Layers as tables: reading with cleaning and row numbers, writing several at once, GeoJSON, and raster tables.

A dataset is a folder, a layer a Parquet table in it. Geometry columns are arrays of points; GeoJSON comes and goes as
text that Spark reads and writes. Formats that need GDAL are not read; convert them to Parquet or GeoJSON first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeway.functions import geom as g
from ridgeway.operators import lines
from ridgeway.session import written

_COORDS = {"Point": "array<double>", "LineString": "array<array<double>>", "MultiLineString": "array<array<array<double>>>", "Polygon": "array<array<array<double>>>", "MultiPolygon": "array<array<array<array<double>>>>"}


def numbered(df: DataFrame, *key: str, name: str = "bt_uid") -> DataFrame:
    """df with row numbers from 0 in the order of a key: range partitions, numbered apart, moved by the counts before them."""
    parts = df.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("__p", F.spark_partition_id())
    kept = written(parts, "numbered")
    each = kept.withColumn("__n", F.row_number().over(W.partitionBy("__p").orderBy(*key)))
    # One row for each partition.
    starts = kept.groupBy("__p").agg(F.count(F.lit(1)).alias("c")).withColumn("__s", F.sum("c").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)))
    starts = starts.select("__p", F.coalesce("__s", F.lit(0)).alias("__s"))
    return each.join(F.broadcast(starts), "__p").withColumn(name, F.col("__s") + F.col("__n") - 1).drop("__p", "__n", "__s")


def read_layer(spark: SparkSession, path: str, layer: str, key: str = "id") -> DataFrame:
    """A layer, cleaned, with bt_uid over a stable key."""
    return numbered(lines.clean_geometries(spark.read.parquet(f"{path}/{layer}")), key)


def optional_layer(spark: SparkSession, path: str, layer: str) -> DataFrame | None:
    """A layer, or None where the dataset has none of this name."""
    return spark.read.parquet(f"{path}/{layer}") if layer in list_layers(spark, path) else None


def list_layers(spark: SparkSession, path: str) -> list[str]:
    """Names of a dataset's layers, through Spark's own file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def write_layers(layers: dict[str, DataFrame], path: str, main: tuple[str, ...] = (), aux: str | None = None) -> None:
    """Every layer as a table. With `aux`, all but the main ones go to another dataset: for a sink that holds one layer."""
    for name, df in layers.items():
        df.write.mode("overwrite").parquet(f"{aux if aux and name not in main else path}/{name}")


def same_srid(*layers: DataFrame, column: str = "srid") -> int | None:
    """The one reference system of some layers; more than one is an error. Layers without the column don't count."""
    found = set()
    for df in layers:
        if column in df.columns:
            found |= {r[0] for r in df.select(column).distinct().limit(2).collect()}
    if len(found) > 1:
        raise ValueError(f"layers have different reference systems: {sorted(map(str, found))}")
    return found.pop() if found else None


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(id, kind, parts, properties): features as parts of points; polygons as rings in the order of the file; Z is dropped."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "struct<features:array<struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>>").alias("f"))
    rows = text.select(F.posexplode("f.features").alias("id", "f")).select("id", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"), F.col("f.properties").alias("properties"))
    line = lambda a: F.transform(a, lambda p: g.point(p[0], p[1]))
    many = lambda a: F.transform(a, line)

    def parsed(kind):
        return F.from_json(F.concat(F.lit('{"v":'), F.col("c"), F.lit("}")), f"struct<v:{_COORDS[kind]}>")["v"]

    parts = (
        F.when(F.col("kind") == "Point", F.array(F.array(g.point(F.get(parsed("Point"), F.lit(0)), F.get(parsed("Point"), F.lit(1))))))
        .when(F.col("kind") == "LineString", F.array(line(parsed("LineString"))))
        .when(F.col("kind").isin("MultiLineString", "Polygon"), many(parsed("Polygon")))
        .when(F.col("kind") == "MultiPolygon", F.flatten(F.transform(parsed("MultiPolygon"), many)))
    )
    return rows.select("id", "kind", parts.alias("parts"), "properties")


def geojson_features(df: DataFrame, *properties: str, geometry: str = "pts") -> DataFrame:
    """(value): a GeoJSON feature for each line, ready for Spark's text sink."""
    coords = F.transform(geometry, lambda p: F.array(p["x"], p["y"]))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.struct(F.lit("LineString").alias("type"), coords.alias("coordinates")).alias("geometry"))
    return df.select(F.to_json(feature).alias("value"))


def write_raster(cells: DataFrame, path: str, size: int = 256) -> None:
    """A raster of cells as a table partitioned by tile row, so that a clip reads only what it needs."""
    tiled = cells.withColumn("trow", F.floor(F.col("row") / size)).withColumn("tcol", F.floor(F.col("col") / size))
    tiled.repartition("trow", "tcol").sortWithinPartitions("row", "col").write.mode("overwrite").partitionBy("trow").parquet(path)


def read_raster(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, size: int = 256) -> DataFrame:
    """The cells of a raster table; with a span of rows, only its tile rows are read."""
    cells = spark.read.parquet(path)
    if rows:
        cells = cells.filter(F.col("trow").between(rows[0] // size, rows[1] // size) & F.col("row").between(*rows))
    return cells.drop("trow", "tcol")
