"""Operators on single lines: cleaning, splitting into segments, resampling, cutting, transects, anchors.

Input lines are (id, pts) with pts an array of points. All but the multipart ones work row by row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeway.functions import geom as g


def clean_geometries(df: DataFrame, geometry: str = "pts") -> DataFrame:
    """Rows whose geometry is there, not empty and free of null or non-finite coordinates."""
    fine = F.forall(geometry, lambda p: p.isNotNull() & p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")))
    return df.filter(F.col(geometry).isNotNull() & (F.size(geometry) > 0) & fine)


def clean_lines(df: DataFrame, geometry: str = "pts", least: float = g.SMALL) -> DataFrame:
    """clean_geometries, and longer than `least`."""
    return clean_geometries(df, geometry).filter(g.length(F.col(geometry)) > least)


def explode_segments(df: DataFrame, geometry: str = "pts", number: str = "seg") -> DataFrame:
    """A row for each consecutive pair of points, its number from 0, all attributes repeated; pts has the two points."""
    rest = [c for c in df.columns if c != geometry]
    rows = df.select(*rest, F.posexplode(g.segments(F.col(geometry))).alias(number, "s"))
    return rows.select(*rest, number, F.array("s.a", "s.b").alias(geometry))


def explode_parts(df: DataFrame, parts: str = "parts", geometry: str = "pts", number: str = "seg") -> DataFrame:
    """A row for each part of a multipart line, numbered from 0 in the order of its parts."""
    rest = [c for c in df.columns if c != parts]
    return df.select(*rest, F.posexplode(parts).alias(number, geometry))


def stations(df: DataFrame, step: float = 1.0, geometry: str = "pts") -> DataFrame:
    """(…, k, p): points each `step` along a line, from its start, and its last point."""
    m = df.withColumn("__m", g.measured(F.col(geometry))).filter(F.size("__m") > 0)
    total = F.element_at("__m", -1)["from"] + F.element_at("__m", -1)["len"]
    last = F.ceil(total / step).cast("int")
    rest = [c for c in df.columns if c != geometry]
    rows = m.select(*rest, "__m", F.explode(F.sequence(F.lit(0), last)).alias("k"), last.alias("__n"))
    at = F.when(F.col("k") == F.col("__n"), F.element_at("__m", -1)["b"]).otherwise(g.interpolate(F.col("__m"), F.col("k") * step))
    return rows.select(*rest, "k", at.alias("p"))


def cut_by_length(df: DataFrame, size: float, merge: float = 0.5, geometry: str = "pts") -> DataFrame:
    """(…, piece, start, end): pieces of equal length by distance along the line; a tail shorter than `merge` joins the piece before.

    A line no longer than `size` gives no piece, as does a tail of no length.
    """
    rest = [c for c in df.columns if c != geometry]
    rows = df.select(*rest, g.length(F.col(geometry)).alias("__len")).filter(F.col("__len") > size)
    n = F.ceil(F.col("__len") / size - 1e-9).cast("int")
    tail = F.col("__len") - (n - 1) * size
    n = F.when((n > 1) & (tail < merge), n - 1).otherwise(n)
    rows = rows.select(*rest, "__len", n.alias("__n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    end = F.when(F.col("piece") == F.col("__n") - 1, F.col("__len")).otherwise((F.col("piece") + 1) * size)
    return rows.select(*rest, "piece", (F.col("piece") * size).alias("start"), end.alias("end"))


def split_npart(df: DataFrame, size: float = 500.0, geometry: str = "pts") -> DataFrame:
    """(…, piece, a, b): n = ceil(length / size) points spread evenly from end to end, as n - 1 two-point parts."""
    rest = [c for c in df.columns if c != geometry]
    rows = df.withColumn("__m", g.measured(F.col(geometry))).withColumn("__len", g.length(F.col(geometry)))
    n = F.ceil(F.col("__len") / size).cast("int")
    rows = rows.withColumn("__n", n).filter("__n > 1")
    rows = rows.select(*rest, "__m", "__len", "__n", F.explode(F.sequence(F.lit(0), F.col("__n") - 2)).alias("piece"))
    at = lambda k: g.interpolate(F.col("__m"), F.col("__len") * k / (F.col("__n") - 1))
    return rows.select(*rest, "piece", at(F.col("piece")).alias("a"), at(F.col("piece") + 1).alias("b"))


def densified(df: DataFrame, most: float = 1.0, geometry: str = "pts") -> DataFrame:
    """(…, seg, k, step, p): the points of lines whose segments are divided evenly so that none exceeds `most`.

    k counts within a segment; the last segment also gives the line's last point, with step null.
    """
    rest = [c for c in df.columns if c != geometry]
    rows = df.select(*rest, F.size(geometry).alias("__n"), F.posexplode(g.segments(F.col(geometry))).alias("seg", "__s"))
    rows = rows.select(*rest, "seg", "__n", "__s", g.point_distance(F.col("__s.a"), F.col("__s.b")).alias("__d"))
    rows = rows.withColumn("__k", F.greatest(F.ceil(F.col("__d") / most), F.lit(1)).cast("int"))
    last = F.when(F.col("seg") == F.col("__n") - 2, F.col("__k")).otherwise(F.col("__k") - 1)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    at = lambda c: F.col(f"__s.a.{c}") + (F.col(f"__s.b.{c}") - F.col(f"__s.a.{c}")) * F.col("k") / F.col("__k")
    step = F.when(F.col("k") < F.col("__k"), F.col("__d") / F.col("__k"))
    return rows.select(*rest, "seg", "k", step.alias("step"), g.point(at("x"), at("y")).alias("p"))


def densify(df: DataFrame, key: str = "id", most: float = 1.0, geometry: str = "pts") -> DataFrame:
    """(key, geometry): lines with the points of densified()."""
    points = densified(df.select(key, geometry), most, geometry).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("seg", "k", "p"))).alias("v"))
    return points.select(key, F.transform("v", lambda r: r["p"]).alias(geometry))


def dense(pts: Column, most: float = 1.0) -> Column:
    """The points of densified(), of one line, as an array; empty for fewer than two points."""

    def along(s):
        at = lambda k, n, v: s["a"][v] + (s["b"][v] - s["a"][v]) * k / n
        points = lambda n: F.transform(F.sequence(F.lit(0), n - 1), lambda k: g.point(at(k, n, "x"), at(k, n, "y")))
        return g.let(F.greatest(F.ceil(g.point_distance(s["a"], s["b"]) / most), F.lit(1)).cast("int"), points)

    return F.concat(F.flatten(F.transform(g.segments(pts), along)), F.when(F.size(pts) >= 2, F.slice(pts, -1, 1)).otherwise(F.slice(pts, 1, 0)))


def halves(df: DataFrame, geometry: str = "pts") -> DataFrame:
    """Adds `first` and `second`: the two halves of a line by length."""
    rows = df.withColumn("__m", g.measured(F.col(geometry))).withColumn("__mid", g.length(F.col(geometry)) / 2)
    middle = g.interpolate(F.col("__m"), F.col("__mid"))
    before = F.transform(F.filter("__m", lambda s: s["from"] < F.col("__mid")), lambda s: s["a"])
    after = F.transform(F.filter("__m", lambda s: s["from"] + s["len"] > F.col("__mid")), lambda s: s["b"])
    return rows.withColumn("first", F.concat(before, F.array(middle))).withColumn("second", F.concat(F.array(middle), after)).drop("__m", "__mid")


def ends(df: DataFrame, far: float = 30.0, geometry: str = "pts") -> DataFrame:
    """(…, end, p, q, slope, azimuth, anchor): a row for each end (0 and -1) of a line; q is the neighbour inward."""
    rest = [c for c in df.columns if c != geometry]
    both = []
    for end in (0, -1):
        p, q = g.end_and_next(F.col(geometry), end)
        both.append(F.struct(F.lit(end).alias("end"), p.alias("p"), q.alias("q"), g.slope_angle(p, q).alias("slope"), g.azimuth(p, q).alias("azimuth"), g.anchor(p, q, far).alias("anchor")))
    return df.filter(F.size(geometry) >= 2).select(*rest, F.explode(F.array(*both)).alias("e")).select(*rest, "e.*")


def end_pairs(df: DataFrame, geometry: str = "pts") -> DataFrame:
    """(…, end, p, q) of ends() alone, without the angles and anchors, which cost more."""
    rest = [c for c in df.columns if c != geometry]
    both = [F.struct(F.lit(end).alias("end"), *[v.alias(n) for v, n in zip(g.end_and_next(F.col(geometry), end), "pq")]) for end in (0, -1)]
    return df.filter(F.size(geometry) >= 2).select(*rest, F.explode(F.array(*both)).alias("e")).select(*rest, "e.*")


def transects(df: DataFrame, width: float = 30.0, geometry: str = "pts") -> DataFrame:
    """(…, i, t): at each interior point, from number 1, the line across that halves its angle."""
    rest = [c for c in df.columns if c != geometry]
    rows = df.select(*rest, F.posexplode(g.triples(F.col(geometry))).alias("i", "v"))
    return rows.select(*rest, (F.col("i") + 1).alias("i"), g.bisector_transect(F.col("v.a"), F.col("v.b"), F.col("v.c"), width).alias("t"))


def snap_end_to_end(df: DataFrame, reference: str, geometry: str = "pts") -> DataFrame:
    """df with its lines' first and last points moved to the nearer end of a reference line (a column of points; the first
    of two as near). Lines of fewer than two points, and those whose reference is null or empty, stay as they are."""
    c, pts, ref = F.col, F.col(geometry), F.col(reference)
    a, b = F.element_at(ref, 1), F.element_at(ref, -1)
    far = lambda p, q: (p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])
    nearer = lambda p: F.when(far(p, a) <= far(p, b), a).otherwise(b)
    inner = F.slice(pts, F.lit(2), F.greatest(F.size(pts) - 2, F.lit(0)))
    moved = F.concat(F.array(nearer(F.element_at(pts, 1))), inner, F.array(nearer(F.element_at(pts, -1))))
    return df.withColumn(geometry, F.when((F.size(pts) >= 2) & (F.size(c(reference)) > 0), moved).otherwise(pts))
