"""Geometry as column expressions: points are struct<x,y>, lines and rings arrays of points, polygons arrays of rings.

Everything here stays inside the JVM and needs no shuffle. A null or empty line gives null measures.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How near coordinates, distances and end points count as equal.
SMALL, EPSILON, CLOSE, ANGLE_TOLERANCE = 1e-3, 1e-5, 2.0, math.pi / 10

POINT = "struct<x:double,y:double>"
LINE = f"array<{POINT}>"


def r6(col: Column | str) -> Column:
    """Rounded for comparison, without negative zeros."""
    return F.round(col, 6) + F.lit(0.0)


def let(value: Column, fn) -> Column:
    """fn(value) with the value evaluated once, however often fn uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))


def point_distance(a: Column, b: Column) -> Column:
    return distance(a["x"], a["y"], b["x"], b["y"])


def segments(line: Column) -> Column:
    """Consecutive pairs of points, as array<struct<a,b>>; empty for fewer than two."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.zip_with(F.slice(line, F.lit(1), n), F.slice(line, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def triples(line: Column) -> Column:
    """Each interior point with its neighbours, as array<struct<a,b,c>>."""
    n = F.greatest(F.size(line) - 2, F.lit(0))
    pairs = F.zip_with(F.slice(line, F.lit(1), n), F.slice(line, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.zip_with(pairs, F.slice(line, F.lit(3), n), lambda p, c: F.struct(p["a"].alias("a"), p["b"].alias("b"), c.alias("c")))


def length(line: Column) -> Column:
    return F.aggregate(segments(line), F.lit(0.0), lambda s, g: s + point_distance(g["a"], g["b"]))


def ring_area(ring: Column) -> Column:
    """Area inside a closed ring by cross products."""
    cross = F.aggregate(segments(ring), F.lit(0.0), lambda s, g: s + (g["a"]["x"] * g["b"]["y"] - g["b"]["x"] * g["a"]["y"]))
    return F.abs(cross) / 2


def polygon_area(rings: Column) -> Column:
    """The first ring less the others."""
    areas = F.transform(rings, ring_area)
    return areas[0] * 2 - F.aggregate(areas, F.lit(0.0), lambda s, a: s + a)


def remove_holes(rings: Column) -> Column:
    return F.slice(rings, 1, 1)


def bounds(line: Column) -> Column:
    xs, ys = F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def line_centroid(line: Column) -> Column:
    """Mean of the segments' midpoints, by length."""
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(s, g):
        w = point_distance(g["a"], g["b"])
        return F.struct((s["w"] + w).alias("w"), (s["x"] + w * (g["a"]["x"] + g["b"]["x"]) / 2).alias("x"), (s["y"] + w * (g["a"]["y"] + g["b"]["y"]) / 2).alias("y"))

    return F.aggregate(segments(line), zero, add, lambda s: point(s["x"] / s["w"], s["y"] / s["w"]))


def without_repeats(line: Column) -> Column:
    """The line less points equal to the one before them."""
    return let(line, lambda v: F.filter(v, lambda p, i: (i == 0) | (p != F.element_at(v, F.greatest(i, F.lit(1))))))


def end_and_next(line: Column, end: int) -> tuple[Column, Column]:
    """The point at an end (0 or -1) and its neighbour inward."""
    return (F.element_at(line, 1), F.element_at(line, 2)) if end == 0 else (F.element_at(line, -1), F.element_at(line, -2))


def slope_angle(a: Column, b: Column) -> Column:
    """Direction from a to b by arctangent, in [-pi/2, 3pi/2); a vertical one, or none, is plus or minus pi/2."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    upright = F.abs(dx) <= 1e-8 + 1e-5 * F.abs(b["x"])
    up = F.when(dy < 0, F.lit(-math.pi / 2)).otherwise(F.lit(math.pi / 2))
    return F.when(upright, up).otherwise(F.atan(dy / F.when(upright, 1.0).otherwise(dx)) + F.when(dx < 0, math.pi).otherwise(0.0))


def azimuth(a: Column, b: Column) -> Column:
    """Direction from a to b in (-pi, pi]."""
    return F.atan2(b["y"] - a["y"], b["x"] - a["x"])


def ray(start: Column, angle: Column, far: Column | float) -> Column:
    return point(start["x"] + F.cos(angle) * far, start["y"] + F.sin(angle) * far)


def bisector_transect(a: Column, b: Column, c: Column, width: float) -> Column:
    """A line of this length through b that halves the angle between a and c, as struct<a,b>."""
    angle = let(azimuth(b, a), lambda first: first + (azimuth(b, c) - first) / 2)
    return let(angle, lambda t: F.struct(ray(b, t, width / 2).alias("a"), ray(b, t, -width / 2).alias("b")))


def normal_transect(a: Column, b: Column, width: float) -> Column:
    """A line of this length through b, square to a-b, as struct<a,b>."""
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    angle = F.when(F.abs(dx) <= 0.0, math.pi / 2).otherwise(F.atan(dy / F.when(dx == 0, 1.0).otherwise(dx))) + math.pi / 2
    return F.struct(ray(b, angle, width / 2).alias("a"), ray(b, angle, -width / 2).alias("b"))


def end_transect(end: Column, inner: Column, reach: float) -> Column:
    """A line across an end, reaching this far to the left and right of the way inward; null if that has no direction."""
    d = point_distance(end, inner)
    nx, ny = -(inner["y"] - end["y"]) / d, (inner["x"] - end["x"]) / d
    line = F.struct(point(end["x"] + nx * reach, end["y"] + ny * reach).alias("a"), point(end["x"] - nx * reach, end["y"] - ny * reach).alias("b"))
    return F.when(d > 0, line)


def parallel_centered(a: Column, b: Column, centre: Column, width: float) -> Column:
    """A line of this length through a point, along a-b; null if that has no direction."""
    d = point_distance(a, b)
    dx, dy = (b["x"] - a["x"]) / d * (width / 2), (b["y"] - a["y"]) / d * (width / 2)
    return F.when(d > 0, F.struct(point(centre["x"] - dx, centre["y"] - dy).alias("a"), point(centre["x"] + dx, centre["y"] + dy).alias("b")))


def offset_segment(a: Column, b: Column, by: float) -> Column:
    """A parallel copy, to the left for a positive distance."""
    d = point_distance(a, b)
    nx, ny = -(b["y"] - a["y"]) / d * by, (b["x"] - a["x"]) / d * by
    return F.when(d > 0, F.struct(point(a["x"] + nx, a["y"] + ny).alias("a"), point(b["x"] + nx, b["y"] + ny).alias("b")))


def anchor(end: Column, inner: Column, far: float) -> Column:
    """The point this far from an end along its segment; null if the segment has no length."""
    d = point_distance(end, inner)
    return F.when(d > 1e-8, point(end["x"] + (inner["x"] - end["x"]) * far / d, end["y"] + (inner["y"] - end["y"]) * far / d))


def mirrored(p: Column, centre: Column) -> Column:
    return point(centre["x"] * 2 - p["x"], centre["y"] * 2 - p["y"])


def replace_end(line: Column, end: int, new: Column) -> Column:
    """The line with the point at an end (0 or -1) replaced; unchanged where the new one is null."""
    n = F.size(line)
    at = F.lit(0) if end == 0 else n - 1
    return F.when(new.isNull(), line).otherwise(F.transform(line, lambda p, i: F.when(i == at, new).otherwise(p)))


def measured(line: Column) -> Column:
    """Segments with the length before each: array<struct<a,b,from,len>>."""
    start = F.struct(F.lit(0.0).alias("d"), F.array().cast(f"array<struct<a:{POINT},b:{POINT},from:double,len:double>>").alias("out"))

    def add(s, g):
        n = point_distance(g["a"], g["b"])
        row = F.struct(g["a"].alias("a"), g["b"].alias("b"), s["d"].alias("from"), n.alias("len"))
        return F.struct((s["d"] + n).alias("d"), F.concat(s["out"], F.array(row)).alias("out"))

    return F.aggregate(segments(line), start, add, lambda s: s["out"])


def along(seg: Column, d: Column) -> Column:
    """The point of a measured segment at a distance from the line's start."""
    t = F.when(seg["len"] > 0, (d - seg["from"]) / seg["len"]).otherwise(0.0)
    return point(seg["a"]["x"] + (seg["b"]["x"] - seg["a"]["x"]) * t, seg["a"]["y"] + (seg["b"]["y"] - seg["a"]["y"]) * t)


def interpolate(measured_line: Column, d: Column) -> Column:
    """The point at a distance along a measured line, held to its ends."""
    last = F.element_at(measured_line, -1)

    def held(at):
        inside = F.filter(measured_line, lambda s: (s["from"] <= at) & (at <= s["from"] + s["len"]))
        return F.coalesce(F.get(F.transform(F.slice(inside, 1, 1), lambda s: along(s, at)), F.lit(0)), last["b"])

    return let(F.least(F.greatest(d, F.lit(0.0)), last["from"] + last["len"]), held)


def nearest(measured_line: Column, p: Column) -> Column:
    """The nearest point of a measured line: struct<d2,along,x,y>; of equally near ones the first."""

    def foot(s):
        dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        n = dx * dx + dy * dy
        share = F.when(n > 0, F.least(F.greatest(((p["x"] - s["a"]["x"]) * dx + (p["y"] - s["a"]["y"]) * dy) / n, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)

        def at(t):
            x, y = s["a"]["x"] + dx * t, s["a"]["y"] + dy * t
            d2 = (x - p["x"]) * (x - p["x"]) + (y - p["y"]) * (y - p["y"])
            return F.struct(d2.alias("d2"), (s["from"] + s["len"] * t).alias("along"), x.alias("x"), y.alias("y"))

        return let(share, at)

    return F.array_min(F.transform(measured_line, foot))


def orient(ax, ay, bx, by, cx, cy) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def in_edges(edges: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside a closed ring given by its edges, by crossings of a ray; on the border either may be."""

    def crossed(s):
        rise = s["b"]["y"] - s["a"]["y"]
        return ((s["a"]["y"] > y) != (s["b"]["y"] > y)) & (x < (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) / F.when(rise == 0, 1.0).otherwise(rise) + s["a"]["x"])

    return F.size(F.filter(edges, crossed)) % 2 == 1


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    return in_edges(segments(ring), x, y)


def segment_distance2(px, py, ax, ay, bx, by) -> Column:
    """Squared distance from a point to a segment."""
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.least(F.greatest(((px - ax) * dx + (py - ay) * dy) / n, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    x, y = ax + dx * t - px, ay + dy * t - py
    return x * x + y * y


def row_of(y: Column, y0: Column | float, cell: Column | float) -> Column:
    """The raster row of a northing; y0 is the upper edge."""
    return F.floor((F.lit(y0) - y) / cell if not isinstance(y0, Column) else (y0 - y) / cell).cast("long")


def col_of(x: Column, x0: Column | float, cell: Column | float) -> Column:
    return F.floor((x - x0) / cell).cast("long")
