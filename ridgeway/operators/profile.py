"""Rings beside a line, their percentiles, and the change-point that tells how wide the open strip is."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeway.functions import geom as g
from ridgeway.operators.spatial_join import grid_join

#: Levels of the height difference between neighbouring rings, tried in this order.
LEVELS = (1.5, 1.4, 1.2999999999999998, 1.1999999999999997)


def ring_cells(lines: DataFrame, cells: DataFrame, rings: int = 15, width: float = 1.0, size: float = 32.0) -> DataFrame:
    """(id, side, ring, h): the cells of each ring beside a two-point line, between its ends. A cell on the line is left."""
    reach, c = rings * width, F.col
    a = lines.select(
        "id", "x1", "y1", "x2", "y2",
        (F.least("x1", "x2") - reach).alias("bx0"), (F.least("y1", "y2") - reach).alias("by0"), (F.greatest("x1", "x2") + reach).alias("bx1"), (F.greatest("y1", "y2") + reach).alias("by1"),
        g.distance(c("x1"), c("y1"), c("x2"), c("y2")).alias("len"),
    ).filter("len > 0")
    dx, dy = c("x2") - c("x1"), c("y2") - c("y1")
    along = (c("x") - c("x1")) * dx + (c("y") - c("y1")) * dy
    cross = dx * (c("y") - c("y1")) - dy * (c("x") - c("x1"))
    inside = (along >= 0) & (along <= c("len") * c("len")) & (F.abs(cross) < reach * c("len"))
    met = grid_join(a, cells.select("x", "y", "h"), ["bx0", "by0", "bx1", "by1"], ["x", "y", "x", "y"], size, inside, sparse=True)
    return met.select("id", F.when(cross >= 0, "left").otherwise("right").alias("side"), F.floor(F.abs(cross) / c("len") / width).cast("int").alias("ring"), "h").filter(F.col("ring") < rings)


def ring_cells_along(lines: DataFrame, cells: DataFrame, rings: int = 15, width: float = 1.0, size: float = 32.0) -> DataFrame:
    """(id, side, ring, h): the same beside lines (id, pts) of any number of points, as one strip along the whole line.

    A cell belongs to the nearest segment; outside a bend it is as far as the bend's point, on the side that halves it.
    Only the line's own ends bound the strip. Of two-point lines the result is that of ring_cells.
    """
    c, reach = F.col, rings * width
    long = lines.filter(F.size("pts") > 2).select("id", g.segments(c("pts")).alias("s"))
    long = long.select("id", F.filter("s", lambda p: g.point_distance(p["a"], p["b"]) > 0).alias("s"))
    s = long.select("id", F.size("s").alias("n"), F.posexplode("s").alias("seg", "p")).select("id", "n", "seg", *[c(f"p.{e}.{v}").alias(f"{v}{i}") for i, e in ((1, "a"), (2, "b")) for v in ("x", "y")])
    s = s.select(
        "*", (F.least("x1", "x2") - reach).alias("bx0"), (F.least("y1", "y2") - reach).alias("by0"), (F.greatest("x1", "x2") + reach).alias("bx1"), (F.greatest("y1", "y2") + reach).alias("by1"),
        g.distance(c("x1"), c("y1"), c("x2"), c("y2")).alias("len"),
    )
    dx, dy = c("x2") - c("x1"), c("y2") - c("y1")
    along = ((c("x") - c("x1")) * dx + (c("y") - c("y1")) * dy) / c("len")
    cross = (dx * (c("y") - c("y1")) - dy * (c("x") - c("x1"))) / c("len")
    bounded = ((c("seg") > 0) | (along >= 0)) & ((c("seg") < c("n") - 1) | (along <= c("len")))
    far = F.when(along < 0, g.distance(c("x"), c("y"), c("x1"), c("y1"))).when(along > c("len"), g.distance(c("x"), c("y"), c("x2"), c("y2"))).otherwise(F.abs(cross))
    met = grid_join(s, cells.select("x", "y", "h"), ["bx0", "by0", "bx1", "by1"], ["x", "y", "x", "y"], size, far < reach, sparse=True)
    one = met.select("id", "x", "y", "h", F.struct(far.alias("far"), cross.alias("cross"), bounded.alias("bounded")).alias("d"))
    one = one.groupBy("id", "x", "y", "h").agg(F.min("d.far").alias("far"), F.collect_list("d").alias("d"))
    tied = F.filter("d", lambda d: d["far"] <= c("far") + 1e-9)  # at a bend its two segments
    one = one.withColumn("d", tied).filter(F.exists("d", lambda d: d["bounded"]))
    side = F.aggregate("d", F.lit(0.0), lambda t, d: t + d["cross"])
    many = one.select("id", F.when(side >= 0, "left").otherwise("right").alias("side"), F.floor(c("far") / width).cast("int").alias("ring"), "h").filter(c("ring") < rings)
    two = lines.filter(F.size("pts") == 2).select("id", *[F.get("pts", F.lit(i))[v].alias(f"{v}{i + 1}") for i in (0, 1) for v in ("x", "y")])
    return ring_cells(two, cells, rings, width, size).unionByName(many)


def rings_of(line: np.ndarray, x: np.ndarray, y: np.ndarray, h: np.ndarray, share: float, rings: int = 15, width: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(n, p) of one line, a row for each side (left first) and a column for each ring: what ring_percentiles() has of
    ring_cells_along(), step by step. h: nan is nodata. n is -1 and p nan where a ring has no cells, n 0 and p nan where
    it has none with a height."""
    reach = rings * width
    d = np.diff(line, axis=0)
    size = np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1])
    a, b, d, size = (v[size > 0] for v in (line[:-1], line[1:], d, size))
    if len(line) == 2:
        along, cross = (x - a[0, 0]) * d[0, 0] + (y - a[0, 1]) * d[0, 1], d[0, 0] * (y - a[0, 1]) - d[0, 1] * (x - a[0, 0])
        held = (along >= 0) & (along <= size[0] * size[0]) & (np.abs(cross) < reach * size[0])
        side, far = cross, np.abs(cross) / size[0]
    else:
        fars, crosses, inner = [], [], []
        for i in range(len(a)):
            px, py = x - a[i, 0], y - a[i, 1]
            along, cross = (px * d[i, 0] + py * d[i, 1]) / size[i], (d[i, 0] * py - d[i, 1] * px) / size[i]
            qx, qy = x - b[i, 0], y - b[i, 1]
            fars.append(np.where(along < 0, np.sqrt(px * px + py * py), np.where(along > size[i], np.sqrt(qx * qx + qy * qy), np.abs(cross))))
            crosses.append(cross)
            inner.append(((along >= 0) | (i > 0)) & ((along <= size[i]) | (i < len(a) - 1)))
        far, side, held = np.min(fars, axis=0), np.zeros(len(x)), np.zeros(len(x), bool)
        for f, cross, bounded in zip(fars, crosses, inner):
            tied = (f <= far + 1e-9) & (f < reach)  # at a bend its two segments
            side += np.where(tied, cross, 0.0)
            held |= tied & bounded
        held &= far < reach
    ring = np.floor(far[held] / width).astype(np.int64)
    key = np.where(side[held] >= 0, 0, rings) + ring
    value = h[held][ring < rings]
    key = key[ring < rings]
    order = np.lexsort((value, key))  # nodata last
    key, value = key[order], value[order]
    there, n = np.bincount(key, minlength=2 * rings), np.bincount(key[~np.isnan(value)], minlength=2 * rings)
    first, some = np.cumsum(there) - there, n > 0
    at = (n[some] - 1) * share
    lower, upper = np.floor(at).astype(np.int64), np.ceil(at).astype(np.int64)
    lo, hi = value[first[some] + lower], value[first[some] + upper]
    p = np.full(2 * rings, np.nan)
    p[some] = np.where((upper == lower) | (lo == hi), lo, (upper - at) * lo + (at - lower) * hi)
    return np.where(there > 0, n, -1).reshape(2, rings), p.reshape(2, rings)


def ring_percentiles(ringed: DataFrame, percentile: float = 50.0) -> DataFrame:
    """(id, side, ring, n, p): the percentile of the cells of each ring, linear between ranks; outside (0, 100] it is 50."""
    share = (percentile if 0 < percentile <= 100 else 50.0) / 100
    return ringed.groupBy("id", "side", "ring").agg(F.count("h").alias("n"), F.percentile("h", F.lit(share)).alias("p"))


def profile(percentiles: DataFrame, rings: int = 15, default: float = 0.5) -> DataFrame:
    """(id, side, p): the rings' percentiles as an array; a ring without cells has the default."""
    held = percentiles.groupBy("id", "side").agg(F.map_from_entries(F.collect_list(F.struct("ring", F.coalesce("p", F.lit(default))))).alias("m"))
    return held.select("id", "side", F.transform(F.sequence(F.lit(0), F.lit(rings - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(default))).alias("p"))


def median_of(p: Column) -> Column:
    s = F.array_sort(F.filter(p, lambda v: v.isNotNull() & ~F.isnan(v)))
    n = F.size(s)
    return F.when(n > 0, (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2 + 1).cast("int"))) / 2)


def rate_of_change(p: Column) -> Column:
    """struct<dist, height>: where the ring medians first rise by a level, and the height there.

    The highest level with a hit counts; the last ring is never tested, and the ring must be at 0.5 or above. Without
    a hit the median of the rings decides; without a median the distance is a fifth of the rings.
    """
    n = F.size(p)
    tested = F.sequence(F.lit(0), n - 2)

    def first(level: float) -> Column:
        rise = lambda i: F.when(i == 0, F.lit(0.0)).otherwise(F.element_at(p, i + 1) - F.element_at(p, F.greatest(i, F.lit(1))))
        return F.array_min(F.filter(tested, lambda i: (F.element_at(p, i + 1) >= 0.5) & (rise(i) >= level)))

    hit = F.coalesce(*[first(x) for x in LEVELS])
    dist = (hit + 1).cast("double")
    floor = F.floor(F.element_at(p, hit + 1)).cast("double")
    height = F.when((floor <= 0.5) & (dist > 5), 2.0).when((floor > 15) & (dist > 4), 15.5).otherwise(floor)
    m = median_of(p)
    low = F.floor(m).cast("double")
    without = (
        F.when(m.isNull(), F.struct((n / 5).alias("dist"), F.lit(0.5).alias("height")))
        .when(m <= 0.5, F.struct(F.lit(4.0).alias("dist"), F.lit(0.5).alias("height")))
        .when(m <= 5, F.struct(F.lit(4.5).alias("dist"), low.alias("height")))
        .when(m <= 10, F.struct(F.lit(5.5).alias("dist"), low.alias("height")))
        .when(m <= 15, F.struct(F.lit(6.0).alias("dist"), low.alias("height")))
        .otherwise(F.struct(F.lit(5.0).alias("dist"), F.lit(15.5).alias("height")))
    )
    return F.when(hit.isNull(), without).otherwise(F.struct(dist.alias("dist"), height.alias("height")))


def thresholds_of(df: DataFrame, left: str, right: str, default: float = 0.5) -> DataFrame:
    """df with the columns of thresholds() from its rings' percentiles on either side, as arrays in one row: nan or null is a
    ring without cells, a null array a missing side. No shuffle."""
    for name, p in (("__l", left), ("__r", right)):
        filled = F.transform(p, lambda v: F.coalesce(F.nanvl(v, F.lit(None).cast("double")), F.lit(default)))
        df = df.withColumn(name, F.explode(F.array(F.when(F.col(p).isNotNull(), g.let(filled, rate_of_change)))))  # made once
    names = {"cl_cutht": "__l.height", "cr_cutht": "__r.height", "ldist_cut": "__l.dist", "rdist_cut": "__r.dist"}
    for name, of in names.items():
        df = df.withColumn(name, F.col(of))
    return df.drop("__l", "__r").withColumn("dyncanth", (F.col("cl_cutht") + F.col("cr_cutht")) / 2)


def thresholds(profiles: DataFrame) -> DataFrame:
    """(id, cl_cutht, cr_cutht, ldist_cut, rdist_cut, dyncanth) from (id, side, p), side left or right; one shuffle.

    The dynamic canopy threshold is the mean of both sides' heights, null when a side is missing.
    """
    found = profiles.select("id", "side", rate_of_change(F.col("p")).alias("c"))
    of = lambda side, field: F.max(F.when(F.col("side") == side, F.col(f"c.{field}")))
    out = found.groupBy("id").agg(of("left", "height").alias("cl_cutht"), of("right", "height").alias("cr_cutht"), of("left", "dist").alias("ldist_cut"), of("right", "dist").alias("rdist_cut"))
    return out.withColumn("dyncanth", (F.col("cl_cutht") + F.col("cr_cutht")) / 2)
