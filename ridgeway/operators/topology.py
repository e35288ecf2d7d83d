"""Lines as a network: crossings, splitting, common vertices, which lines continue each other, and groups of them.

Lines are (id, pts) with integer ids. Vertices are ends of lines with equal coordinates, to a tolerance.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeway.functions import geom as g
from ridgeway.operators import kernels
from ridgeway.operators.components import connected_components
from ridgeway.operators.spatial_join import grid_join
from ridgeway.session import written

#: Classes of a vertex by its number of line ends and of connected pairs.
VERTEX_CLASSES = {
    (2, 0): 1, (3, 0): 2, (3, 1): 3, (4, 0): 4, (4, 1): 5, (4, 2): 6, (5, 0): 7, (5, 1): 8, (5, 2): 9, (1, 0): 10,
}


def flat_segments(lines: DataFrame) -> DataFrame:
    """(id, seg, ax, ay, bx, by, x0, y0, x1, y1): segments with their bounds; those without length are left out."""
    s = lines.select("id", F.posexplode(g.segments(F.col("pts"))).alias("seg", "s"))
    s = s.select("id", "seg", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))
    s = s.filter("ax <> bx OR ay <> by")
    return s.select("*", F.least("ax", "bx").alias("x0"), F.least("ay", "by").alias("y0"), F.greatest("ax", "bx").alias("x1"), F.greatest("ay", "by").alias("y1"))


def _paired(lines: DataFrame, size: float) -> DataFrame:
    """Segments of different lines whose bounds touch, the smaller id first; columns of the second end in 2.

    Lines are dealt out by number first, as a file of short lines may be one task's that makes all segments and grid cells.
    """
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = flat_segments(lines.select("id", "pts").repartition(parts, "id"))
    b = a.select(*[F.col(c).alias(c + "2") for c in a.columns])
    return grid_join(a, b, ["x0", "y0", "x1", "y1"], ["x02", "y02", "x12", "y12"], size, F.col("id") < F.col("id2"))


def _side(a: str, b: str, p: str) -> Column:
    c = F.col
    return g.orient(c(f"ax{a}"), c(f"ay{a}"), c(f"bx{b}"), c(f"by{b}"), c(f"{p[0]}x{p[1:]}"), c(f"{p[0]}y{p[1:]}"))


def crossings(lines: DataFrame, size: float = 32.0) -> DataFrame:
    """(a, b, x, y): where segments of two lines cross properly, neither ending on the other."""
    p = _paired(lines, size)
    c = F.col
    dx, dy, ex, ey = c("bx") - c("ax"), c("by") - c("ay"), c("bx2") - c("ax2"), c("by2") - c("ay2")
    one = g.orient(c("ax"), c("ay"), c("bx"), c("by"), c("ax2"), c("ay2")) * g.orient(c("ax"), c("ay"), c("bx"), c("by"), c("bx2"), c("by2"))
    two = g.orient(c("ax2"), c("ay2"), c("bx2"), c("by2"), c("ax"), c("ay")) * g.orient(c("ax2"), c("ay2"), c("bx2"), c("by2"), c("bx"), c("by"))
    d = dx * ey - dy * ex
    t = ((c("ax2") - c("ax")) * ey - (c("ay2") - c("ay")) * ex) / d
    return p.filter((one < 0) & (two < 0)).select(c("id").alias("a"), c("id2").alias("b"), (c("ax") + dx * t).alias("x"), (c("ay") + dy * t).alias("y"))


def meetings(lines: DataFrame, size: float = 32.0) -> DataFrame:
    """(a, b, points, overlaps): what two lines have in common: distinct points, and middles of overlapping stretches.

    Points are told apart to 1e-6. Points at the ends of an overlap belong to it.
    """
    p = _paired(lines, size)
    c = F.col
    dx, dy, ex, ey = c("bx") - c("ax"), c("by") - c("ay"), c("bx2") - c("ax2"), c("by2") - c("ay2")
    fx, fy = c("ax2") - c("ax"), c("ay2") - c("ay")
    # Steps are exploded, not filtered by: Catalyst would put the tests before those of the bounds in the join's condition,
    # and every candidate of a grid cell would pay for them.
    step = F.struct(dx.alias("dx"), dy.alias("dy"), fx.alias("fx"), fy.alias("fy"), (dx * ey - dy * ex).alias("d"), (fx * ey - fy * ex).alias("tn"), (fx * dy - fy * dx).alias("un"))
    p = p.select(c("id").alias("a"), c("id2").alias("b"), "ax", "ay", "ax2", "ay2", "bx2", "by2", F.explode(F.array(step)).alias("v")).select("a", "b", "ax", "ay", "ax2", "ay2", "bx2", "by2", "v.*")
    t, u = c("tn") / F.when(c("d") != 0, c("d")), c("un") / F.when(c("d") != 0, c("d"))
    crossed = (c("d") != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    aligned = (c("d") == 0) & (c("un") == 0)
    n = c("dx") * c("dx") + c("dy") * c("dy")
    s0, s1 = (c("fx") * c("dx") + c("fy") * c("dy")) / n, ((c("bx2") - c("ax")) * c("dx") + (c("by2") - c("ay")) * c("dy")) / n
    lo, hi = F.greatest(F.least(s0, s1), F.lit(0.0)), F.least(F.greatest(s0, s1), F.lit(1.0))
    none = F.lit(None).cast("double")
    held = lambda at, lo, hi: F.array(F.struct("ax", "ay", "dx", "dy", at.alias("at"), lo.alias("lo"), hi.alias("hi")))
    rows = p.select("a", "b", F.explode(F.when(crossed, held(t, none, none)).when(aligned, held(none, lo, hi))).alias("v")).select("a", "b", "v.*")
    rows = rows.filter("at IS NOT NULL OR lo <= hi")
    long = c("lo") < c("hi")
    rows = rows.select("a", "b", "ax", "ay", "dx", "dy", F.when(c("lo") == c("hi"), c("lo")).otherwise(c("at")).alias("at"), F.when(long, (c("lo") + c("hi")) / 2).alias("mid"), F.when(long, c("lo")).alias("lo"), F.when(long, c("hi")).alias("hi"))
    place = lambda t: F.when(t.isNotNull(), g.point(F.round(c("ax") + c("dx") * t, 6), F.round(c("ay") + c("dy") * t, 6)))
    rows = rows.select("a", "b", F.struct(place(c("at")).alias("p"), place(c("mid")).alias("m"), place(c("lo")).alias("e0"), place(c("hi")).alias("e1")).alias("v"))
    found = rows.groupBy("a", "b").agg(F.collect_list("v").alias("v"))  # one list: with four sets this took longer than the join
    some = lambda name: F.filter(F.transform("v", lambda v: v[name]), lambda p: p.isNotNull())
    points, overlaps = F.array_sort(F.array_except(some("p"), F.array_union(some("e0"), some("e1")))), F.array_sort(F.array_distinct(some("m")))
    only = lambda name: F.when(F.get("v", F.lit(0))[name].isNotNull(), F.array(F.get("v", F.lit(0))[name])).otherwise(F.array().cast(g.LINE))
    one = F.size("v") == 1
    both = F.struct(F.when(one, only("p")).otherwise(points).alias("points"), F.when(one, only("m")).otherwise(overlaps).alias("overlaps"))
    return found.select("a", "b", F.explode(F.array(both)).alias("w")).select("a", "b", "w.points", "w.overlaps")  # made once, however often they are used


def least_distance(points: Column) -> Column:
    """The least distance between two of some points; null for fewer than two."""
    far = F.transform(points, lambda p, i: F.array_min(F.transform(F.filter(points, lambda q, j: j > i), lambda q: g.point_distance(p, q))))
    return F.array_min(F.filter(far, lambda d: d.isNotNull()))


def split_points(met: DataFrame) -> DataFrame:
    """(x, y): where lines are to be split: common points, and the middle of a single overlap."""
    single = F.when((F.size("overlaps") == 1) & (F.size("points") == 0), F.col("overlaps")).when(F.size("overlaps") == 0, F.col("points")).otherwise(F.array().cast(g.LINE))
    return met.select(F.explode(single).alias("p")).select("p.x", "p.y").distinct()


def intersection_status(lines: DataFrame, met: DataFrame) -> DataFrame:
    """(id, inter_status): 0 for lines that meet another in several points close together, or in points and stretches; else 1."""
    several = (F.size("overlaps") == 0) & (F.size("points") > 1) & (least_distance(F.col("points")) <= g.CLOSE)
    mixed = (F.size("overlaps") > 1) | ((F.size("overlaps") == 1) & (F.size("points") > 0))
    bad = met.filter(several | mixed).select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("bad", F.lit(0))
    return lines.select("id").join(bad, "id", "left").select("id", F.coalesce("bad", F.lit(1)).alias("inter_status"))


def split_lines(lines: DataFrame, met: DataFrame) -> DataFrame:
    """(id, piece, pts): lines cut where they meet others; points at their own ends don't cut, and no piece is shorter than 1e-3."""
    single = F.when((F.size("overlaps") == 1) & (F.size("points") == 0), F.col("overlaps")).when(F.size("overlaps") == 0, F.col("points")).otherwise(F.array().cast(g.LINE))
    cuts = met.select(F.explode(F.array("a", "b")).alias("id"), F.explode(single).alias("p"))
    cuts = cuts.groupBy("id").agg(F.collect_set("p").alias("cuts"))
    rows = lines.join(cuts, "id", "left").withColumn("m", g.measured(F.col("pts"))).withColumn("len", g.length(F.col("pts")))
    none = F.array().cast("array<double>")
    ends = lambda p: F.least(g.point_distance(p, F.element_at("pts", 1)), g.point_distance(p, F.element_at("pts", -1)))
    inner = F.transform(F.filter(F.coalesce("cuts", F.array().cast(g.LINE)), lambda p: ends(p) >= g.EPSILON), lambda p: g.nearest(F.col("m"), p)["along"])
    rows = rows.withColumn("d", F.array_sort(F.concat(F.array(F.lit(0.0)), F.coalesce(inner, none), F.array("len"))))
    n = F.size("d") - 1
    rows = rows.select("id", "pts", "m", F.explode(F.filter(F.zip_with(F.slice("d", F.lit(1), n), F.slice("d", F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda s: s["b"] - s["a"] > g.SMALL)).alias("s"))
    rows = rows.withColumn("from", F.col("s.a")).withColumn("to", F.col("s.b"))
    between = F.transform(F.filter("m", lambda s: (s["from"] > F.col("from") + 1e-9) & (s["from"] < F.col("to") - 1e-9)), lambda s: s["a"])
    pts = F.concat(F.array(g.interpolate(F.col("m"), F.col("from"))), between, F.array(g.interpolate(F.col("m"), F.col("to"))))
    from pyspark.sql import Window as W

    number = F.row_number().over(W.partitionBy("id").orderBy("from")) - 1
    return rows.select("id", number.alias("piece"), pts.alias("pts"))


def line_ends(lines: DataFrame) -> DataFrame:
    """(id, end, x, y, angle): both ends (0 and -1) of every line, the angle pointing inward."""
    both = []
    for end in (0, -1):
        p, q = g.end_and_next(F.col("pts"), end)
        both.append(F.struct(F.lit(end).alias("end"), p["x"].alias("x"), p["y"].alias("y"), g.azimuth(p, q).alias("angle")))
    return lines.filter(F.size("pts") >= 2).select("id", F.explode(F.array(*both)).alias("e")).select("id", "e.*")


def vertices(ends: DataFrame, tolerance: float = g.SMALL, keep: tuple[str, ...] = ()) -> DataFrame:
    """(kx, ky, x, y, ends): ends at one place, as an array sorted by line and end (the last first); one shuffle."""
    at = lambda c: F.round(F.col(c) / tolerance).cast("long")
    rows = ends.select(at("x").alias("kx"), at("y").alias("ky"), "x", "y", F.struct("id", "end", "angle", *keep).alias("e"))
    return rows.groupBy("kx", "ky").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.sort_array(F.collect_list("e")).alias("ends"))


def continues(a: Column, b: Column, tolerance: float = g.ANGLE_TOLERANCE) -> Column:
    """Whether two ends at a vertex lie on one way: equal directions, or opposite ones, to a tolerance."""
    d = F.abs(a - b)
    folded = F.when(d <= math.pi, d).otherwise(d - math.pi)
    return (folded < tolerance) | ((d > math.pi - tolerance) & (d < math.pi + tolerance))


def pairs_by_angle(ends: Column) -> Column:
    """array<struct<a,b>> of line ids that continue each other at a vertex.

    Of two ends both. Of more, each end goes with the first before it whose direction fits.
    """
    n = F.size(ends)
    pair = lambda a, b: F.struct(a["id"].alias("a"), b["id"].alias("b"))
    pairs = F.filter(
        F.transform(
            ends,
            lambda e, j: F.when(
                j > 0, F.get(F.transform(F.filter(F.slice(ends, F.lit(1), F.greatest(j, F.lit(1))), lambda o: continues(o["angle"], e["angle"])), lambda o: pair(o, e)), F.lit(0))
            ),
        ),
        lambda p: p.isNotNull(),
    )
    two = F.array(pair(F.element_at(ends, 1), F.element_at(ends, F.least(n, F.lit(2)))))
    return F.when(n == 2, two).when(n > 2, pairs).otherwise(F.slice(two, 1, 0))


def groups_at_vertex(ends: Column, group: str = "grp") -> Column:
    """array<struct<a,b>>: neighbours among the lines of one group at a vertex; lines without a group (-1) are one."""
    key = lambda e: F.coalesce(e[group], F.lit(-1))
    before = lambda e, j: F.filter(F.slice(ends, F.lit(1), F.greatest(j, F.lit(1))), lambda o: key(o) == key(e))
    pairs = F.transform(ends, lambda e, j: F.when(j > 0, F.transform(F.slice(before(e, j), 1, 1), lambda o: F.struct(o["id"].alias("a"), e["id"].alias("b")))))
    return F.flatten(F.filter(pairs, lambda p: p.isNotNull()))


def vertex_class(ends: Column, connected: Column) -> Column:
    """The class of a vertex, or null: by its ends and how many connected pairs they form."""
    out = F.lit(None).cast("int")
    for (n, k), code in VERTEX_CLASSES.items():
        out = F.when((F.size(ends) == n) & ((F.size(connected) == k) if n > 1 else F.lit(True)), code).otherwise(out)
    return out


def vertex_table(lines: DataFrame, tolerance: float = g.SMALL, simplify: float = 0.0) -> DataFrame:
    """(kx, ky, x, y, ends, connected, not_connected, class): the network's vertices. With `simplify`, directions come from simplified lines."""
    v = vertices(line_ends(simplified(lines, simplify) if simplify else lines), tolerance).withColumn("connected", pairs_by_angle(F.col("ends")))
    used = F.flatten(F.transform("connected", lambda p: F.array(p["a"], p["b"])))
    ids = F.transform("ends", lambda e: e["id"])
    v = v.withColumn("not_connected", F.array_except(ids, used))
    return v.withColumn("class", vertex_class(F.col("ends"), F.col("connected")))


def line_groups(lines: DataFrame, table: DataFrame) -> DataFrame:
    """(id, bt_group): lines joined by connected pairs, numbered by the smallest id; a line by itself is its own."""
    edges = table.select(F.explode("connected").alias("p")).select("p.a", "p.b")
    found = connected_components(edges)
    return lines.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("bt_group"))


def simplified(lines: DataFrame, tolerance: float) -> DataFrame:
    """(id, pts) by Douglas-Peucker, in Arrow batches; lines of two points stay, and only longer ones are looked at."""

    def run(batches):
        for batch in batches:
            line = batch.column("pts")
            sizes = line.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = line.flatten()
            xy = np.stack([flat.field("x").to_numpy(zero_copy_only=False), flat.field("y").to_numpy(zero_copy_only=False)], 1).astype(float)
            at = np.concatenate([[0], np.cumsum(sizes)])
            if (sizes > 2).any():
                parts = [kernels.simplify(xy[a:b], tolerance) if b - a > 2 else xy[a:b] for a, b in zip(at[:-1], at[1:])]
                xy, at = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            points = pa.StructArray.from_arrays([pa.array(xy[:, 0].copy()), pa.array(xy[:, 1].copy())], names=["x", "y"])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), points)], names=["id", "pts"])

    return lines.select(F.col("id").cast("long").alias("id"), "pts").mapInArrow(run, f"id bigint, pts {g.LINE}")


class _Nodes:
    """Places numbered as they come, found again by a grid instead of a look at all of them."""

    def __init__(self, reach: float):
        self.reach, self.places, self.grid = reach, [], {}

    def near(self, p) -> list[int]:
        """Numbers, in order, of the places in the grid cells around a point, which hold all that are within reach."""
        x, y = math.floor(p[0] / self.reach), math.floor(p[1] / self.reach)
        return sorted(i for dx in (-1, 0, 1) for dy in (-1, 0, 1) for i in self.grid.get((x + dx, y + dy), ()))

    def add(self, p) -> int:
        self.grid.setdefault((math.floor(p[0] / self.reach), math.floor(p[1] / self.reach)), []).append(len(self.places))
        self.places.append(p)
        return len(self.places) - 1


def join_paths(parts: list[np.ndarray], snap: float = 0.0) -> list[np.ndarray]:
    """Parts joined where exactly two of their ends meet, in order of the parts; closed rings stay as they are.

    snap: ends this close are one node; the first seen gives its place.
    """
    nodes = _Nodes(snap or 1.0)

    def node(p):
        return next((i for i in nodes.near(p) if np.hypot(*(p - nodes.places[i])) <= snap), None)

    if snap == 0:
        known: dict[tuple, int] = {}
        ends = [(known.setdefault(tuple(p[0]), len(known)), known.setdefault(tuple(p[-1]), len(known))) for p in parts]
    else:
        ends = [tuple(nodes.add(q) if (i := node(q)) is None else i for q in (p[0], p[-1])) for p in parts]
    at: dict[int, list[int]] = {}
    for i, (a, b) in enumerate(ends):
        at.setdefault(a, []).append(i)
        at.setdefault(b, []).append(i)
    used, out = set(), []

    def walk(i, start):
        """From a part onward, away from a node."""
        chain, here = [], start
        while True:
            used.add(i)
            a, b = ends[i]
            chain.append(parts[i] if a == here else parts[i][::-1])
            here = b if a == here else a
            ahead = [j for j in at[here] if j not in used]
            if len(at[here]) != 2 or not ahead:
                return chain, here
            i = ahead[0]

    def glued(chain):
        return np.concatenate([chain[0]] + [c[1:] for c in chain[1:]])

    for i, (a, b) in enumerate(ends):  # from nodes where a path ends or branches
        for start in (a, b):
            if i not in used and len(at[start]) != 2:
                out.append(glued(walk(i, start)[0]))
    for i, (a, _) in enumerate(ends):  # what is left are rings
        if i not in used:
            out.append(glued(walk(i, a)[0]))
    return out


def merge_parts(parts: list[np.ndarray]) -> list[np.ndarray]:
    """One line where the parts form one; else per component, ends snapped to 1: a path is joined, a branched one keeps its parts.

    A component of a single part is kept.
    """
    parts = [p for p in parts if len(p) > 1 and np.hypot(*np.diff(p, axis=0).T).sum() > g.SMALL]
    if not parts:
        return []
    merged = join_paths(parts)
    if len(merged) == 1:
        return merged
    nodes = _Nodes(1.0)
    ends = []
    for p in merged:
        pair = []
        for q in (p[0], p[-1]):
            near = [i for i in nodes.near(q) if np.hypot(*(nodes.places[i] - q)) < 1.0]
            pair.append(near[-1] if near else nodes.add(q))
        ends.append(tuple(pair))
    parent = list(range(len(nodes.places)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in ends:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    out = []
    for c in sorted({root(a) for a, _ in ends}):
        own = [i for i, (a, _) in enumerate(ends) if root(a) == c]
        degree = np.bincount([n for i in own for n in ends[i]], minlength=len(nodes.places))
        if degree.max() >= 3 or len(own) == 1:
            out += [merged[i] for i in own]
        else:
            out += join_paths([merged[i] for i in own], snap=1.0)
    return out


def merge_lines(lines: DataFrame, group: str = "bt_group") -> DataFrame:
    """(group, part, pts): the lines of each group merged into as few as possible; one shuffle, by group.

    A group is the lines of one connected way; it is merged in one task. Groups come as arrays, many in a batch: most are
    of a line or two, and a data frame for each cost more than its merging.
    """

    def run(batches):
        for batch in batches:
            inner = batch.column("parts")
            of = np.concatenate([[0], np.cumsum(inner.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
            line = inner.flatten().field("pts")
            sizes = line.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = line.flatten()
            xy = np.stack([flat.field("x").to_numpy(zero_copy_only=False), flat.field("y").to_numpy(zero_copy_only=False)], 1).astype(float)
            at = np.concatenate([[0], np.cumsum(sizes)])
            gone = np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(xy, axis=0).T))]) if len(xy) else np.zeros(1)
            begin, last = at[:-1], np.maximum(at[1:] - 1, at[:-1])
            # Lengths by sums over the batch: far from the bound they decide, near it the part is measured itself.
            about = np.where(sizes > 1, gone[np.minimum(last, len(gone) - 1)] - gone[np.minimum(begin, len(gone) - 1)], 0.0)
            owners, numbers, out = [], [], []
            for i, (a, b) in enumerate(zip(of[:-1].tolist(), of[1:].tolist())):
                if b - a == 1 and about[a] > 1.0:
                    merged = [xy[at[a] : at[a + 1]]]
                else:
                    merged = merge_parts([xy[at[k] : at[k + 1]] for k in range(a, b)])
                owners += [i] * len(merged)
                numbers += range(len(merged))
                out += merged
            points = np.concatenate(out) if out else np.zeros((0, 2))
            ends = np.concatenate([[0], np.cumsum([len(m) for m in out])]).astype(np.int32)
            pts = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(points[:, 0].copy()), pa.array(points[:, 1].copy())], names=["x", "y"]))
            yield pa.RecordBatch.from_arrays([batch.column(group).take(pa.array(owners, pa.int64())), pa.array(numbers, pa.int32()), pts], names=[group, "part", "pts"])

    parts = lines.groupBy(F.col(group).cast("long").alias(group)).agg(F.array_sort(F.collect_list(F.struct("id", "pts"))).alias("parts"))
    return parts.mapInArrow(run, f"{group} bigint, part int, pts {g.LINE}")


def merge_or_explode(lines: DataFrame) -> DataFrame:
    """(id, part, pts): multipart lines (id, parts) merged into one where they form one, else their parts."""

    def run(frames):
        for frame in frames:
            out = {"id": [], "part": [], "pts": []}
            for i, parts in zip(frame["id"], frame["parts"]):
                arrays = [np.array([(p["x"], p["y"]) for p in part]) for part in parts] if parts is not None else []
                for n, m in enumerate(merge_parts(arrays)):
                    out["id"].append(i)
                    out["part"].append(n)
                    out["pts"].append([{"x": float(x), "y": float(y)} for x, y in m])
            yield pd.DataFrame(out).astype({"id": "int64", "part": "int32"})

    return lines.select("id", "parts").mapInPandas(run, f"id bigint, part int, pts {g.LINE}")


def split_layers(left: DataFrame) -> dict[str, DataFrame]:
    """The layers of a split: split_lines (id, piece, pts), inter_points (x, y), and invalid_splits (id, pts): the lines that
    meet others in a way that can't be split."""
    met = written(meetings(left), "meetings")
    status = intersection_status(left, met)
    return {
        "split_lines": split_lines(left, met),
        "inter_points": split_points(met),
        "invalid_splits": left.join(status.filter("inter_status = 0"), "id", "left_semi").select("id", "pts"),
    }


def vertices_of(table: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows of a vertex table whose vertices hold one of the changed lines (id); each vertex once."""
    held = table.select("kx", "ky", F.explode(F.array_distinct(F.transform("ends", lambda e: e["id"]))).alias("id"))
    at = held.join(changed.select("id").distinct(), "id", "left_semi").select("kx", "ky").distinct()
    return table.join(at, ["kx", "ky"], "left_semi")
