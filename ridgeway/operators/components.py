"""Connected components of an edge table: contracted until few edges are left, which one task solves.

A round of contraction maps every vertex to itself or the neighbour that a hash of the round puts first, and edges to
those of their ends' images: vertices shrink by about half, whatever the order of the ids. It is an aggregation that
combines before the shuffle and joins of one row for each key, so a vertex with very many edges stays spread (AQE splits
it). At most FEW edges, a bound that doesn't grow with the input, are solved as arrays in one task; going back, each
round is one join. Rounds end in tables in the shared folder. At the end every vertex has the smallest id it can reach.
Self-loops and rows with a null end are ignored; an empty table gives an empty result; repeated edges don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeway.session import forget, written

#: Edges that one task solves: 32 MB of ids.
FEW = 1 << 21


def solve(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, the smallest id that each reaches) of edges u-v."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    return ids, ids[roots(len(ids), at[: len(u)], at[len(u) :])]


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of the numbers below n the smallest that it reaches over edges u-v."""
    root = np.arange(n)
    while len(u):
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))  # u and v are roots here
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        u, v = root[u], root[v]
        left = u != v
        u, v = u[left], v[left]
    return root


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column("hi").to_numpy(), b.column("lo").to_numpy()) for b in batches]
    if parts:
        ids, root = solve(*(np.concatenate(x) for x in zip(*parts)))
        for i in range(0, len(ids), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + (1 << 18)]), pa.array(root[i : i + (1 << 18)])], names=["id", "component"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every vertex that has an edge; component is the smallest id reachable."""
    c = F.col
    e = edges.select(c(a).cast("long").alias("a"), c(b).cast("long").alias("b"))
    e = e.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter(c("a").isNotNull() & c("b").isNotNull() & (c("hi") > c("lo")))
    e = written(e.distinct(), "edges")
    levels: list[DataFrame] = []
    while e.count() > FEW:
        first = lambda v: F.xxhash64(v, F.lit(len(levels)))  # noqa: B023, E731
        near = e.select(c("hi").alias("u"), c("lo").alias("v")).union(e.select(c("lo").alias("u"), c("hi").alias("v")))
        best = near.groupBy("u").agg(F.min_by("v", first("v")).alias("v"))
        level = written(best.select("u", F.when(first("v") < first("u"), c("v")).otherwise(c("u")).alias("f")), "contracted")
        new = e.join(level.select(c("u").alias("hi"), c("f").alias("fh")), "hi").join(level.select(c("u").alias("lo"), c("f").alias("fl")), "lo")
        new = new.select(F.greatest("fh", "fl").alias("hi"), F.least("fh", "fl").alias("lo")).filter("hi > lo").distinct()
        new = written(new, "edges")
        forget(e)
        e = new
        levels.append(level)
    found = written(e.coalesce(1).mapInArrow(_solved, "id bigint, component bigint"), "components")
    forget(e)
    if not levels:
        return found
    for level in reversed(levels):  # images without edges left are components of their own
        found = level.join(found.select(c("id").alias("f"), "component"), "f", "left").select(c("u").alias("id"), F.coalesce("component", "f").alias("component"))
    found = written(found, "components")
    least = found.groupBy("component").agg(F.min("id").alias("least"))
    return found.join(least, "component").select("id", c("least").alias("component"))
