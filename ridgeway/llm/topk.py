"""Exact top-k inner products by a pivot-distance index.

Vectors are lifted onto a sphere's radius, (v, sqrt(M^2 - |v|^2)) with M the largest norm, so that a larger inner
product with a query (q, 0) is exactly a smaller Euclidean distance. Every vector is keyed by its nearest pivot and
its distance to it. A strip holds the vectors of one pivot, sorted by distance; it is cut into annuli. A query starts
at its own distance and expands to annuli on either side; by the triangle inequality an annulus [lo, hi] of a pivot at
distance d from the query has nothing nearer than max(lo - d, d - hi), so expansion stops where that passes the
distance of the k-th best. A first pass over one strip, that of the query's nearest pivot, gives every query such a
bound; the second pass sends it to the other strips that the bound leaves open. In high dimensions with little
structure the bounds leave most annuli open; results are exact either way.

Strips have at most `strip` rows (a pivot with more is dealt over several by a hash of the id) and queries go in groups
of at most `group`, so no task depends on how often one vector occurs. Pivots come from a bounded sample: the
`sample` vectors with the smallest hash of their id; every vector is indexed.

Vectors that are null or hold a null or non-finite component take no part, neither do rows without an id; shorter
vectors count as filled up with zeros. Rows that repeat an id are candidates each; a query never meets rows of its
own id, and a query id that repeats is one query, with its least vector. Scores must fit a 64-bit integer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeway.session import written

STRIP, GROUP, ANNULUS, SAMPLE, MAX_PIVOTS = 16384, 16384, 512, 2048, 256
#: Rings of distance that the vectors of one pivot are cut into at most.
RINGS = 64
_BEST = "query_id bigint, vec_id bigint, score bigint"


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): components floor(scale * x) of the vectors that take part, filled up to one length."""
    fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(fine)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
    return rows


def _lift(v: np.ndarray, top: float) -> np.ndarray:
    v = v.astype(np.float64)
    return np.concatenate([v, np.sqrt(np.maximum(top - (v * v).sum(axis=1), 0))[:, None]], axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T), 0))


def choose_pivots(sample: np.ndarray, n: int, top: float) -> np.ndarray:
    """Farthest-first among the lifted sample; fewer if it has fewer distinct points."""
    lifted = _lift(sample, top)
    chosen = [0]
    far = _distances(lifted, lifted[:1])[:, 0]
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(lifted, lifted[chosen[-1:]])[:, 0])
    return lifted[chosen]


def _matrix(column, dim: int) -> np.ndarray:
    return np.stack([np.asarray(x, np.int64) for x in column]) if len(column) else np.zeros((0, dim), np.int64)


def _keyed(batches: Iterator[pa.RecordBatch], pivots, top: float, dim: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = batch.column("v").flatten().to_numpy().reshape(-1, dim)
        d = _distances(_lift(v, top), pivots)
        home = d.argmin(axis=1) if len(v) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("v"), pa.array(home.astype(np.int32)), pa.array(d[np.arange(len(v)), home])],
            names=["vec_id", "v", "pivot", "dist"],
        )


def _best(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each owner: by score, ties to the smaller id."""
    order = np.lexsort((ids, -score, owner))
    owner, score, ids = owner[order], score[order], ids[order]
    first = np.searchsorted(owner, owner)
    keep = np.arange(len(owner)) - first < k
    return owner[keep], score[keep], ids[keep]


def search(queries: np.ndarray, query_ids: np.ndarray, bound: np.ndarray, near: np.ndarray, vectors: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int, top: float, annulus: int = ANNULUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, score, id) of the k best in one strip among those that reach the bound.

    bound: a score that k others are known to reach, or -inf; near: distance from each query to the strip's pivot.
    """
    order = np.lexsort((ids, dist))
    vectors, ids, dist = vectors[order], ids[order], dist[order]
    largest = float(np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1).max(initial=0) * (vectors.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))
    kind = np.float64 if largest < 2.0**53 else object  # float64 sums of such products are exact; beyond, Python's integers
    q, v = queries.astype(kind), vectors.astype(kind)
    square = (queries.astype(np.float64) ** 2).sum(axis=1) + top
    slack = 1e-9 * square + 1e-6
    bound = bound.astype(np.float64).copy()
    starts = np.arange(0, len(ids), annulus)
    lo, hi = dist[starts], dist[np.minimum(starts + annulus, len(ids)) - 1]
    middle = np.median(near)
    found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    for a in np.argsort(np.maximum(np.maximum(lo - middle, middle - hi), 0), kind="stable"):
        gap = np.maximum(np.maximum(lo[a] - near, near - hi[a]), 0)
        live = np.flatnonzero(~(gap * gap > square - 2 * bound + slack))
        if not len(live):
            continue
        part = slice(starts[a], starts[a] + annulus)
        s = q[live] @ v[part].T
        other = query_ids[live][:, None] != ids[part][None, :]
        if kind is object:
            rows, cols = np.nonzero(other)
            scores = np.array([int(x) for x in s[rows, cols]], np.int64)
        else:
            s = np.where(other, s, -np.inf)
            least = bound[live]
            if s.shape[1] > k:
                least = np.maximum(least, np.partition(s, -k, axis=1)[:, -k])
            rows, cols = np.nonzero((s >= least[:, None]) & other)
            scores = s[rows, cols].astype(np.int64)
        found = _best(np.concatenate([found[0], live[rows]]), np.concatenate([found[1], scores]), np.concatenate([found[2], ids[part][cols]]), k)
        last = np.searchsorted(found[0], np.arange(len(queries)), side="right") - 1
        full = np.bincount(found[0], minlength=len(queries)) >= k
        bound[full] = np.maximum(bound[full], found[1][last[full]])
    return found


def _pass(k: int, top: float, pivots: np.ndarray, dim: int):
    def kernel(key: tuple, asked: pd.DataFrame, strip: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(strip):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        q = _matrix(asked["q"], dim)
        lifted = np.concatenate([q.astype(np.float64), np.zeros((len(q), 1))], axis=1)
        near = _distances(lifted, pivots[key[0] // RINGS : key[0] // RINGS + 1])[:, 0]
        ids = asked["query_id"].to_numpy()
        owner, score, got = search(q, ids, asked["bound"].to_numpy(), near, _matrix(strip["v"], dim), strip["vec_id"].to_numpy(), strip["dist"].to_numpy(), k, top)
        return pd.DataFrame({"query_id": ids[owner], "vec_id": got, "score": score})

    return kernel


def _celled(batches: Iterator[pa.RecordBatch], cuts: np.ndarray, parts: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Rows of the index with their cell, a ring of distances about a pivot, and the part of it that they are dealt to."""
    for batch in batches:
        pivot, dist, ids = (batch.column(n).to_numpy() for n in ("pivot", "dist", "vec_id"))
        cell = pivot.astype(np.int32) * RINGS + (dist[:, None] >= cuts[pivot]).sum(axis=1).astype(np.int32)
        mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        part = np.zeros(len(ids), np.int32) if parts is None else (mixed % parts[cell].astype(np.uint64)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(part, pa.int32())], names=[*batch.schema.names, "cell", "part"])


def _open(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, lo: np.ndarray, hi: np.ndarray, top: float, dim: int) -> Iterator[pa.RecordBatch]:
    """With each query, the cells whose vectors its bound leaves open."""
    used = np.flatnonzero(lo <= hi)
    for batch in batches:
        q = batch.column("q").flatten().to_numpy().reshape(-1, dim).astype(np.float64)
        near = _distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1), pivots)[:, used // RINGS]
        gap = np.maximum(np.maximum(lo[used] - near, near - hi[used]), 0)
        square = (q * q).sum(axis=1) + top
        limit = square - 2 * batch.column("bound").to_numpy() + 1e-9 * square + 1e-6
        left = [used[row].astype(np.int32) for row in gap * gap <= limit[:, None]]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(left, pa.list_(pa.int32()))], names=[*batch.schema.names, "open"])


def _ranked(best: DataFrame, k: int) -> DataFrame:
    """The k best of each query; each task keeps its own k best before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, strip: int = STRIP, group: int = GROUP, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of (vec_id, v) that is_query marks, against all others."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    sizes = vectors.agg(
        F.count(F.lit(1)), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), F.count(F.when(is_query, 1))
    ).first()
    n, dim, top, asked = sizes
    if not n or not asked:
        return empty
    dim, top = max(dim, 1), float(top or 0)
    filled = vectors.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), (F.lit(dim) - F.size("v")).cast("int"))))
    drawn = filled.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).select("v").collect()
    pivots = choose_pivots(_matrix([r.v for r in drawn], dim), min(MAX_PIVOTS, max(8, -(-n // strip))), top)
    index = filled.mapInArrow(lambda it: _keyed(it, pivots, top, dim), "vec_id bigint, v array<bigint>, pivot int, dist double")
    index = written(index, "pivots")
    # At most MAX_PIVOTS rows of RINGS numbers, then a row for each cell.
    shares = [i / RINGS for i in range(1, RINGS)]
    cuts, cells = np.full((len(pivots), RINGS - 1), np.inf), len(pivots) * RINGS
    for r in index.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("dist", shares, 1000).alias("at")).collect():
        rings = min(RINGS, -(-r.n // strip))
        cuts[r.pivot, : rings - 1] = [r["at"][round(RINGS * i / rings) - 1] for i in range(1, rings)]
    fields = "vec_id bigint, v array<bigint>, pivot int, dist double, cell int, part int"
    lo, hi, parts = np.full(cells, np.inf), np.full(cells, -np.inf), np.ones(cells, np.int64)
    sizes = index.mapInArrow(lambda it: _celled(it, cuts, None), fields).groupBy("cell")
    for r in sizes.agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).collect():
        lo[r.cell], hi[r.cell], parts[r.cell] = r.lo, r.hi, -(-r.n // strip)
    groups = -(-asked // group)
    dealt = index.mapInArrow(lambda it: _celled(it, cuts, parts), fields)
    strips = dealt.withColumn("qg", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    queries = dealt.filter(is_query).groupBy("vec_id").agg(F.min_by(F.struct("v", "cell", "part"), "v").alias("x"))
    queries = queries.select(F.col("vec_id").alias("query_id"), F.col("x.v").alias("q"), F.col("x.cell").alias("home"), F.col("x.part").alias("own"))
    queries = queries.withColumn("qg", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(groups)).cast("int"))

    kernel = _pass(k, top, pivots, dim)
    keys = ["cell", "part", "qg"]
    seed = queries.select("query_id", "q", "qg", F.col("home").alias("cell"), F.col("own").alias("part"), F.lit(float("-inf")).alias("bound"))
    first = written(seed.groupBy(*keys).cogroup(strips.groupBy(*keys)).applyInPandas(kernel, _BEST), "seeds")
    known = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    known = known.select("query_id", F.when(F.col("n") >= k, F.col("least").cast("double")).otherwise(float("-inf")).alias("bound"))
    bounded = queries.join(known, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    fields = "query_id bigint, q array<bigint>, home int, qg int, own int, bound double"
    names = [x.split()[0] for x in fields.split(", ")]
    rest = bounded.select(*names).mapInArrow(lambda it: _open(it, pivots, lo, hi, top, dim), f"{fields}, open array<int>")
    rest = rest.withColumn("cell", F.explode("open"))
    many = [(int(c), int(parts[c])) for c in np.flatnonzero(parts > 1)]  # cells too full for one task
    if many:
        full = spark.createDataFrame(many, "cell int, parts int")
        rest = rest.join(F.broadcast(full), "cell", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    else:
        rest = rest.withColumn("part", F.lit(0))
    rest = rest.filter("NOT (cell = home AND part = own)").select("query_id", "q", "qg", "bound", "cell", "part")
    second = rest.groupBy(*keys).cogroup(strips.groupBy(*keys)).applyInPandas(kernel, _BEST)
    ranked = _ranked(first.unionByName(second), k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(256 AS DOUBLE) * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
