import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeway.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, label int, score double, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, None, None, None) for i, v in rows], SCHEMA)


def brute(rows, step, k):
    fine = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in fine), default=0)
    fine = [(i, v + [0] * (width - len(v))) for i, v in fine]
    out = []
    for q, v in fine:
        if q % step == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def answer(spark, rows, step=5, **options):
    out = topk.top_k(topk.integer_vectors(table(spark, rows)), F.col("vec_id") % step == 0, **options)
    return sorted(tuple(r) for r in out.select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("strip,group,sample", [(16384, 16384, 2048), (16, 4, 20)])
def test_against_brute_force(spark, strip, group, sample):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(150)] + [(200 + i, [0.5] * 6) for i in range(70)]
    rows += [(500, None), (505, [0.1, None, 1.0]), (510, [float("nan")] * 6), (515, [float("inf")] * 6), (520, [1.0, 2.0]), (525, [])]
    assert answer(spark, rows, k=5, strip=strip, group=group, sample=sample) == brute(rows, 5, 5)


def test_few_rows_and_empty_tables(spark):
    assert answer(spark, []) == []
    assert answer(spark, [(5, [1.0, 0.0])]) == []
    assert answer(spark, [(5, [1.0]), (6, [2.0])]) == [(5, 1, 6, 256 * 512)]
    assert answer(spark, [(1, [1.0]), (2, [2.0])]) == []


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(1 << 20), float(i)] if i else [float(1 << 20), 3.0]) for i in range(30)]
    assert answer(spark, rows) == brute(rows, 5, 5)


def test_annuli_are_left_out_where_bounds_allow():
    rng = np.random.default_rng(2)
    near = np.concatenate([rng.integers(95, 105, (500, 3)), rng.integers(-105, -95, (500, 3))])
    ids = np.arange(1000)
    top = float((near * near).sum(1).max())
    pivots = topk.choose_pivots(near, 2, top)
    assert len(pivots) == 2 and len(topk.choose_pivots(np.ones((5, 3), int), 4, 3.0)) == 1
    lifted = topk._lift(near, top)
    d = topk._distances(lifted, pivots)
    home = d.argmin(1)
    assert set(np.bincount(home)) == {500}
    q = near[:1].astype(float)
    bound = np.sort(near @ near[0])[-6]
    gap = topk._distances(np.c_[q, [[0.0]]], pivots)[0]
    far = home[999]
    reach = d[home == far, far]
    lb = max(reach.min() - gap[far], gap[far] - reach.max(), 0)
    assert lb * lb > (q * q).sum() + top - 2 * bound  # the other pivot's vectors need no look
