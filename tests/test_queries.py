"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from ridgeway.registry import oracles, registered

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{small}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def plain(row):
    return tuple(None if x is None or (isinstance(x, float) and math.isnan(x)) else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in row)


def order(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


@pytest.mark.parametrize("name", sorted(oracles()))
def test_query_equals_sql(spark, small, duck, name):
    df = registered()[name](spark, small)
    cur = duck.execute(oracles()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    theirs = sorted((plain(r) for r in cur.fetchall()), key=order)
    ours = sorted((plain(r) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=order)
    assert ours == theirs


@pytest.mark.parametrize("name", ["trim_ends", "trim_intersections"])
def test_rows_only(spark, small, name):
    assert registered()[name](spark, small).count() > 0


def test_simplified_lines_keep_the_points_of_a_plain_version(spark, small):
    import hashlib

    from ridgeway.plans import fixtures as fx
    from tests.test_kernels import plain_simplify

    rows = {r.id: r for r in registered()["simplify_dp_kept"](spark, small).collect()}
    tracks = {r.id: [(p.x, p.y) for p in r.pts] for r in fx.track(spark, small).collect()}
    assert rows.keys() == tracks.keys() and any(2 < rows[i].n_points < len(p) for i, p in tracks.items())
    for i, pts in tracks.items():
        kept = plain_simplify(pts, 150.0)
        assert rows[i].n_points == len(kept)
        assert math.isclose(rows[i].length, sum(math.dist(a, b) for a, b in zip(kept, kept[1:])), abs_tol=1e-5)
        assert rows[i].digest == hashlib.md5(",".join(f"{x!r} {y!r}" for x, y in kept).encode()).hexdigest()
