import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from ridgeway.llm import exact_dedup, near_dedup
from tests.llm.helpers import frame, got, odd_rows, text, words


def brute_exact(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    keep, size = {}, {}
    for i, t in norm:
        keep[t] = min(keep.get(t, i), i)
        size[t] = size.get(t, 0) + 1
    return sorted((i, keep[t], size[t], i == keep[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in norm)


def test_exact_groups(spark):
    rows = odd_rows() + [(40 + i, "copy of a  text") for i in range(30)] + [(99, "copy of a text "), (40, "copy of a  text")]
    for fn in (exact_dedup.hash128, lambda c: F.unhex(F.lpad(F.hex(F.length(c) % 3), 32, "0"))):  # the second collides all the time
        out = exact_dedup.exact_groups(frame(spark, rows), content_hash=fn)
        assert sorted(tuple(r) for r in out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == brute_exact(rows)
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0


def test_exact_dedup_keeps_columns(spark):
    rows = [(3, "a b"), (1, "a\tb"), (2, None), (5, ""), (9, "c"), (9, "c")]
    df = frame(spark, rows)
    out = exact_dedup.exact_dedup(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, "a\tb"), (2, None), (9, "c")]


def shingles(t, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    k = min(n, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute_near(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in ids)


def edited(w, at):
    return [("zz%d" % i if i in at else x) for i, x in enumerate(w)]


def near_rows():
    base = words(200, 1)
    rows = [(1000 + i, " ".join(edited(base, {i}))) for i in range(60)]  # a group where most are near each other
    chain = words(120, 2)
    for i in range(12):  # each near the one before, the ends far apart
        chain = edited(chain, {9 * i})
        rows.append((2000 - i, " ".join(chain)))
    shared = text(60, 3)
    rows += [(3000 + i, shared + " " + text(140, 50 + i)) for i in range(25)]  # one passage in common
    rows += [(4000, "a b c d"), (4001, "A b C d"), (4002, "a b c"), (4003, "x y z v w"), (4004, "x y z v w u")]
    return rows


def test_near_groups_against_brute_force(spark):
    rows = near_rows() + odd_rows()
    want = brute_near(rows)
    for block in (512, 8):
        out = near_dedup.near_groups(frame(spark, rows), block=block, family=2 * block)
        assert sorted(tuple(r) for r in out.select("doc_id", "n_shingles", "component_id", "kept").collect()) == want, block


def test_near_dedup_of_odd_tables(spark):
    assert near_dedup.near_groups(frame(spark, [])).count() == 0
    assert near_dedup.near_groups(frame(spark, [(1, None), (2, "")])).filter("kept").count() == 2
    df = frame(spark, [(1, "same words here again today"), (2, "Same words  here again today"), (None, "same words here again today"), (3, None)])
    out = near_dedup.near_dedup(df)
    assert out.columns == df.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 1), (False, 3), (True, 0)]
    twice = near_dedup.near_groups(frame(spark, [(7, text(50, 1)), (7, text(50, 1))])).collect()
    assert [(r.doc_id, r.component_id) for r in twice] == [(7, 7)] * 2


def test_overlaps_and_forest():
    import numpy as np

    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(0, 6000))).astype(np.uint64) for _ in range(12)]
    both = near_dedup.overlaps(sets[:7], sets[7:])
    assert both.tolist() == [[len(np.intersect1d(a, b)) for b in sets[7:]] for a in sets[:7]]


def test_links_are_exact():
    import numpy as np

    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 200))).astype(np.uint64) for _ in range(60)]
    for x in sets:
        for y in sets:
            both, union = len(set(x.tolist()) & set(y.tolist())), len(set(x.tolist()) | set(y.tolist()))
            assert near_dedup.linked(x, y) == (100 * both >= 75 * union)


def test_unrelated_documents_of_common_shingles_stay_linear(spark):
    """Documents that share most shingles with someone, but none with most of its own: no posting expands into all pairs."""
    import random

    rng, n = random.Random(3), 600
    pool = [" ".join(words(5, 7000 + i)) for i in range(4000)]
    own = [" ".join(words(5, 20000 + i)) for i in range(n * 36)]
    rows = [(i, " ".join(rng.sample(pool, 84) + own[36 * i : 36 * i + 36])) for i in range(n)]
    rows += [(n + i, t + " one two") for i, (_, t) in enumerate(rows[:20])]
    df = frame(spark, rows)
    seen = []
    was = near_dedup._links

    def counting(pairs, *rest):
        seen.append(pairs.count())
        return was(pairs, *rest)

    near_dedup._links = counting
    try:
        out = got(near_dedup.near_groups(df))
    finally:
        near_dedup._links = was
    assert {i: r["component_id"] for i, r in out.items()} == {i: i - n if i >= n else i for i, _ in rows}
    assert sum(seen) < 64 * n


def test_a_lone_pair_at_the_threshold_is_linked(spark):
    """48 of 64 shingles in common, and as few as 34 of 64 coordinates."""
    w = [f"w5332x{i}" for i in range(60)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:52] + [f"v5332x{i}" for i in range(8)]))]
    f = near_dedup._multipliers(64)
    a, b = (near_dedup.shingle_set(t) for _, t in rows)
    assert (near_dedup.signature(a, f) == near_dedup.signature(b, f)).sum() == 34 and len(np.intersect1d(a, b)) == 48
    assert {i: r["component_id"] for i, r in got(near_dedup.near_groups(frame(spark, rows))).items()} == {1: 1, 2: 1}


def test_exact_dedup_does_not_depend_on_the_order_of_rows(spark):
    import itertools

    rows = [(1, "a  b", "y"), (1, "a b", "x"), (1, "a\tb", None), (2, "a b", "a"), (None, "a b", "a")]
    found = set()
    for some in itertools.islice(itertools.permutations(rows), 0, 120, 17):
        df = spark.createDataFrame([(i, t, s, {"k": 1}) for i, t, s in some], "doc_id bigint, text string, source string, extra map<string,int>").repartition(2)
        out = exact_dedup.exact_dedup(df)
        assert out.columns == df.columns
        found |= {tuple(r)[:3] for r in out.collect()}
    assert found == {(1, "a\tb", None)}
