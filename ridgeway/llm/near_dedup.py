"""MinHash near-dedup by a signature-coordinate inverted join, confirmed on full shingle sets.

1. Every whole text becomes its set of five-word shingles and a signature of `k` MinHash coordinates. Texts with the
   same set form a class and go on as its smallest id.
2. Classes are posted under each coordinate-value pair. A pair of classes must agree on `t` of `k` coordinates, so a
   class that shares fewer than `t` of its values with anyone is done (skipped), and of the n it shares, the n - t + 1
   rarest (its prefix) must hold a value of every partner. Only prefixes are merged.
3. In each posting the class that shares the most values with anyone, in a group of copies the text that they were
   made from, is held against the others; collisions of the pairs' signatures are counted and pairs at or above the
   match threshold are confirmed on the full sets, exactly. These links give components.
4. Then pairs of different components within a posting are treated alike, so a group of copies never expands into all
   its pairs. Postings of more than `block` classes of several components are copies of copies, alike but not linked as
   yet, or hold a value that many classes share by chance. Their classes form families, compared in blocks of bounded
   size, those between members of a family's main component left out; a task returns only the links that join what it
   had not joined yet. Only this step can grow with the square of a family, and none arises from smaller postings.

Links: 100 * intersection >= 75 * union of the sets. With the defaults, a pair at a similarity of exactly 0.75 agrees
on fewer than 30 of 64 coordinates with a chance of 4 in 10 million; the greater the similarity, the less.

Texts with fewer than five words are one shingle; empty and null texts have none and are linked with nothing. Rows that
repeat an id belong to one document. Rows without an id are linked with nothing. Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeway.llm.common import maybe_in, released, texts
from ridgeway.operators.components import connected_components
from ridgeway.session import forget, written

WORDS, K, T, LINK = 5, 64, 30, 75
#: Classes of a posting that are compared pair by pair at most; classes and shingles of a family's block at most, about.
BLOCK, FAMILY, FAMILY_SHINGLES = 64, 512, 3_000_000
_SPREAD, _FOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_S32, _S29 = np.uint64(32), np.uint64(29)
_KEPT = 100_000


class _Hashes(dict):
    """64-bit hashes of words, made when first met."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _S32)
    x *= _FOLD
    return x ^ (x >> _S32)


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles: A-Z lower-cased, split at space and U+0009 to U+000D."""
    split = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only ASCII letters and white space count
    if not split:
        return np.zeros(0, np.uint64)
    if len(_hashes) > _KEPT:
        _hashes.clear()
    h = np.fromiter(map(_hashes.__getitem__, split), np.uint64, len(split))
    n = min(words, len(h))
    end = len(h) - n + 1
    out = np.full(end, n, np.uint64)
    for i in range(n):
        out = _mixed(out * _SPREAD + h[i : i + end])
    out.sort()
    keep = np.ones(end, bool)
    np.not_equal(out[1:], out[:-1], out=keep[1:])
    return out[keep]


def _multipliers(k: int) -> np.ndarray:
    return np.random.default_rng(20240607).integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least of each coordinate's hashes, made distinct between coordinates."""
    least = None
    for at in range(0, len(shingles), 1024):
        x = shingles[at : at + 1024, None] * factors[None, :]
        x ^= x >> _S29
        x = x.min(axis=0)
        least = x if least is None else np.minimum(least, x)
    return least + np.arange(len(factors), dtype=np.uint64) * _SPREAD


def _sketch(batches: Iterator[pa.RecordBatch], words: int, k: int) -> Iterator[pa.RecordBatch]:
    import xxhash

    factors = _multipliers(k)
    for batch in batches:
        sizes, digests, signatures, folded = [], [], [], []
        for text in batch.column("text"):
            s = shingle_set(text.as_py(), words)
            sizes.append(len(s))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()))
            sig = signature(s, factors) if len(s) else None
            signatures.append(None if sig is None else sig.view(np.int64))
            folded.append(None if sig is None else (sig >> _S32).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.list_(pa.int64())), pa.array(folded, pa.binary())],
            names=["doc_id", "n_shingles", "digest", "sig", "folded"],
        )


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(x, words).tobytes() for x in batch.column("text").to_pylist()]
        at = batch.schema.get_field_index("text")
        columns, names = list(batch.columns), list(batch.schema.names)
        columns[at], names[at] = pa.array(sets, pa.binary()), "shingles"
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _agreeing(batches: Iterator[pa.RecordBatch], t: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures, a byte a coordinate, agree on at least t: all that do in full, and by chance a few more."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for n in ("fa", "fb"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= t))


def linked(a: np.ndarray, b: np.ndarray, link: int = LINK) -> bool:
    """Whether 100 times the intersection of two sorted sets is at least `link` times their union."""
    least, most = sorted((len(a), len(b)))
    if 100 * least < link * most:
        return False
    if len(b) < len(a):
        a, b = b, a
    if not len(a):
        return False
    both = np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a)
    return 100 * both >= link * (least + most - both)


def _confirmed(batches: Iterator[pa.RecordBatch], link: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = ((np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(batch.column("sa"), batch.column("sb")))
        yield batch.select(["a", "b"]).filter(pa.array([linked(x, y, link) for x, y in sets], pa.bool_()))


def _links(pairs: DataFrame, reps: DataFrame, rows: DataFrame, words: int, t: int, link: int) -> DataFrame:
    """Those of the distinct pairs (a, b) of classes that are linked. Texts are shingled again only where signatures agree."""
    ends = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep")))
    folded = maybe_in(reps.select("rep", "folded"), "rep", ends)
    both = pairs.join(folded.toDF("a", "fa"), "a").join(folded.toDF("b", "fb"), "b").select("a", "b", "fa", "fb")
    near = written(both.mapInArrow(lambda it: _agreeing(it, t), "a bigint, b bigint").distinct(), "near")
    needed = near.select(F.col("a").alias("rep")).union(near.select(F.col("b").alias("rep"))).distinct()
    # Only texts that may be asked for are dealt out.
    asked = maybe_in(rows.select(F.col("doc_id").alias("rep"), "text"), "rep", needed).join(needed, "rep")
    sets = written(asked.mapInArrow(lambda it: released(_sets(it, words)), "rep bigint, shingles binary"), "sets")
    full = near.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    out = written(full.mapInArrow(lambda it: released(_confirmed(it, link)), "a bigint, b bigint"), "links")
    forget(near)
    forget(sets)
    return out


def _postings(reps: DataFrame, t: int) -> DataFrame:
    """(key, rep, n): the prefix of each class that holds t shared values or more, posted; n is how many it holds."""
    posts = reps.select("rep", F.explode("sig").alias("v"))
    often = posts.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = posts.join(often.hint("shuffle_hash"), "v")
    each = shared.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("held")).filter(F.size("held") >= t)
    prefix = each.select("rep", F.size("held").alias("n"), F.explode(F.slice("held.v", F.lit(1), F.size("held") - t + 1)).alias("key"))
    return prefix.select("key", "rep", "n")


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b; only shingles that occur twice are looked at."""
    flat = np.concatenate([*a, *b]) if a or b else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in [*a, *b]])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    often = count[column] > 1
    owner, column = owner[often], column[often]
    column = np.unique(column, return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(a), len(b)), np.float64)
    width = 4096
    for start in range(0, int(column[-1]) + 1 if column.size else 0, width):
        lo, hi = np.searchsorted(column, [start, start + width])
        m = np.zeros((len(a) + len(b), width), np.float32)
        m[owner[lo:hi], column[lo:hi] - start] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out.astype(np.int64)


def forest(ids_a, sets_a, sigs_a, groups_a, ids_b, sets_b, sigs_b, groups_b, t: int, link: int) -> list[tuple[int, int]]:
    """Links between a and b that join groups not joined before; enough for the components, never all pairs."""
    matches = np.zeros((len(ids_a), len(ids_b)), np.uint8)
    for i in range(sigs_a.shape[1]):
        matches += sigs_a[:, i][:, None] == sigs_b[:, i][None, :]
    near = (matches >= t) & (groups_a[:, None] != groups_b[None, :])
    rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    if not len(rows):
        return []
    sizes_a, sizes_b = np.array([len(sets_a[i]) for i in rows]), np.array([len(sets_b[j]) for j in cols])
    both = overlaps([sets_a[i] for i in rows], [sets_b[j] for j in cols])
    union = sizes_a[:, None] + sizes_b[None, :] - both
    linked = near[np.ix_(rows, cols)] & (100 * both >= link * union)
    parent: dict = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    out = []
    for i, j in zip(*np.nonzero(linked)):
        i, j = rows[i], cols[j]
        x, y = root(groups_a[i].item()), root(groups_b[j].item())
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((ids_a[i], ids_b[j]))
    return out


def _blocks(t: int, link: int):
    def kernel(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        i, j = key[1], key[2]
        frame = frame.sort_values("rep").reset_index(drop=True)

        def side(block):
            part = frame[frame["block"] == block]
            sigs = np.stack([np.asarray(x, np.int64) for x in part["sig"]]) if len(part) else np.zeros((0, 1), np.int64)
            return part["rep"].to_numpy(), [np.frombuffer(x, np.uint64) for x in part["shingles"]], sigs, part["component"].to_numpy()

        a = side(i)
        b = a if i == j else side(j)
        found = forest(*a, *b, t, link) if len(a[0]) and len(b[0]) else []
        return pd.DataFrame({"a": np.array([x for x, _ in found], np.int64), "b": np.array([y for _, y in found], np.int64)})

    return kernel


def _across(postings: DataFrame, found: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(a, b): pairs of classes of different components that share a small posting; (rep, family, component) of classes in full ones."""
    now = postings.join(found.toDF("rep", "component"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    counts = now.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
    mixed = written(now.join(counts.select("key", (F.col("n") > block).alias("full")).hint("shuffle_hash"), "key"), "mixed")
    some, full = mixed.filter("NOT full").select("key", "rep", "component"), mixed.filter("full")
    pairs = some.alias("x").join(some.alias("y"), "key").filter("x.rep < y.rep AND x.component <> y.component")
    # Classes of one component are in one family whatever they share, so an edge for each component of a posting is enough.
    delegates = full.groupBy("key", "component").agg(F.min("rep").alias("rep"))
    lead = delegates.groupBy("key").agg(F.min("component").alias("lead"))
    families = connected_components(delegates.join(lead, "key").select(F.col("lead").alias("a"), F.col("component").alias("b")).distinct())
    members = full.select("rep", "component").distinct().join(families.toDF("component", "family"), "component")
    return pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct(), written(members.select("rep", "family", "component"), "families")


def _family_links(members: DataFrame, reps: DataFrame, rows: DataFrame, words: int, t: int, link: int, size: int, shingles: int) -> DataFrame:
    """(a, b): links enough for the components within each family."""
    parts = members.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("family").agg(F.max_by("component", "n").alias("main"))
    placed = members.join(parts, "family").withColumn("own", F.col("component") == F.col("main"))
    placed = placed.join(maybe_in(reps.select("rep", "n_shingles", "sig"), "rep", members.select("rep")), "rep")
    room = placed.groupBy("family", "own").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / (0.9 * size)), F.ceil(F.sum("n_shingles") / shingles)).cast("int").alias("blocks"))
    # Blocks of the main component are numbered below zero and never meet each other.
    number = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    placed = placed.join(room, ["family", "own"]).withColumn("block", F.when(F.col("own"), -1 - number).otherwise(number))
    spans = room.groupBy("family").agg(F.max(F.when(F.col("own"), F.col("blocks"))).alias("mine"), F.max(F.when(~F.col("own"), F.col("blocks"))).alias("others"))
    placed = written(placed.join(spans, "family").drop("blocks", "n_shingles", "main", "own"), "placed")
    # A block of others meets all blocks; one of the main component meets those of others.
    meets = F.when(F.col("block") < 0, F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(-F.col("mine"), F.col("others") - 1))
    needed = placed.select("rep").distinct()
    asked = maybe_in(rows.select(F.col("doc_id").alias("rep"), "text"), "rep", needed).join(needed, "rep")
    sets = written(asked.mapInArrow(lambda it: released(_sets(it, words)), "rep bigint, shingles binary"), "sets")
    tasks = placed.join(sets, "rep").select("*", F.explode(meets).alias("other"))
    tasks = tasks.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "component", "sig", "shingles")
    return written(tasks.groupBy("family", "i", "j").applyInPandas(_blocks(t, link), "a bigint, b bigint"), "links")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, k: int = K, t: int = T, link: int = LINK, block: int = BLOCK, family: int = FAMILY, family_shingles: int = FAMILY_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of df. Ids are integers.

    block: the classes of a posting that are compared pair by pair at most; family: those of a block of a family.
    """
    rows = texts(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    sketch = written(rows.mapInArrow(lambda it: released(_sketch(it, words, k)), "doc_id bigint, n_shingles bigint, digest binary, sig array<bigint>, folded binary"), "sketch")
    some = sketch.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest")
    reps = written(some.agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("folded").alias("folded")), "classes")

    prefix = written(_postings(reps, t), "prefix")
    most = F.col("n").cast("long") * (1 << 20) + F.pmod(F.xxhash64("rep"), F.lit(1 << 20))  # the hash breaks ties
    first = prefix.groupBy("key").agg(F.max_by("rep", most).alias("lead"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("key", "lead")
    star = prefix.join(first.hint("shuffle_hash"), "key").filter("rep <> lead").select(F.least("lead", "rep").alias("a"), F.greatest("lead", "rep").alias("b"))
    star = written(star.distinct(), "pairs")
    links = _links(star, reps, rows, words, t, link)
    found = written(connected_components(links), "components")
    more, members = _across(prefix, found, block)
    more = written(more.join(star, ["a", "b"], "left_anti"), "pairs")
    late = []
    if more.limit(1).count():
        late.append(_links(more, reps, rows, words, t, link))
    if members.limit(1).count():
        late.append(_family_links(members, reps, rows, words, t, link, family, family_shingles))
    if late:
        for some_links in late:
            links = links.union(some_links.select("a", "b"))
        forget(found)
        found = written(connected_components(links), "components")
    for done in (prefix, star, more, members):
        forget(done)

    classes = reps.select("digest", "rep").join(found.toDF("rep", "component"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("group"))
    joined = sketch.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("group")).otherwise(F.col("doc_id"))
    out = joined.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df with one row of each group of near copies, that of the smallest id. Rows without an id stay."""
    gone = near_groups(df, id_col, text_col, **options).filter("NOT kept").select(F.col("doc_id").alias("__gone"))
    return df.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
