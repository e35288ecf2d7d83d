"""Variable-capacity best-fit packing of token sequences.

Items are taken longest first. Each goes into the open bin that it fills best; if none has room, a bin is opened at
the permitted length whose expected cost a token is least, given what is still to be placed. At the end every bin
shrinks to the least permitted length that holds its contents. A length's cost is linear in its tokens plus a
quadratic part for attention plus a fixed part for each sequence, so several lengths pay off together.

Items are dealt over shards of about `shard` items by a hash of id and piece. Tasks take ranges of shards and pack one
after another, so memory is bounded whatever the corpus. An item longer than the largest length is cut into pieces of that length and a
rest. Items of length 0 or null length get a row without a bin. Rows without an id are packed like others; ties are
broken by id and piece, so results depend on the rows only, not on their order.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeway.llm import bpe
from ridgeway.session import written

CAPACITIES, SHARD, OVERHEAD, ATTENTION = (256, 512, 1024, 2048, 4096), 16384, 16.0, 16384.0


def cost(capacity: int, overhead: float = OVERHEAD, attention: float = ATTENTION) -> float:
    """Of one sequence of this length: fixed part, tokens, and attention."""
    return overhead + capacity + capacity * capacity / attention


def pack(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset in it, its length) of items given longest first; none may exceed the largest capacity."""
    capacities = tuple(sorted(capacities))
    lengths = np.asarray(lengths, np.int64)
    left = np.bincount(lengths, weights=lengths, minlength=capacities[-1] + 1)  # tokens still to place, by length
    rooms: list[int] = []  # distinct rooms of open bins, ascending
    by_room: dict[int, list[int]] = {}
    used, size = [], []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    # What fits into a rest, by its size; renewed now and then, as an estimate needs no more.
    fits, renew = np.cumsum(left), 0
    for i, n in enumerate(lengths.tolist()):
        left[n] -= n
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                del by_room[room], rooms[at]
        else:
            if renew == 0:
                fits, renew = np.cumsum(left), 64
            renew -= 1
            room = min(
                (c for c in capacities if c >= n),
                key=lambda c: (cost(c) / (n + min(c - n, fits[c - n] if c > n else 0)), c),
            )
            b = len(used)
            used.append(0)
            size.append(room)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        room -= n
        if room:
            if room not in by_room:
                insort(rooms, room)
                by_room[room] = []
            by_room[room].append(b)
    least = np.asarray(capacities)[np.searchsorted(capacities, used)] if used else np.zeros(0, np.int64)
    return bins, offsets, least[bins] if len(bins) else np.zeros(0, np.int64)


def word_tokens(text: Column | str) -> Column:
    """Words between white space, and one mark for the end of the document; whole texts."""
    words = F.regexp_count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return (words + 1).cast("long")


def token_lengths(df: DataFrame, vocab, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n): byte-level BPE tokens of each whole text and one mark for its end, as a table, so that texts are encoded once."""
    return written(bpe.token_counts(df, vocab, id_col, text_col).select("doc_id", (F.col("n_tokens") + 1).alias("n")), "token-lengths")


_ROWS = "doc_id bigint, piece bigint, start bigint, length bigint, bin bigint, offset bigint, capacity bigint"


def _packed(batches: Iterator[pa.RecordBatch], capacities: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Packs rows that come by shard and, in it, longest first; one shard is held at a time."""

    def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        bins, offsets, capacity = pack(table.column("length").to_numpy(), capacities)
        columns = [table.column(c).combine_chunks() for c in ("doc_id", "piece", "start", "length")]
        columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
        return pa.RecordBatch.from_arrays([*columns, pa.array((int(table.column("shard")[0].as_py()) << 32) + bins), pa.array(offsets), pa.array(capacity)], names=[x.split()[0] for x in _ROWS.split(", ")])

    held, shard = [], None
    for batch in batches:
        of = batch.column("shard").to_numpy()
        edges = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if held and of[a] != shard:
                yield done(held)
                held = []
            shard = of[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield done(held)


def best_fit(df: DataFrame, length: Column, id_col: str = "doc_id", capacities: tuple[int, ...] = CAPACITIES, shard: int = SHARD) -> DataFrame:
    """(doc_id, piece, start, length, bin, offset, capacity), a row for each piece of each row of df; ids are integers."""
    most = max(capacities)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(length.cast("long"), F.lit(0)).alias("n"))
    pieces = F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / most).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    items = rows.select("doc_id", "n", F.explode(pieces).alias("piece")).select(
        "doc_id", "piece", (F.col("piece") * most).alias("start"), F.greatest(F.lit(0), F.least(F.lit(most), F.col("n") - F.col("piece") * most)).alias("length")
    )
    total = items.filter("length > 0").count()
    shards = max(1, -(-total // shard))
    dealt = items.filter("length > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))
    # Shards are few and even, so ranges of them are; their hashes would fall together in some partitions.
    dealt = dealt.repartitionByRange(shards, "shard").sortWithinPartitions("shard", F.desc("length"), "doc_id", "piece", "start")
    packed = dealt.mapInArrow(lambda it: _packed(it, tuple(capacities)), _ROWS)
    empty = items.filter("length = 0").select("doc_id", "piece", "start", "length", *[F.lit(None).cast("long").alias(c) for c in ("bin", "offset", "capacity")])
    return packed.unionByName(empty)
