"""Byte-level BPE encoding and decoding by overlapping chunks.

A text longer than `chunk` characters is cut into chunks that overlap by `overlap`. Every chunk is pre-tokenised on
its own, in parallel. Matching always goes on from the end of the last match and never looks back, so once two
neighbours agree on one boundary inside their overlap they agree on all later ones: the text is cut there, and the
pieces between cuts are encoded in parallel. A boundary near the end of a chunk isn't trusted, as the missing text
could have made its match longer, and no cut follows white space, whose matches look ahead. Where neighbours never agree (a run of one kind of character longer than the
overlap), the cut is left out and the piece just gets longer; results stay exact.

Ids are those of the tiktoken library for the same ranks and pattern; decoding concatenates the raw bytes of ids.
A null text is empty; empty texts have no ids. Repeated rows give repeated results. Only the id and text are read.
The vocabulary file's bytes reach executors as a broadcast of fixed size (under 1 MB for 50,000 ranks).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeway.llm.common import released, texts

#: The pattern that splits text before the merges of public byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters at the end of a chunk in which no boundary is trusted: the longest look-ahead of the pattern and more.
MARGIN = 8

_codecs: dict[str, "Codec"] = {}
_pattern: dict[str, object] = {}


class Codec:
    """Ranks and pattern as an encoder; one of each vocabulary lives in a worker."""

    def __init__(self, data: bytes, pattern: str = PATTERN):
        import tiktoken

        ranks = {}
        for line in data.splitlines():
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {rank: token for token, rank in ranks.items()}

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self.core.encode_ordinary(text), dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    @staticmethod
    def of(data: bytes, pattern: str = PATTERN) -> "Codec":
        key = hashlib.md5(data + pattern.encode()).hexdigest()
        if key not in _codecs:
            _codecs[key] = Codec(data, pattern)
        return _codecs[key]


def vocabulary(spark: SparkSession, path: str):
    """A rank file, read on the driver and broadcast: its size is fixed, whatever the corpus."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def vocabulary_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    """The file of a public tokenizer; see its package for the names."""
    import public_tokenizers

    return public_tokenizers.path(name)


def boundaries(text: str, pattern: str = PATTERN) -> list[int]:
    """Starts of the pre-tokens of a text taken on its own."""
    import regex

    if pattern not in _pattern:  # white space by its Unicode property, as the encoder has it
        _pattern[pattern] = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
    return [m.start() for m in _pattern[pattern].finditer(text)]


def _chunked(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """(key, k, part, last): the overlapping chunks of texts, each cut once from the text in memory."""
    for batch in batches:
        for i in range(batch.num_rows):
            key, text = batch.column("key").slice(i, 1), batch.column("text")[i].as_py()
            parts = [text[at : at + chunk + overlap] for at in range(0, len(text), chunk)]
            for at in range(0, len(parts), 64):
                some = parts[at : at + 64]
                last = [(at + j) * chunk + chunk + overlap >= len(text) for j in range(len(some))]
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([key] * len(some)), pa.array(range(at, at + len(some)), pa.int64()), pa.array(some, pa.string()), pa.array(last)],
                    names=["key", "k", "part", "last"],
                )


def _cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, start, part): texts cut at the given places."""
    for batch in batches:
        for i in range(batch.num_rows):
            key, text = batch.column("key").slice(i, 1), batch.column("text")[i].as_py()
            at = [0, *(batch.column("cuts")[i].as_py() or []), len(text)]
            for j in range(0, len(at) - 1, 64):
                some = at[j : j + 65]
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([key] * (len(some) - 1)), pa.array(some[:-1], pa.int64()), pa.array([text[x:y] for x, y in zip(some, some[1:])], pa.string())],
                    names=["key", "start", "part"],
                )


def _edges(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int, pattern: str) -> Iterator[pa.RecordBatch]:
    """For each chunk: the boundaries in its first `overlap` characters, and the trusted ones in its last."""
    for batch in batches:
        heads, tails = [], []
        for k, text, last in zip(batch.column("k").to_pylist(), batch.column("part").to_pylist(), batch.column("last").to_pylist()):
            at = np.asarray(boundaries(text, pattern), dtype="<i8")
            end = len(text) if last else len(text) - MARGIN
            heads.append((at[(at < overlap) & (at <= end)] + k * chunk).tobytes())
            # A cut ends a piece: white space before it would no longer see what follows, so a cut never follows any.
            late = [x for x in at[(at >= chunk) & (at <= end)].tolist() if not text[x - 1].isspace()]
            tails.append((np.asarray(late, "<i8") + k * chunk).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("k"), pa.array(heads, pa.binary()), pa.array(tails, pa.binary())],
            names=["key", "k", "head", "tail"],
        )


def first_common(tail: bytes | None, head: bytes | None) -> int | None:
    """The first boundary that the tail of a chunk and the head of the next share."""
    if not tail or not head:
        return None
    both = np.intersect1d(np.frombuffer(tail, "<i8"), np.frombuffer(head, "<i8"), assume_unique=True)
    return int(both[0]) if both.size else None


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = [first_common(a, b) for a, b in zip(batch.column("tail").to_pylist(), batch.column("head").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(at, pa.int64())], names=["key", "cut"])


def _encode(batches: Iterator[pa.RecordBatch], vocab, pattern: str) -> Iterator[pa.RecordBatch]:
    codec = Codec.of(vocab.value, pattern)
    for batch in batches:
        ids = [codec.encode(x).tobytes() for x in batch.column("part").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.binary())], names=[*batch.schema.names[:-1], "ids"])


def _report(batches: Iterator[pa.RecordBatch], vocab, pattern: str) -> Iterator[pa.RecordBatch]:
    """Encode, then decode what was encoded, keeping digests only: ids of short texts never leave the worker."""
    codec = Codec.of(vocab.value, pattern)
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            ids = codec.encode(text.as_py())
            rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()))
        n, a, b = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def _decode(batches: Iterator[pa.RecordBatch], vocab, pattern: str) -> Iterator[pa.RecordBatch]:
    codec = Codec.of(vocab.value, pattern)
    at = None
    for batch in batches:
        at = batch.schema.get_field_index("ids")
        out = [None if x is None else codec.decode(np.frombuffer(x, "<u4")) for x in batch.column(at).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])


def pieces(long_texts: DataFrame, chunk: int, overlap: int, pattern: str = PATTERN) -> DataFrame:
    """(key, start, part): the long texts cut at resynchronised boundaries. Rows that repeat give the same pieces."""
    keyed = long_texts.select(F.struct("doc_id", F.md5("text").alias("h")).alias("key"), "text")
    kind = keyed.schema["key"].dataType.simpleString()
    parts = keyed.mapInArrow(lambda it: released(_chunked(it, chunk, overlap)), f"key {kind}, k bigint, part string, last boolean")
    edges = parts.mapInArrow(lambda it: released(_edges(it, chunk, overlap, pattern)), f"key {kind}, k bigint, head binary, tail binary")
    one = edges.groupBy("key", "k").agg(F.min("head").alias("head"), F.min("tail").alias("tail"))
    cuts = (
        one.select("key", (F.col("k") + 1).alias("k"), "tail")
        .join(one.select("key", "k", "head"), ["key", "k"])
        .select("key", "tail", "head")
        .mapInArrow(_cuts, f"key {kind}, cut bigint")
        .filter("cut IS NOT NULL")
        .groupBy("key")
        .agg(F.array_sort(F.collect_set("cut")).alias("cuts"))
    )
    return keyed.join(cuts, "key", "left").select("key", "text", "cuts").mapInArrow(lambda it: released(_cut_up(it)), f"key {kind}, start bigint, part string")


def encode(df: DataFrame, vocab, id_col: str = "doc_id", text_col: str = "text", chunk: int = 32768, overlap: int = 1024, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, ids): the ids of every text as little-endian unsigned 32-bit integers."""
    rows = texts(df, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    size = F.char_length("text")
    short = rows.filter(size <= chunk).select("doc_id", F.col("text").alias("part"))
    short = short.mapInArrow(lambda it: released(_encode(it, vocab, pattern)), f"doc_id {kind}, ids binary")
    return short.unionByName(_long_ids(rows.filter(size > chunk), vocab, chunk, overlap, pattern))


def _long_ids(rows: DataFrame, vocab, chunk: int, overlap: int, pattern: str) -> DataFrame:
    cut = pieces(rows, chunk, overlap, pattern)
    kind = cut.schema["key"].dataType.simpleString()
    ids = cut.repartition("key", "start").mapInArrow(lambda it: released(_encode(it, vocab, pattern)), f"key {kind}, start bigint, ids binary")
    in_order = F.transform(F.array_sort(F.collect_set(F.struct("start", "ids"))), lambda x: x["ids"])
    whole = ids.groupBy("key").agg(
        F.aggregate(in_order, F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"), F.count(F.when(F.col("start") == 0, 1)).alias("copies")
    )
    return whole.select(F.col("key.doc_id").alias("doc_id"), "ids", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("col")


def _counted(batches: Iterator[pa.RecordBatch], vocab, pattern: str) -> Iterator[pa.RecordBatch]:
    codec = Codec.of(vocab.value, pattern)
    for batch in batches:
        n = [len(codec.encode(x.as_py())) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])


def token_counts(df: DataFrame, vocab, id_col: str = "doc_id", text_col: str = "text", chunk: int = 32768, overlap: int = 1024, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens), a row for each row of df; ids of texts of one chunk never leave the worker."""
    rows = texts(df, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    size = F.char_length("text")
    short = rows.filter(size <= chunk).mapInArrow(lambda it: released(_counted(it, vocab, pattern)), f"doc_id {kind}, n_tokens bigint")
    long_ids = _long_ids(rows.filter(size > chunk), vocab, chunk, overlap, pattern)
    return short.unionByName(long_ids.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens")))


def decode(df: DataFrame, vocab, pattern: str = PATTERN) -> DataFrame:
    """df with `decoded`, the bytes that its column `ids` stands for."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(lambda it: released(_decode(it, vocab, pattern)), f"{kinds}, decoded binary")


def round_trip(df: DataFrame, vocab, id_col: str = "doc_id", text_col: str = "text", chunk: int = 32768, overlap: int = 1024, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text.

    Texts of one chunk are encoded and decoded where they are read; only longer ones are dealt out.
    """
    rows = texts(df, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    size = F.char_length("text")
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    short = rows.filter(size <= chunk).mapInArrow(lambda it: released(_report(it, vocab, pattern)), schema)
    long_ids = decode(_long_ids(rows.filter(size > chunk), vocab, chunk, overlap, pattern), vocab, pattern)
    long_report = long_ids.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
    return short.unionByName(long_report)
