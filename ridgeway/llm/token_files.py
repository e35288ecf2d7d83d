"""Token counts from flat token files by a separator scan.

A token file holds the ids of one document after another as little-endian unsigned integers of one width, each document
ended by the end-of-document id, and nothing else: no index, no lengths. Files are read as bytes and cut into blocks
without regard to documents. Every block is searched for separators at once (numpy), and a prefix scan over a file's
blocks carries the place of the last separator into the next, so a document that spans blocks is counted whole.

Where `header` is set, a document's first tokens spell its id in digits of base `eod` (so that none looks like a
separator). A last document without a separator counts as well. An empty file has no documents, a document without
tokens counts 0. A file whose size is not a whole number of tokens is an error, and so is one over `most` bytes, as a
file is read by one task: `write_token_files` makes one file for each partition, so deal the documents over more.
An empty table gives no documents. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeway.llm.bpe import PATTERN, Codec
from ridgeway.llm.common import texts

EOD, WIDTH, HEADER, BLOCK = 50256, 2, 5, 1 << 20
#: Bytes of a file at most: what one task reads.
MOST = 1 << 30


def id_digits(doc_id: int, eod: int = EOD, header: int = HEADER) -> list[int]:
    """A 64-bit id as digits, most significant first."""
    x, out = doc_id & (1 << 64) - 1, []
    for _ in range(header):
        x, digit = divmod(x, eod)
        out.append(digit)
    return out[::-1]


def id_of(digits, eod: int = EOD) -> int:
    x = 0
    for d in digits:
        x = x * eod + int(d)
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _tokens(batches: Iterator[pa.RecordBatch], vocab, eod: int, width: int, header: int) -> Iterator[pa.RecordBatch]:
    codec = Codec.of(vocab.value, PATTERN)
    for batch in batches:
        out = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            ids = codec.encode(text.as_py())
            out.append(np.concatenate([np.asarray(id_digits(doc_id, eod, header), np.int64), ids]).astype(f"<u{width}").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def write_token_files(df: DataFrame, vocab, path: str, id_col: str = "doc_id", text_col: str = "text", eod: int = EOD, width: int = WIDTH, header: int = HEADER) -> None:
    """Flat token files under a path, one for each partition, through Spark's text sink: the separator is its line end.

    Rows without an id are left out when a header is asked for.
    """
    rows = texts(df, id_col, text_col)
    rows = rows.filter("doc_id IS NOT NULL") if header else rows
    raw = rows.mapInArrow(lambda it: _tokens(it, vocab, eod, width, header), "value binary")
    end = eod.to_bytes(width, "little").decode("latin-1")
    raw.select(F.col("value").cast("string")).write.option("lineSep", end).option("encoding", "ISO-8859-1").option("compression", "none").text(path)


def scan_block(data: bytes, at: int, tokens: int, total: int, eod: int, width: int, header: int) -> tuple[np.ndarray, list[int | None]]:
    """Places of the separators among a block's own `tokens`, and the ids of the documents that begin after each.

    data: the block from token `at` on, and some tokens beyond it for headers; total: tokens of the file.
    """
    every = np.frombuffer(data, f"<u{width}", count=len(data) // width)
    own = every[:tokens]
    here = np.flatnonzero(own == eod)
    starts = here + 1
    if at == 0:
        starts = np.concatenate([[0], starts])
    ids = [id_of(every[s : s + header], eod) if header and at + s < total else None for s in starts.tolist()]
    places = here + at
    if at + tokens >= total and len(own) and own[-1] != eod:
        places = np.append(places, total)  # the last document has no separator
    return places, ids


def _scan(batches: Iterator[pa.RecordBatch], block: int, eod: int, width: int, header: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places, ids = [], []
        for k, size, data in zip(batch.column("k").to_pylist(), batch.column("length").to_pylist(), batch.column("data").to_pylist()):
            if size % width:
                raise ValueError(f"{size} bytes are no whole number of tokens of {width}")
            per, total = block // width, size // width
            p, i = scan_block(data, k * per, min(per, total - k * per), total, eod, width, header)
            places.append(p.tolist())
            ids.append(i)
        yield pa.RecordBatch.from_arrays(
            [batch.column("path"), batch.column("k"), pa.array(places, pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.int64()))],
            names=["path", "k", "places", "ids"],
        )


def count_tokens(spark: SparkSession, path: str, eod: int = EOD, width: int = WIDTH, header: int = HEADER, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """(file, doc_no, doc_id, start, n_tokens) of every document in the token files under a path.

    doc_no counts from 0 in each file; start is the first token after the header; doc_id is null without a header.
    """
    block -= block % width
    found = spark.read.format("binaryFile").load(path).filter("length > 0")
    if large := found.filter(F.col("length") > most).select("path", "length").first():  # names and sizes only, no content
        raise ValueError(f"{large.path} has {large.length} bytes, over {most}; write more and smaller files")
    files = found.select("path", "length", "content")
    cut = files.select("path", "length", "content", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block))).alias("k"))
    cut = cut.select("path", "length", "k", F.substring("content", (F.col("k") * block + 1).cast("int"), F.lit(block + header * width)).alias("data"))
    scanned = cut.mapInArrow(lambda it: _scan(it, block, eod, width, header), "path string, k bigint, places array<bigint>, ids array<bigint>")
    # One row for each block: a scan over them is short, whatever the documents.
    before = W.partitionBy("path").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    last = F.when(F.size("places") > 0, F.element_at("places", -1))
    last_id = F.when(F.size("ids") > 0, F.struct(F.element_at("ids", -1).alias("id")))
    carried = scanned.select(
        "path",
        "places",
        "ids",
        F.col("k"),
        F.coalesce(F.max(last).over(before), F.lit(-1)).alias("last"),
        F.last(last_id, ignorenulls=True).over(before)["id"].alias("id"),
        F.coalesce(F.sum(F.size("places")).over(before), F.lit(0)).alias("first_no"),
    )
    # The document that ends at a block's first separator began in this block only if the block is the file's first.
    ids = F.when(F.col("k") == 0, F.col("ids")).otherwise(F.concat(F.array("id"), "ids"))
    docs = carried.select("path", "first_no", "last", "places", ids.alias("ids"), F.posexplode("places").alias("j", "place"))
    begin = F.when(F.col("j") == 0, F.col("last")).otherwise(F.element_at("places", F.greatest(F.col("j"), F.lit(1)))) + 1 + header
    return docs.select(
        F.regexp_extract("path", r"[^/]+$", 0).alias("file"),
        (F.col("first_no") + F.col("j")).cast("long").alias("doc_no"),
        F.element_at("ids", F.col("j") + 1).alias("doc_id"),
        begin.alias("start"),
        (F.col("place") - begin).alias("n_tokens"),
    )
