import hashlib
import random

import pytest
import tiktoken

from ridgeway.llm import bpe, token_files
from ridgeway.llm.bpe import vocabulary_path
from ridgeway.session import fresh_path
from tests.llm.helpers import frame, got, odd_rows, text


@pytest.fixture(scope="module")
def vocab(spark):
    return bpe.vocabulary(spark, vocabulary_path())


@pytest.fixture(scope="module")
def library(vocab):
    return bpe.Codec(vocab.value).core


def test_pieces_of_any_size_give_the_ids_of_the_library(spark, vocab, library):
    rng = random.Random(3)
    rows = odd_rows()
    for i in range(40):
        alphabet = rng.choice(["ab 'stre,!\n", "é   \t\n1", "x", " ", "中文 字a", "'re's 'll\x1c\x85 "])
        rows.append((100 + i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400)))))
    for chunk, overlap in ((16, 16), (50, 20), (4096, 64)):
        out = got(bpe.encode(frame(spark, rows), vocab, chunk=chunk, overlap=overlap))
        for i, t in rows:
            assert bpe.np.frombuffer(out[i]["ids"], "<u4").tolist() == library.encode_ordinary(t or ""), (i, chunk)


def test_round_trip_report(spark, vocab, library):
    rows = odd_rows() + [(7, odd_rows()[6][1])]
    out = bpe.round_trip(frame(spark, rows), vocab, chunk=2000, overlap=100)
    assert out.count() == len(rows)
    byid = got(out)
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        assert (byid[i]["n_tokens"], byid[i]["ids_sha256"], byid[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.round_trip(frame(spark, []), vocab).count() == 0


def test_token_counts_from_flat_files(spark, vocab, library):
    rows = odd_rows() + [(-5, "negative id"), (1 << 62, text(300, 1))]
    path = fresh_path(spark, "test-tokens")
    token_files.write_token_files(frame(spark, rows).repartition(3, "doc_id"), vocab, path)
    want = sorted((i, len(library.encode_ordinary(t or ""))) for i, t in rows)
    for block in (14, 64, 1 << 20):
        out = token_files.count_tokens(spark, path, block=block)
        assert sorted((r.doc_id, r.n_tokens) for r in out.collect()) == want, block


def test_files_without_header_or_last_separator(spark, tmp_path):
    import numpy as np

    def put(name, ids, width=2):
        (tmp_path / name).write_bytes(np.array(ids, f"<u{width}").tobytes())

    put("a.bin", [1, 2, 9, 9, 3])
    put("b.bin", [9])
    put("c.bin", [])
    put("d.bin", [4] * 100)
    for block in (2, 6, 1024):
        out = token_files.count_tokens(spark, str(tmp_path), eod=9, width=2, header=0, block=block)
        found = sorted((r.file, r.doc_no, r.start, r.n_tokens) for r in out.collect())
        assert found == [("a.bin", 0, 0, 2), ("a.bin", 1, 3, 0), ("a.bin", 2, 4, 1), ("b.bin", 0, 0, 0), ("d.bin", 0, 0, 100)], block
    (tmp_path / "odd.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="whole number"):
        token_files.count_tokens(spark, str(tmp_path / "odd.bin"), eod=9, header=0).collect()
    (tmp_path / "w").mkdir()
    put("w/wide.bin", [70000, 9, 1], 4)
    assert [r.n_tokens for r in token_files.count_tokens(spark, str(tmp_path / "w"), eod=9, width=4, header=0).orderBy("doc_no").collect()] == [1, 1]


def test_cutting_is_linear_in_the_length_of_a_text():
    import time

    import pyarrow as pa

    took = []
    for n in (8, 16, 32):
        text_of = "ab cde " * (n * 150_000)
        key = pa.array([1])
        began = time.process_time()
        parts = [b for b in bpe._chunked(iter([pa.RecordBatch.from_arrays([key, pa.array([text_of])], names=["key", "text"])]), 32768, 1024)]
        cuts = [list(range(30000, len(text_of), 30000))]
        cut = list(bpe._cut_up(iter([pa.RecordBatch.from_arrays([key, pa.array([text_of]), pa.array(cuts)], names=["key", "text", "cuts"])])))
        took.append(time.process_time() - began)
        assert "".join(x for b in cut for x in b.column("part").to_pylist()) == text_of
        assert sum(b.num_rows for b in parts) == -(-len(text_of) // 32768) and [x for b in parts for x in b.column("last").to_pylist()][-1]
    assert took[2] < 12 * took[0] + 0.5


def test_token_counts_of_odd_rows(spark, vocab, library):
    rows = odd_rows()
    out = bpe.token_counts(frame(spark, rows), vocab, chunk=2000, overlap=100)
    assert sorted((r.doc_id, r.n_tokens) for r in out.collect()) == sorted((i, len(library.encode_ordinary(t or ""))) for i, t in rows)


def test_token_files_of_an_empty_table_and_too_large_ones(spark, vocab):
    path = fresh_path(spark, "test-none")
    token_files.write_token_files(frame(spark, []), vocab, path)
    assert token_files.count_tokens(spark, path).count() == 0
    path = fresh_path(spark, "test-large")
    token_files.write_token_files(frame(spark, odd_rows()).selectExpr("doc_id", "text", "1 AS n_tokens", "'x' AS file").coalesce(1), vocab, path)
    assert token_files.count_tokens(spark, path).count() == len(odd_rows())
    with pytest.raises(ValueError, match="smaller files"):
        token_files.count_tokens(spark, path, most=100)
