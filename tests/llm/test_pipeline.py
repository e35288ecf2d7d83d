import re

import corpus_pipeline
from ridgeway.llm import exact_dedup, secrets
from ridgeway.session import written
from tests.llm.helpers import SCHEMA, frame, odd_rows, text
from tests.llm.test_dedup import brute_near


def test_stages_follow_each_other(spark, small):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "near dedup", "secret scan", "best-fit packing"] and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, small), "test-stage")
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in docs.select("doc_id").collect()}
        kept.append(ids)
        docs = out
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert all(k for _, _, _, k in brute_near(rows))
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    assert len(set(norm)) == len(norm) and not any(s[0] in secrets.BASE for _, t in rows for s in secrets.find_spans(t or ""))
    packed = corpus_pipeline.run(spark, small)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == kept[-1]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    good = {i for i, q in labels.items() if q == 1}
    assert len(good - kept[0]) <= 0.02 * len(good)


def test_stages_over_odd_and_empty_tables(spark, small):
    rows = odd_rows() + [(50, "token = abcdefgh12345678 " + text(40, 1)), (50, "token = abcdefgh12345678 " + text(40, 1))]
    for docs in (frame(spark, rows), spark.createDataFrame([], SCHEMA)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, small)
            assert out.count() >= 0
            if name != "best-fit packing":
                assert out.columns == docs.columns


def test_exact_then_near_keeps_one_of_each(spark):
    a = text(80, 1)
    docs = frame(spark, [(4, a), (2, a.upper()), (3, a.replace(" ", "  ")), (9, text(80, 2))])
    out = corpus_pipeline.near(spark, exact_dedup.exact_dedup(docs), "")
    assert sorted(r.doc_id for r in out.collect()) == [2, 9]
