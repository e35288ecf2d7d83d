import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeway.llm import classifier, licenses, packing
from ridgeway.llm.queries import op7_quality
from tests.llm.helpers import frame, got, odd_rows, text


def test_license_digests(spark):
    mit = [t for k, t in licenses.KNOWN if k == "MIT"][-1]
    rows = odd_rows() + [
        (20, mit), (21, "Copyright (c) 2019 Some One\n\n" + mit.upper().replace("sublicense".upper(), "SUB-LICENSE").replace(",", " ,")), (22, "text before " + mit),
        (23, "some prose\n** Licenced under the Apache Licence, version 2.0! **\nmore"), (24, "Released under the MIT License.\nReleased under the MIT License"), (24, "Released under the MIT License.\nReleased under the MIT License"),
        (25, "All rights reserved."), (26, "SPDX-License-Identifier: mit"),
    ]
    for limit in (licenses.BROADCAST_BYTES, 0):
        known, old = licenses.known_table(spark), licenses.BROADCAST_BYTES
        licenses.BROADCAST_BYTES = limit
        try:
            out = licenses.scan_licenses(frame(spark, rows), known)
            assert out.count() == len(rows)
            r = got(out)
        finally:
            licenses.BROADCAST_BYTES = old
        assert r[20]["license"] == r[21]["license"] == r[26]["license"] == "MIT" and r[20]["digest"] == r[21]["digest"]
        assert r[22]["license"] is None and r[25]["digest"] == "" == r[1]["digest"]
        assert (r[23]["n_notices"], r[23]["notices"]) == (1, "Apache-2.0")
        assert (r[24]["n_notices"], r[24]["notices"], r[24]["license"]) == (2, "MIT", None)
    assert licenses.scan_licenses(frame(spark, []), known).count() == 0
    assert licenses.scan_licenses(frame(spark, rows), known.limit(0)).filter("license IS NOT NULL").count() == 0


def plain_pack(lengths, capacities):
    """Best fit by looking at every open bin; the size of a new one as the operator's rule has it."""
    rooms, used, size, out, order = [], [], [], [], {}
    left = list(lengths)
    fits, renew = None, 0
    for n in lengths:
        left.remove(n)
        fit = [(r, b) for b, r in enumerate(rooms) if r >= n]
        if fit:
            least = min(r for r, _ in fit)
            b = order[least].pop()
        else:
            if renew == 0:
                fits, renew = list(left), 64
            renew -= 1
            total = lambda c: sum(x for x in fits if x <= c)
            room = min((c for c in capacities if c >= n), key=lambda c: (packing.cost(c) / (n + min(c - n, total(c - n) if c > n else 0)), c))
            b = len(rooms)
            rooms.append(room)
            used.append(0)
            size.append(room)
        out.append((b, used[b]))
        used[b] += n
        rooms[b] -= n
        order.setdefault(rooms[b], []).append(b)
    return out, [min(c for c in capacities if c >= u) for u in used]


def test_packing_against_a_plain_version():
    rng = np.random.default_rng(0)
    for caps in ((8, 16, 64), (64,), (16, 32, 64, 128)):
        for n in (0, 1, 7, 200):
            lengths = sorted(rng.integers(1, max(caps) + 1, n).tolist(), reverse=True)
            bins, offsets, capacity = packing.pack(np.array(lengths, np.int64), caps)
            want, sizes = plain_pack(lengths, sorted(caps)) if n else ([], [])
            assert list(zip(bins.tolist(), offsets.tolist())) == want and capacity.tolist() == [sizes[b] for b, _ in want]


def test_bins_hold_what_they_say(spark):
    rows = odd_rows() + [(100 + i, text(i % 90, i)) for i in range(400)]
    df = frame(spark, rows)
    out = packing.best_fit(df, packing.word_tokens("text"), capacities=(32, 64, 256), shard=100).toPandas()
    got_len = out.groupby("doc_id").length.sum().to_dict()
    for i, t in rows:
        assert got_len[i] == len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1
    for _, b in out.groupby("bin"):
        b = b.sort_values("offset")
        assert (b.offset.to_numpy() == np.concatenate([[0], b.length.cumsum().to_numpy()[:-1]])).all()
        assert b.capacity.nunique() == 1 and b.length.sum() <= b.capacity.iloc[0] and not [c for c in (32, 64, 256) if b.length.sum() <= c < b.capacity.iloc[0]]
    assert out[out.doc_id == 7].length.max() == 256 and sorted(out[out.doc_id == 7].piece) == list(range((out.doc_id == 7).sum()))
    again = packing.best_fit(df.repartition(7), packing.word_tokens("text"), capacities=(32, 64, 256), shard=100).toPandas()
    key = ["doc_id", "piece", "bin", "offset"]
    assert out.sort_values(key)[key].reset_index(drop=True).equals(again.sort_values(key)[key].reset_index(drop=True))


def test_packing_without_lengths(spark):
    df = spark.createDataFrame([(1, 5), (2, 0), (3, None), (4, 9000)], "doc_id bigint, bin int")
    out = packing.best_fit(df, F.col("bin")).toPandas()
    assert out[out.doc_id.isin([2, 3])].bin.isna().all() and out[out.doc_id == 4].length.sum() == 9000
    assert packing.best_fit(df.limit(0), F.col("bin")).count() == 0


def test_word_features_match_a_plain_version():
    words = ["a", "to", "word", "éé", "x" * 40]
    owner, bucket = classifier.word_features(words, 1 << 20, (3, 4))
    assert [(owner == i).sum() for i in range(5)] == [1 + sum(max(0, len(w) + 2 - n + 1) for n in (3, 4)) for w in words]
    again = classifier.word_features(["word"], 1 << 20, (3, 4))[1]
    assert sorted(bucket[owner == 2]) == sorted(again)
    assert len(set(again)) == len(again)


def test_folded_scores_are_the_softmax_of_the_average():
    docs, y = ["good fine words here", "bad !!! junk", "", "good words"], np.array([1, 0, 1, 1])
    weights, bias = classifier.fit(docs, y, buckets=512, epochs=30)
    s = classifier.Scorer(classifier._packed(weights, bias))
    z = s.logits(docs)
    assert z[0] > z[1] and z[2] == pytest.approx(bias)
    assert classifier.fit(docs, np.ones(4), buckets=64)[1] == pytest.approx(np.log(5))
    assert classifier.fit([], np.array([], int), buckets=64)[1] == 0.0


def test_quality_on_held_out_rows(spark, small):
    sf = small.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = op7_quality(spark, sf).join(labels, "doc_id").filter("held_out").toPandas()
    assert len(out) > 40 and (out.predicted == out.quality).mean() >= 0.9


def test_quality_of_odd_rows(spark):
    rows = odd_rows() + [(i, "good plain words of prose " * 5) for i in range(100, 140)] + [(i, "bad!!! junk$$$ more%%% " * 5) for i in range(200, 240)]
    labels = spark.createDataFrame([(i, int(i < 200), None) for i in [*range(100, 140), *range(200, 240)]] + [(1, None, 1), (999, 1, 0), (100, 1, 1)], "doc_id bigint, quality int, text int")
    out = classifier.quality(frame(spark, rows), labels)
    assert out.count() == len(rows)
    r = got(out)
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3) for x in r.values())
    assert all(r[i]["predicted"] == 1 for i in range(100, 140)) and all(r[i]["predicted"] == 0 for i in range(200, 240))
    assert r[1]["score"] == r[2]["score"] == r[3]["score"]
    assert classifier.quality(frame(spark, []), labels).count() == 0
    none = got(classifier.quality(frame(spark, rows[:4]), labels.limit(0)))
    assert {x["score"] for x in none.values()} == {0.5}
    kept = classifier.keep_quality(frame(spark, rows), labels)
    assert kept.columns == frame(spark, []).columns and {x.doc_id for x in kept.collect()} >= set(range(100, 140)) and not {x.doc_id for x in kept.collect()} & set(range(200, 240))


def test_entire_licence_texts_are_known(spark):
    from pathlib import Path

    files = sorted((Path(licenses.__file__).parent / "license_texts").glob("*.txt"))
    mit = [t for k, t in licenses.KNOWN if k == "MIT"][-1].split("\n", 2)[2]
    named = [(p.stem, p.read_text("utf-8")) for p in files]
    apache, bsd = dict(named)["Apache-2.0"], dict(named)["BSD-3-Clause"]
    named += [("MIT", mit), ("MIT", "The MIT License (MIT)\n\nCopyright (c) 2020 Some One\n\n" + mit), ("Apache-2.0", apache[: apache.index("APPENDIX")])]
    named += [("BSD-3-Clause", "Copyright 2001 A\nAll rights reserved.\n\n" + bsd[bsd.index("Redistribution and use") :].replace("\n* ", "\n1. ", 1).replace("\n* ", "\n2. ", 1).replace("\n* ", "\n3. ", 1))]
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "MPL-2.0", "CC0-1.0", "Unlicense"} <= {p.stem for p in files}
    out = got(licenses.scan_licenses(frame(spark, [(i, t) for i, (_, t) in enumerate(named)]), licenses.known_table(spark)))
    assert {i: r["license"] for i, r in out.items()} == {i: n for i, (n, _) in enumerate(named)}


def test_wrapping_and_copyright_lines_do_not_count(spark):
    import textwrap

    mit = [t for k, t in licenses.KNOWN if k == "MIT"][-1]
    wrapped = ["\n\n".join(textwrap.fill(" ".join(p.split()), n) for p in mit.split("\n\n")) for n in range(25, 121)]
    holders = ["Copyright (c) Jane Doe", "Copyright The Foo Authors", "(c) Foo Inc. 2019", "© 2020 A. B.", "Copyright 2001-2003 by X", "COPYRIGHT (C) 1999 Y. All rights reserved.", " * Copyright Some One"]
    rows = list(enumerate(wrapped + [f"{h}\n\n{mit}" for h in holders] + [mit.replace("copyright notice", "notice")]))
    out = got(licenses.scan_licenses(frame(spark, rows), licenses.known_table(spark)))
    assert {r["license"] for i, r in out.items() if i < len(rows) - 1} == {"MIT"} and out[len(rows) - 1]["license"] is None
    assert len({r["digest"] for i, r in out.items() if i < len(rows) - 1}) == 1
