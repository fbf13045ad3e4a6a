"""Held-out accuracy, and exact neighbours against a plain search."""

import zlib

import numpy as np

from corpusdelta.llm import quality as q

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_folds(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in q.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    kept = {r.doc_id for r in q.keep_good(docs, labels).select("doc_id").collect()}
    assert kept == {i for i, r in got.items() if r.predicted}


def test_votes_equal_a_plain_search():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.choice(list(b"abc XY!"), 200).astype(np.uint8)) for _ in range(60)]
    labels = np.array([t.count(b"!") > 28 for t in texts]).astype(int)
    m = q.Model(np.stack([q.term_counts(t) for t in texts]), labels, 0.7)
    probe = texts[:5] + [b""]
    for t, s in zip(probe, m.score(probe)):
        x = q._weighted(q.term_counts(t)[None], m.idf)[0] @ m.directions
        if not x.any():
            assert s == 0.7
            continue
        cos = m.vectors @ (x / np.linalg.norm(x))
        near = sorted(range(60), key=lambda i: -cos[i])[:q.NEIGHBOURS]
        d = np.array([1 - min(cos[i], 1) for i in near])
        w = m.votes[near] / (d + 0.1 * d.mean() + 1e-6)
        assert abs(s - (w * labels[near]).sum() / w.sum()) < 1e-4


def test_packed_counts_give_the_same_model_and_are_never_held_whole():
    import tracemalloc

    import pyarrow as pa
    texts = [b"some words of text %d " % (k * 7919) * 4 + b"?!"[k % 2:k % 2 + 1] * 9 for k in range(3000)]
    labels = np.arange(3000) % 2
    whole = np.stack([q.term_counts(t).astype(np.int32) for t in texts])
    packed = q.PackedCounts(pa.chunked_array([[zlib.compress(r.tobytes(), 1) for r in whole]]))
    a = q.Model(whole, labels, 0.5)
    del whole
    tracemalloc.start()
    b = q.Model(packed, labels, 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(a.idf, b.idf) and np.array_equal(a.directions, b.directions) and np.array_equal(a.vectors, b.vectors)
    assert peak < 3000 * q.WIDTH * 4 * 1.9      # the weighted matrix, not the counts beside it


def test_odd_rows(spark):
    rows = [(i, ("good text here and there %d " % i) * 5 if i % 2 else "BAD!! TEXT!! %d!! " % i * 5) for i in range(40)]
    rows += [(100, None), (101, ""), (101, ""), (None, "good text here"), (102, "x" * 3_000_000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, None), (None, 1), (5, 1)], "doc_id long, quality int")
    got = q.classify(df, labels)
    assert got.count() == len(rows) and got.where("doc_id < 40 AND predicted <> doc_id % 2").count() == 0
    assert len({r.score for r in got.where("doc_id IN (100, 101)").collect()}) == 1
    assert q.classify(df.limit(0), labels).count() == 0
    assert {r.score for r in q.classify(df, labels.limit(0)).collect()} == {0.5}
    assert {r.predicted for r in q.classify(df, labels.where("quality = 0")).collect()} == {0}
