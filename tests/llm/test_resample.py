"""Importance resampling against plain counting of every run of words."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusdelta.llm import queries, resample
from tests.conftest import SF_SMALL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def slow(docs, target, buckets=10_000, min_words=20, percent=25, seed=7):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, text in docs for f in runs(text)[1])
    t = Counter(bucket(f) for text in target for f in runs(text)[1])
    s_all, t_all = sum(s.values()) + buckets, sum(t.values()) + buckets
    rows = []
    for i, text in docs:
        words, fs = runs(text)
        gain = [math.floor(1000 * math.log((t[bucket(f)] + 1) * s_all / ((s[bucket(f)] + 1) * t_all))) for f in fs]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= min_words])
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(fit[:percent * len(fit) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBz09 .-éß中\x7f\x85\xa0\n", max_size=60)), max_size=12))
@settings(max_examples=300, deadline=None)
def test_buckets_of_runs(texts):
    features = resample.Features(10_000)
    for _ in range(2):  # the second time, words are known
        counts, single, pairs = features(texts)
        at = 0
        for text, n in zip(texts, counts):
            words, fs = runs(text)
            got = single[at:at + n].tolist() + [p for p in pairs[at:at + n].tolist() if p >= 0]
            assert n == len(words) and got == [zlib.crc32(f.encode()) % 10_000 for f in fs]
            at += n
        features.words.refresh(least=0)


def test_dictionary_takes_up_words_and_stays_bounded(monkeypatch):
    monkeypatch.setattr(resample, "WORDS_KEPT", 2000)
    rng = random.Random(5)
    features = resample.Features(997)
    for step in range(60):
        texts = [" ".join(rng.choice(["the", "of", f"w{rng.randrange(3000)}", "é" * rng.randrange(1, 9)]) for _ in range(50)) for _ in range(20)]
        counts, single, pairs = features(texts)
        want = [zlib.crc32(w.encode()) % 997 for t in texts for w in runs(t)[0]]
        assert single.tolist() == want
        assert len(features.words.index) <= 2000 + 1000


def test_crc_of_words_of_any_length():
    shift, rng = resample.Shift(), random.Random(1)
    sizes = [1, 2, 63, 64, 65, 127, 128, 1000, 70_000]
    left = [rng.randbytes(rng.randrange(1, 40)) for _ in sizes]
    right = [rng.randbytes(n) for n in sizes]
    got = shift(np.array([zlib.crc32(x) for x in left], np.uint32), np.array(sizes, np.uint32)) ^ np.array([zlib.crc32(x) for x in right], np.uint32)
    assert got.tolist() == [zlib.crc32(a + b) for a, b in zip(left, right)]


def test_whole_query_equals_plain_counting(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    got = queries.op13_resample(spark, SF_SMALL)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == slow(docs, target)


@pytest.mark.parametrize("slice_rows", [256, 3])
def test_odd_rows(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(resample, "SLICE", slice_rows)
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("The cat, sat ON mat-9 éa 中".split()) + rng.choice(" .-") for _ in range(rng.randrange(60)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "... --- ..."), (103, "x" * 50_000 + " " + "ab " * 30_000), (None, "word " * 30),
             (104, "same words " * 15), (104, "same words " * 15), (None, None)]
    target = ["The cat sat", None, "", "words same"]
    df = spark.createDataFrame([(t, i, 1, 2) for i, t in docs], "text string, doc_id long, rank int, _part int")
    tdf = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(df, tdf, percent=40)
    assert sorted(map(tuple, got.collect()), key=str) == slow(docs, target, percent=40)
    kept = resample.drawn(df, got)
    ids = {r.doc_id for r in got.collect() if r.rank is not None}
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i in ids)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c " * 10), (2, "d")], "doc_id long, text string")
    assert resample.resample(docs.limit(0), docs).count() == 0
    got = resample.resample(docs, docs.limit(0), percent=100).collect()
    assert sorted(map(tuple, got), key=str) == slow([(1, "a b c " * 10), (2, "d")], [], percent=100)
