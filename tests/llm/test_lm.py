"""Language-model scores against counting by hand, and normalisation."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusdelta.llm import lm
from tests.conftest import SF_SMALL


def slow(rows):
    def tokens(t):
        t = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        return re.findall(r"[^\x20\x09-\x0D]+", t) + ["\n"]

    train = Counter(w for i, t in rows if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2 for w in tokens(t))
    n, v = sum(train.values()), len(train)
    out = []
    for i, t in rows:
        tk = tokens(t)
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tk)
        out.append((i, zlib.crc32(str("" if i is None else i).encode()) % 7 == 2, len(tk), sum(train[w] > 0 for w in tk), n, base))
    return out


def _same(got, want):
    key = lambda r: (str(r[0]), r[2], r[5])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)


@pytest.mark.parametrize("hot", [1 << 17, 300, 0])
def test_whole_table(spark, monkeypatch, hot):
    monkeypatch.setattr(lm, "HOT", hot)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = [tuple(r) for r in lm.score_held_out(docs).collect()]
    _same(got, slow([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
    if hot == 1 << 17:  # the network is better than counts on documents it has not seen
        held = [r for r in got if r[1]]
        assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_odd_rows(spark):
    rows = [(1, "A b a"), (1, "A b a"), (1, "c"), (None, None), (2, ""), (3, " \x0bÉ é x "), (9, "b")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, id int, h int")
    _same([tuple(r) for r in lm.score_held_out(df).collect()], slow(rows))
    assert lm.score_held_out(df.limit(0)).count() == 0
    untrained = [tuple(r) for r in lm.score(df, df.limit(0)).collect()]
    assert len(untrained) == 7 and all(r[2] == 0 and r[4] == 0 for r in untrained)


def test_probabilities_sum_to_one_and_training_helps():
    rng = np.random.default_rng(0)
    seq = np.array([2, 3, 4, 5] * 300)  # each class is followed by one other
    places = np.stack([seq[:-2], seq[1:-1], seq[2:]], axis=1).astype(np.int32)
    net = lm.LogBilinear(np.bincount(seq, minlength=8).astype(float), places.copy())
    far, near = rng.integers(0, 8, 20), rng.integers(0, 8, 20)
    total = sum(10 ** net.log10(far, near, np.full(20, t)) for t in range(8))
    np.testing.assert_allclose(total, 1, atol=1e-4)
    assert net.log10(places[:, 0], places[:, 1], places[:, 2]).mean() > math.log10(0.4)


def test_network_learns_from_all_documents(spark, monkeypatch):
    """The start sees one place; what follows on what is learned from the others."""
    for name, value in (("FIT_DOCS", 1), ("FIT_PLACES", 1), ("STEP", 64), ("SHARE", 2000), ("ADDED", 2)):
        monkeypatch.setattr(lm, name, value, raising=False)
    df = spark.createDataFrame([(i, "a b c d " * 12 if i else None) for i in range(1200)], "doc_id long, text string")
    got = lm.score_held_out(df).where("doc_id > 0").collect()
    assert len(got) == 1199 and all(r.score / r.n_tokens > math.log10(0.5) for r in got)
    assert [r.score for r in lm.score_held_out(df).orderBy("doc_id").collect()][1:] == pytest.approx(
        [r.score for r in sorted(got, key=lambda r: r.doc_id)], rel=1e-5)
