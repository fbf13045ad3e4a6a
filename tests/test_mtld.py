"""MTLD as a parallel scan against the sequential fold."""

import random

import numpy as np
import pytest

from corpusdelta.operators import features as FT


def sequential(seq, threshold=0.72):
    def factors(s):
        count, types, size = 0.0, set(), 0
        for w in s:
            types.add(w)
            size += 1
            if len(types) / size <= threshold:
                count, types, size = count + 1, set(), 0
        if size:
            count += (1 - len(types) / size) / (1 - threshold)
        return len(s) / count if count > 0 else float(len(s))
    return (factors(seq) + factors(seq[::-1])) / 2


def table(spark, docs):
    rows = [(d, i // 13, i % 13, w) for d, seq in docs.items() for i, w in enumerate(seq)]
    return spark.createDataFrame(rows, "doc_id long, sent_id long, pos_in_sent long, lemma string")


def texts():
    rng = random.Random(6)
    natural = lambda n, v: [f"w{int(v * rng.random() ** 3)}" for _ in range(n)]
    return {1: ["a"], 2: ["a"] * 40, 3: [f"u{i}" for i in range(300)], 4: natural(700, 60), 5: natural(2500, 400),
            6: natural(63, 20), 7: natural(64, 20), 8: natural(65, 20), 9: [f"u{i}" for i in range(90)] + natural(400, 8) + [f"v{i}" for i in range(200)],
            10: ["x", "y"] * 200, 11: natural(1, 5), 12: [f"u{i % 150}" for i in range(1000)]}


@pytest.mark.parametrize("chunk,fan", [(16, 2), (64, 3), (1024, 16)])
def test_equals_the_sequential_fold(spark, chunk, fan):
    docs = texts()
    got = {r.doc_id: r.mtld for r in FT.mtld(table(spark, docs), chunk=chunk, fan=fan).collect()}
    assert set(got) == set(docs)
    for d, seq in docs.items():
        assert got[d] == pytest.approx(sequential(seq), rel=1e-12), d


def test_no_group_holds_a_document(spark, monkeypatch):
    seen = []
    seq = [f"w{int(300 * random.Random(i).random() ** 3)}" for i in range(5000)]
    plain = FT._chunk_map
    monkeypatch.setattr(FT, "_chunk_map", lambda s, *a: seen.append(len(s)) or plain(s, *a))
    pos = {0: seq, 1: seq[::-1]}
    for way, s in pos.items():  # what the chunks of one direction see
        maps = [FT._chunk_map(s[c * 128:c * 128 + 255], 128, c * 128, len(s), 0.72) for c in range(-(-len(s) // 128))]
        count, at = maps[0][0][0], maps[0][1][0]
        for c, (counts, exits) in enumerate(maps[1:], 1):
            if c * 128 <= at < c * 128 + 128:
                count, at = count + counts[at - c * 128], exits[at - c * 128]
        assert at == FT.ENDED
    assert max(seen) <= 255
    df = table(spark, {1: seq})
    plan = FT.mtld(df, chunk=128, fan=4)
    assert plan.first().mtld == pytest.approx(sequential(seq), rel=1e-12)


def test_tokens_of_short_documents_are_not_kept(spark, monkeypatch):
    from corpusdelta import session
    kept, plain = [], session.cut
    monkeypatch.setattr(session, "cut", lambda df: kept.append(plain(df)) or kept[-1])
    docs = texts()
    got = {r.doc_id: r.mtld for r in FT.mtld(table(spark, docs), chunk=16, fan=4).collect()}
    short = [d for d, seq in docs.items() if len(seq) <= 256]
    assert kept[0].count() == 2 * len(short) + sum(len(seq) for d, seq in docs.items() if d not in short)
    assert got == pytest.approx({d: sequential(seq) for d, seq in docs.items()}, rel=1e-12)
    FT.mtld(table(spark, docs))
    assert kept[-1].count() == 2 * len(docs)


def test_closes_of_all_starts_equal_single_scans():
    rng = random.Random(2)
    for _ in range(40):
        seq = [f"w{rng.randrange(rng.choice([2, 10, 60]))}" for _ in range(rng.randrange(1, 90))]
        starts = rng.randrange(1, len(seq) + 1)
        behind, types = FT._closes(seq, starts, 0.72)
        single = [FT._close(seq, at, 0.72) for at in range(starts)]
        assert list(behind) == [s[0] for s in single]
        assert [t for t, s in zip(types, single) if s[0] < 0] == [s[1] for s in single if s[0] < 0]


def test_empty_table(spark):
    assert FT.mtld(table(spark, {1: ["a"]}).limit(0)).count() == 0
    assert np.isfinite(FT.mtld(table(spark, {1: ["a"]})).first().mtld)
