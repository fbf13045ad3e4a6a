"""Alignment and self-similarity over several runs."""

import numpy as np

from corpusdelta.operators import vectors as V
from corpusdelta.plans import vector_plans as VP
from tests.conftest import SF_SMALL


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def slow(base, other, runs):
    """``{word: [similarity per run]}`` by a rotation of each run on its own."""
    out = {}
    for i, r in enumerate(runs):
        words = sorted(base[r].keys() & other[r].keys())
        if not words:
            continue
        a, b = (np.array([t[r][w] for w in words]) for t in (base, other))
        u, _, vt = np.linalg.svd(unit(b).T @ unit(a))
        for w, sim in zip(words, (unit(a) * unit(b @ (u @ vt))).sum(1)):
            out.setdefault(w, [None] * len(runs))[i] = sim
    return out


def check(got, want):
    assert set(got) == set(want)
    for w, sims in want.items():
        assert [x is None for x in got[w].sims] == [x is None for x in sims]
        known = [x for x in sims if x is not None]
        np.testing.assert_allclose([x for x in got[w].sims if x is not None], known, atol=2e-6)
        np.testing.assert_allclose(got[w].avg, np.mean(known), atol=2e-6)


def by_run(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.run, {})[r.word] = list(r.vec)
    return out


def test_runs_are_aligned_each_on_its_own(spark):
    rng = np.random.default_rng(3)
    tables = {}
    for name, noise in (("base", 0.0), ("other", 0.3)):
        rows = []
        for r in ("a", "b", "c"):
            points = np.random.default_rng(7).normal(size=(12, 4))
            q, _ = np.linalg.qr(rng.normal(size=(4, 4)))
            m = points @ q + rng.normal(scale=noise, size=points.shape)
            rows += [(r, f"w{k}", m[k].tolist()) for k in range(12 if (name, r) != ("other", "b") else 11)]
        tables[name] = spark.createDataFrame(rows, "run string, word string, vec array<double>").repartition(5)
    got = {r.word: r for r in V.aligned_similarity_runs(tables["base"], tables["other"], ["a", "b", "c"]).collect()}
    check(got, slow(by_run(tables["base"]), by_run(tables["other"]), ["a", "b", "c"]))
    assert got["w11"].sims[1] is None and got["w11"].sims[0] is not None
    some = {r.word: r for r in V.aligned_similarity_runs(tables["base"], tables["other"], ["c"]).collect()}
    np.testing.assert_allclose(some["w3"].sims[0], got["w3"].sims[2], atol=1e-12)


def test_one_pass_for_all_runs(spark, monkeypatch):
    calls = []
    grams = V._grams
    monkeypatch.setattr(V, "_grams", lambda *a: calls.append(1) or grams(*a))
    base, other, runs = VP._runs(spark, SF_SMALL)
    V.aligned_similarity_runs(base, other, runs).count()
    assert len(runs) == 3 and calls == [1]


def test_registered_query_equals_plain_rotations(spark):
    base, other, runs = VP._runs(spark, SF_SMALL)
    got = {r.word: r for r in VP.q_aligned_similarity_runs(spark, SF_SMALL).collect()}
    want = slow(by_run(base), by_run(other), runs)
    check(got, want)
    sims = [x for s in want.values() for x in s if x is not None]
    assert min(sims) < 0.999 and any(x is None for s in want.values() for x in s)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "run int, word string, vec array<double>")
    assert V.aligned_similarity_runs(empty, empty, [1, 2]).count() == 0
    one = spark.createDataFrame([(1, "w", [1.0, 0.0])], "run int, word string, vec array<double>")
    assert V.aligned_similarity_runs(one, empty, [1]).count() == 0
