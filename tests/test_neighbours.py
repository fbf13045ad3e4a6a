"""Exact neighbours through the ball index against all products."""

import numpy as np
import pytest

from corpusdelta.operators import vectors as V
from corpusdelta.operators.neighbours import BallIndex


def frame(spark, m, first=0):
    return spark.createDataFrame([(f"w{first + i:05d}", row.tolist()) for i, row in enumerate(m)], "word string, vec array<double>").repartition(6)


def slow(m, k):
    u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    s = u @ u.T
    out = {}
    for i in range(len(m)):
        order = sorted((-round(s[i, j], 12), j) for j in range(len(m)) if j != i)[:k]
        out[i] = [-x for x, _ in order]
    return out


def clustered(n, d=16, centres=30, seed=1, spread=0.05):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, d))
    return c[rng.integers(0, centres, n)] + rng.normal(scale=spread, size=(n, d))


def check(rows, m, k):
    want = slow(m, k)
    got = {}
    for r in rows:
        got.setdefault(int(r.word[1:]), {})[r["rank"]] = r.sim
    assert set(got) == set(want)
    for i, sims in want.items():
        assert sorted(got[i]) == list(range(1, len(sims) + 1))
        np.testing.assert_allclose([got[i][r] for r in sorted(got[i])], sims, atol=1e-9)


@pytest.mark.parametrize("case", ["clustered", "isotropic", "one hot ball", "odd vectors"])
def test_index_equals_all_products(spark, case):
    rng = np.random.default_rng(4)
    m = {"clustered": lambda: clustered(600), "isotropic": lambda: rng.normal(size=(300, 8)),
         "one hot ball": lambda: np.vstack([clustered(60), np.ones((250, 16)) + rng.normal(scale=1e-3, size=(250, 16))]),
         "odd vectors": lambda: np.vstack([np.zeros((3, 16)), clustered(150) * 1e6, np.full((40, 16), 0.5), -np.full((5, 16), 0.5)])}[case]()
    check(V.top_k_neighbours(frame(spark, m), k=5, block_rows=40, indexed=True).collect(), m, 5)


def test_both_plans_give_the_same_rows(spark):
    m = np.vstack([clustered(200), np.tile(np.eye(16)[:4], (10, 1))])      # ties
    df = frame(spark, m)
    key = lambda r: (r.word, r["rank"], r.neighbour, round(r.sim, 9))
    plans = [sorted(map(key, V.top_k_neighbours(df, k=7, block_rows=32, indexed=i).collect())) for i in (True, False)]
    assert plans[0] == plans[1] and len(plans[0]) == 7 * len(m)


def test_pruned_pairs_are_not_shipped(spark):
    m = clustered(2000, centres=40, spread=0.02)
    v = frame(spark, m).select(V.F.col("word").alias("w"), V.normalise("vec").alias("v"))
    index = BallIndex(v, block_rows=50)
    found = index.search(5)
    assert found.count() == 5 * 2000
    assert index.blocks >= 40
    assert index.scored_share() < 0.35
    shipped = index.shipped()
    everything = 2000 * (index.blocks - 1)
    assert shipped.count() < 0.35 * everything
    pairs = shipped.select("pair").distinct().count()
    assert pairs < 0.5 * index.blocks * (index.blocks - 1) / 2


def test_vectors_that_are_not_unit_length(spark):
    rng = np.random.default_rng(9)
    m = clustered(300) * rng.uniform(0.1, 3, (300, 1))
    rows = V.top_k_neighbours(frame(spark, m), k=4, block_rows=30, normalised=True, indexed=True).collect()
    s = m @ m.T
    np.fill_diagonal(s, -np.inf)
    want = np.sort(s, axis=1)[:, ::-1][:, :4]
    for r in rows:
        assert r.sim == pytest.approx(want[int(r.word[1:]), r["rank"] - 1], rel=1e-9)
    assert len(rows) == 1200


def test_few_vectors(spark):
    assert V.top_k_neighbours(frame(spark, np.zeros((0, 3))), indexed=True).count() == 0
    assert V.top_k_neighbours(frame(spark, np.ones((1, 3))), indexed=True).count() == 0
    two = V.top_k_neighbours(frame(spark, np.eye(3)[:2]), k=10, indexed=True).collect()
    assert sorted((r.word, r.neighbour) for r in two) == [("w00000", "w00001"), ("w00001", "w00000")]


def test_what_is_shipped_does_not_grow_with_the_blocks(spark):
    v = frame(spark, np.random.default_rng(2).normal(size=(3000, 16))).select(V.F.col("word").alias("w"), V.normalise("vec").alias("v"))
    index = BallIndex(v, block_rows=16)
    assert index.search(5).count() == 5 * 3000
    assert index.blocks > 150
    assert index.shipped().count() <= 7 * 3000      # once for each other portion, not for each of the blocks


def test_many_copies(spark):
    m = np.vstack([np.tile(np.eye(8)[:1], (1500, 1)), clustered(200, d=8)])
    rows = V.top_k_neighbours(frame(spark, m), k=3, block_rows=20, indexed=True).where("word < 'w01500'").collect()
    assert len(rows) == 3 * 1500
    for r in rows:      # the smallest other words
        others = [i for i in range(4) if i != int(r.word[1:])][:3]
        assert int(r.neighbour[1:]) == others[r["rank"] - 1] and r.sim == pytest.approx(1)
