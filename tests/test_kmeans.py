"""k-means of many targets in shared passes."""

import numpy as np
import pytest

from corpusdelta.operators import batched_kmeans as BK
from corpusdelta.operators import senses as SN


def plain(x, k, seed, iters=100):
    """k-means++ and Lloyd's steps of one target; the inertia."""
    rng = np.random.default_rng(seed)
    c = [x[rng.integers(len(x))]]
    for _ in range(1, min(k, len(x))):
        d2 = np.min(((x[:, None, :] - np.array(c)[None]) ** 2).sum(-1), axis=1)
        c.append(x[rng.choice(len(x), p=d2 / d2.sum())] if d2.sum() > 0 else x[rng.integers(len(x))])
    c = np.array(c)
    for _ in range(iters):
        lab = ((x[:, None, :] - c[None]) ** 2).sum(-1).argmin(1)
        new = np.array([x[lab == j].mean(0) if (lab == j).any() else c[j] for j in range(len(c))])
        if np.allclose(new, c):
            break
        c = new
    return ((x - c[lab]) ** 2).sum()


def vectors(seed=3, d=6):
    rng = np.random.default_rng(seed)
    out = {}
    for t, n in (("big", 700), ("mid", 90), ("few", 5), ("one", 1), ("same", 30), (None, 40)):
        centres = rng.normal(size=(6, d)) * 4
        out[t] = np.ones((n, d)) if t == "same" else centres[rng.integers(0, 6, n)] + rng.normal(scale=0.6, size=(n, d))
    return out


def frame(spark, data):
    return spark.createDataFrame([(t, i, x.tolist(), "t1") for t, m in data.items() for i, x in enumerate(m)],
                                 "target string, sent_id long, vec array<double>, time string").repartition(7)


def inertia(x, clust):
    return sum(((x[clust == c] - x[clust == c].mean(0)) ** 2).sum() for c in np.unique(clust))


@pytest.mark.parametrize("table", [64 << 20, 8 * 3 * 4 * 6 * 2])
def test_inertia_is_not_above_single_runs(spark, monkeypatch, table):
    monkeypatch.setattr(BK, "TABLE_BYTES", table)      # the second: two targets a lot
    data = vectors()
    got = {}
    for r in SN.cluster_target_senses(frame(spark, data), k=4).collect():
        got.setdefault(r.target, {})[r.sent_id] = (r.clust, r.dist)
    assert {t: len(v) for t, v in got.items()} == {t: len(m) for t, m in data.items()}
    for t, x in data.items():
        clust = np.array([got[t][i][0] for i in range(len(x))])
        single = np.mean([plain(x, 4, s) for s in range(5)])
        assert inertia(x, clust) <= single * 1.001 + 1e-9, t
        for c in np.unique(clust):          # a fixed point: means are the centres of their rows
            mean = x[clust == c].mean(0)
            for i in np.flatnonzero(clust == c):
                cosine = x[i] @ mean / (np.linalg.norm(x[i]) * np.linalg.norm(mean))
                assert got[t][i][1] == pytest.approx(1 - cosine, abs=1e-3)
    assert {got["same"][i][0] for i in range(30)} == {0} and got["one"][0][0] == 0


def test_same_clusters_for_any_partitioning(spark):
    data = vectors(5)
    rows = [sorted((str(r.target), r.sent_id, r.clust) for r in SN.cluster_target_senses(frame(spark, data).repartition(n), k=4).collect()) for n in (1, 9)]
    assert rows[0] == rows[1]


def test_one_pass_for_all_targets(spark, monkeypatch):
    calls = []
    step = BK.Lot.step
    monkeypatch.setattr(BK.Lot, "step", lambda self, m: calls.append(m.sum()) or step(self, m))
    data = {f"t{i}": np.random.default_rng(i).normal(size=(12, 3)) for i in range(40)}
    SN.cluster_target_senses(frame(spark, data), k=2).count()
    assert len(calls) < 25 and calls[0] == 40 * 3 and calls[-1] < calls[0]


def test_empty_table(spark):
    assert SN.cluster_target_senses(frame(spark, {"a": np.ones((1, 2))}).limit(0)).count() == 0
