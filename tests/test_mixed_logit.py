"""The random-intercept model against numerical integration."""

import math

import numpy as np
import pytest

from corpusdelta.operators import mixed_logit as ML
from corpusdelta.operators import selection as SE


def data(n=700, groups=90, sd=1.2, seed=2, hot=0.0):
    rng = np.random.default_rng(seed)
    g = np.where(rng.uniform(size=n) < hot, 0, rng.integers(0, groups, size=n))
    x = rng.normal(size=(n, 2))
    u = rng.normal(scale=sd, size=groups) if sd else np.zeros(groups)
    y = (rng.uniform(size=n) < 1 / (1 + np.exp(-(0.3 + x @ [1.0, -0.7] + u[g])))).astype(float)
    return g, x, y


def frame(spark, g, x, y):
    return spark.createDataFrame([(None if g[i] == 1 else int(g[i]), float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(len(y))],
                                 "pair long, y double, a double, b double").repartition(7)


def exact(g, x, y, theta):
    """Log-likelihood by a fine sum over the intercept."""
    sigma, total = math.exp(theta[-1]), 0.0
    u = np.linspace(-9 * sigma, 9 * sigma, 6001)
    step = u[1] - u[0]
    xx = np.column_stack([np.ones(len(y)), x])
    for k in np.unique(g):
        eta = (xx[g == k] @ theta[:-1])[:, None] + u
        lp = (y[g == k][:, None] * eta - np.logaddexp(0, eta)).sum(0) - 0.5 * (u / sigma) ** 2 - math.log(sigma * math.sqrt(2 * math.pi))
        total += np.logaddexp.reduce(lp) + math.log(step)
    return total


@pytest.mark.parametrize("big,hot", [(65_536, 0.0), (20, 0.4)])
def test_one_pass_gives_likelihood_and_both_derivatives(spark, big, hot):
    g, x, y = data(n=400, groups=30, hot=hot)
    rows = ML.Rows(frame(spark, g, x, y), ["a", "b"], "y", "pair", nodes=25, big=big)
    assert bool(rows.modes) == (big == 20)
    theta = np.array([0.1, 0.4, -0.3, math.log(0.8)])
    for _ in range(8):                      # modes of split groups come to rest
        got = rows.sums(theta)
    assert rows.settled()
    assert got.loglik == pytest.approx(exact(g, x, y, theta), abs=1e-6)
    eps = 1e-4
    for j in range(4):
        e = np.eye(4)[j] * eps
        assert got.gradient[j] == pytest.approx((exact(g, x, y, theta + e) - exact(g, x, y, theta - e)) / (2 * eps), abs=1e-4)
        for i in range(4):
            f = np.eye(4)[i] * eps
            second = (exact(g, x, y, theta + e + f) - exact(g, x, y, theta + e - f) - exact(g, x, y, theta - e + f) + exact(g, x, y, theta - e - f)) / (4 * eps * eps)
            assert got.hessian[i, j] == pytest.approx(second, abs=2e-2)


def test_fit_is_the_maximum_with_one_pass_per_step(spark, monkeypatch):
    g, x, y = data()
    calls = []
    sums = ML.Rows.sums
    monkeypatch.setattr(ML.Rows, "sums", lambda self, t: calls.append(1) or sums(self, t))
    fitted = ML.fit(ML.Rows(frame(spark, g, x, y), ["a", "b"], "y", "pair"))
    assert fitted.converged and fitted.passes == len(calls) <= 25
    best = exact(g, x, y, fitted.theta)
    assert fitted.loglik == pytest.approx(best, abs=1e-4)
    for j in range(4):
        for eps in (1e-2, -1e-2):
            assert exact(g, x, y, fitted.theta + np.eye(4)[j] * eps) < best
    assert 0.7 < math.exp(fitted.theta[-1]) < 1.8


def test_split_groups_give_the_same_fit(spark):
    g, x, y = data(n=500, groups=12, hot=0.5)
    df = frame(spark, g, x, y)
    whole = ML.fit(ML.Rows(df, ["a", "b"], "y", "pair"))
    split = ML.fit(ML.Rows(df, ["a", "b"], "y", "pair", big=25))
    assert whole.converged and split.converged
    np.testing.assert_allclose(split.theta, whole.theta, atol=2e-4)
    assert split.loglik == pytest.approx(whole.loglik, abs=1e-4)


def test_no_variance_is_the_plain_model(spark):
    rng = np.random.default_rng(5)
    n = 600
    x = rng.normal(size=(n, 2))
    y = (rng.uniform(size=n) < 1 / (1 + np.exp(-(0.3 + x @ [1.0, -0.7])))).astype(float)
    y[1::2] = 1 - y[0::2]                   # the rows of a pair are less alike than by chance
    df = frame(spark, np.arange(n) // 2 + 2, x, y)
    got = {r.term: r for r in SE.paired_logistic(df, ["a", "b"], "y", "pair").collect()}
    glm = {r.term: r.estimate for r in SE.logistic_regression(df, ["a", "b"], "y").collect()}
    assert got["a"].sd_intercept == 0.0 and got["a"].converged
    for t in glm:
        assert got[t].estimate == pytest.approx(glm[t], abs=1e-5)


def test_unfinished_fit_says_so(spark):
    g, x, y = data(n=200, groups=20)
    assert not ML.fit(ML.Rows(frame(spark, g, x, y), ["a", "b"], "y", "pair"), max_iter=1).converged
