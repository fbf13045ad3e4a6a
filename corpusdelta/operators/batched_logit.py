"""Many logistic elastic-net fits in one pass per iteration.

Cross-validation grids and bootstrap replicates are the same model on
differently weighted rows. Instead of one distributed job per fit, every
pass over the (checkpointed) training table computes the weighted sums of a
proximal-Newton step for all M models at once, as per-partition partial sums in
Arrow batches; the driver then solves M small penalised quadratic problems by
coordinate descent.

Only what a step needs leaves the tasks. A model sends its loss and its full
gradient (d + 1 numbers), but second derivatives of its *active* features
alone: those with a coefficient, and those whose gradient breaks the penalty's
bound (the strongest first, so that a set at most doubles in a pass). The full
gradient proves the optimality conditions of all other features, so the result
is that of the whole problem. A converged model drops out of the passes. Steps
that do not lower a model's objective are halved. Every model reports whether
it met the optimality conditions.

Row weights are computed inside the tasks from the row id and fold
columns (fold masks, or Poisson(1) bootstrap weights from a splitmix64 hash
of (seed, replicate, id)), so no resampled copy of the data is built.
Features are standardised per model with that model's weighted mean and
population sd (the scaler sits inside the folds); reported coefficients
are on the standardised scale.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_M64 = np.uint64(0xFFFFFFFFFFFFFFFF)


def splitmix64(x: np.ndarray) -> np.ndarray:
    z = (x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) & _M64
    z = ((z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)) & _M64
    z = ((z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)) & _M64
    return z ^ (z >> np.uint64(31))


def poisson1_weights(ids: np.ndarray, reps: np.ndarray, seed: int) -> np.ndarray:
    """Poisson(1) weight per (row, replicate) from a hash of (seed, rep, id)."""
    with np.errstate(over="ignore"):
        key = (ids.astype(np.uint64)[:, None] * np.uint64(0x100000001B3)
               + reps.astype(np.uint64)[None, :] * np.uint64(0x9E3779B1)
               + np.uint64(seed))
        u = (splitmix64(key) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    cdf = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(20)])
    return np.searchsorted(cdf, u, side="right").astype(np.float64)


class WeightSpec:
    """Per-model row weights: ``kind='folds'`` with arrays ``outer_out``,
    ``inner_out`` (-1 = none) and ``inner_only`` (validation masks), or
    ``kind='bootstrap'`` with ``reps`` and ``seed``."""

    def __init__(self, kind: str, **kw):
        self.kind = kind
        self.kw = {k: np.asarray(v) if isinstance(v, (list, tuple)) else v for k, v in kw.items()}

    def weights(self, pdf: pd.DataFrame) -> np.ndarray:
        if self.kind == "bootstrap":
            return poisson1_weights(pdf["_id"].to_numpy(), self.kw["reps"], self.kw["seed"])
        o = pdf["_outer"].to_numpy()[:, None]
        i = pdf["_inner"].to_numpy()[:, None]
        oo, io, only = self.kw["outer_out"][None, :], self.kw["inner_out"][None, :], self.kw["inner_only"][None, :]
        w = (o != oo)
        w &= np.where(io >= 0, i != io, True)
        w &= np.where(only >= 0, i == only, True)
        return w.astype(np.float64)

    def size(self) -> int:
        return len(self.kw["reps"]) if self.kind == "bootstrap" else len(self.kw["outer_out"])


def _partial_sums(df: DataFrame, fn, width: int) -> np.ndarray:
    """Run ``fn(pdf) -> 1-d float array of length width`` over every Arrow
    batch, sum per partition, then across partitions by an index-keyed
    aggregation; ``width`` numbers reach the driver."""
    def part(it):
        acc = None
        for pdf in it:
            if len(pdf):
                v = fn(pdf)
                acc = v if acc is None else acc + v
        if acc is not None:
            yield pd.DataFrame({"idx": np.arange(width, dtype=np.int64), "val": acc})
    sums = df.mapInPandas(part, "idx long, val double").groupBy("idx").agg(F.sum("val").alias("val")).toArrow()
    out = np.zeros(width)
    out[sums["idx"].to_numpy()] = sums["val"].to_numpy()
    return out


#: Features that may enter a small active set in one pass.
GROW = 16


class Fits(NamedTuple):
    """M fitted models: coefficients (M x d) and intercepts on the standardised
    scale, the means and sds of that scale (M x d), whether each met the
    optimality conditions, the passes made and the numbers sent in each."""

    coefs: np.ndarray
    intercepts: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    converged: np.ndarray
    passes: int
    sent: list[int]


def _scaled(pdf: pd.DataFrame, features: Sequence[str], center: np.ndarray, scale: np.ndarray) -> np.ndarray:
    x = pdf[list(features)].to_numpy(np.float64)
    return np.column_stack([np.ones(len(pdf)), (x - center) / scale])


class _Model:
    """One model between passes: its point, its active set, and the point
    before, to which steps that do not help are cut back."""

    def __init__(self, d: int, start: float, l1: float, l2: float, live: np.ndarray):
        self.theta = np.zeros(d + 1)
        self.theta[0] = start
        self.l1, self.l2, self.live = l1, l2, live
        self.active = np.zeros(0, int)           # positions in theta, without the intercept
        self.best, self.last, self.halved = math.inf, self.theta, 0
        self.slope = self.miss = np.zeros(d + 1)
        self.done = False

    def check(self, loss: float, g: np.ndarray, tol: float) -> bool:
        """Take in the mean loss and its gradient at ``theta``. Whether a step
        is to be solved there: not if the point is optimal, nor if it is worse
        than the one before and half the step comes next."""
        t = self.theta
        value = loss + self.l1 * np.abs(t[1:]).sum() + 0.5 * self.l2 * (t[1:] ** 2).sum()
        if value > self.best + 1e-12 * (1 + abs(self.best)) and self.halved < 40:
            self.theta, self.halved = (t + self.last) / 2, self.halved + 1
            return False
        self.best, self.last, self.halved = value, t, 0
        self.slope = g + self.l2 * np.r_[0.0, t[1:]]
        self.miss = np.where(t != 0, np.abs(self.slope + self.l1 * np.sign(t)), np.maximum(np.abs(self.slope) - self.l1, 0.0))
        self.miss[0] = abs(g[0])
        self.miss[1:][~self.live] = 0.0
        self.done = bool(self.miss.max() < tol)
        return not self.done

    def move(self, solved: np.ndarray, tol: float) -> None:
        """Go to the solved point and choose the features of the next step."""
        t, at = self.theta, np.r_[0, self.active]
        new = t.copy()
        new[at] = solved
        outside = np.ones(len(t), bool)
        outside[at] = False
        entering = np.flatnonzero(outside & (self.miss > tol))
        entering = entering[np.argsort(-self.miss[entering], kind="stable")][:max(GROW, len(self.active))]
        idle = (new[self.active] == 0) & (t[self.active] == 0) & (np.abs(self.slope[self.active]) < 0.9 * self.l1)
        self.active = np.sort(np.r_[self.active[~idle], entering])
        self.theta = new


def fit_batched(data: DataFrame, features: Sequence[str], spec: WeightSpec,
                lam: np.ndarray, alpha: np.ndarray, max_iter: int = 100, tol: float = 1e-7) -> Fits:
    """Fit M = spec.size() penalised logistic regressions. ``lam``/``alpha``
    are length-M arrays (MLlib convention: mean loss + lam (alpha |b|_1 +
    (1 - alpha)/2 |b|^2), intercept free). ``tol`` bounds the optimality
    conditions (a gradient of the mean loss on the standardised scale)."""
    d, m_count = len(features), spec.size()
    data = data.select("_id", "_y", "_outer", "_inner", *features)
    # a common scale first, so that sums of squares keep their digits
    row = data.agg(*[f(F.col(c)) for c in features for f in (F.avg, F.stddev_pop)]).first() if d else ()
    center = np.array([v or 0.0 for v in row[0::2]])
    scale = np.array([v if v and math.isfinite(v) else 1.0 for v in row[1::2]])

    def moments(pdf):
        x, w = _scaled(pdf, features, center, scale), spec.weights(pdf)
        return np.concatenate([(w.T @ x).ravel(), (w.T @ (x * x)).ravel(), w.T @ pdf["_y"].to_numpy(np.float64)])
    sums = _partial_sums(data, moments, m_count * (2 * d + 3))
    first, second = sums[:-m_count].reshape(2, m_count, d + 1)
    n = np.maximum(first[:, 0], 1e-300)
    mean = first[:, 1:] / n[:, None]
    sd = np.sqrt(np.maximum(second[:, 1:] / n[:, None] - mean ** 2, 0.0))
    sd[sd < 1e-9] = 0.0                          # constant in the model's rows
    unit = np.where(sd > 0, sd, 1.0)
    share = np.clip(sums[-m_count:] / n, 1e-9, 1 - 1e-9)
    models = [_Model(d, math.log(share[m] / (1 - share[m])), lam[m] * alpha[m], lam[m] * (1 - alpha[m]), sd[m] > 0)
              for m in range(m_count)]

    sent: list[int] = []
    while len(sent) < max_iter:
        todo = [m for m in range(m_count) if not models[m].done]
        if not todo:
            break
        theta = np.stack([models[m].theta for m in todo])
        raw = theta[:, 1:] / unit[todo]
        raw = np.column_stack([theta[:, 0] - (raw * mean[todo]).sum(axis=1), raw])
        columns = [np.r_[0, models[m].active] for m in todo]
        triangles = [np.triu_indices(len(c)) for c in columns]

        def newton(pdf, todo=todo, raw=raw, columns=columns, triangles=triangles):
            x, y = _scaled(pdf, features, center, scale), pdf["_y"].to_numpy(np.float64)[:, None]
            w = spec.weights(pdf)[:, todo]
            eta = x @ raw.T
            p = np.exp(-np.logaddexp(0, -eta))
            v = w * p * (1 - p)
            seconds = []
            for k, (at, triangle) in enumerate(zip(columns, triangles)):
                xa = x[:, at]
                seconds.append((xa.T @ (xa * v[:, k:k + 1]))[triangle])
            loss = (w * (np.logaddexp(0, eta) - y * eta)).sum(axis=0)
            return np.concatenate([loss, (x.T @ (w * (p - y))).T.ravel(), *seconds])

        width = len(todo) * (d + 2) + sum(len(t[0]) for t in triangles)
        sums = _partial_sums(data, newton, width)
        sent.append(width)
        at, steps = len(todo) * (d + 2), []
        for k, m in enumerate(todo):
            g = sums[len(todo) + k * (d + 1):len(todo) + (k + 1) * (d + 1)] / n[m]
            g = np.r_[g[0], (g[1:] - mean[m] * g[0]) / unit[m]]
            size = len(columns[k])
            h = np.zeros((size, size))
            h[triangles[k]] = sums[at:at + len(triangles[k][0])] / n[m]
            h = h + np.triu(h, 1).T
            at += len(triangles[k][0])
            active = columns[k][1:] - 1
            to_unit = np.diag(np.r_[1.0, 1.0 / unit[m][active]])
            to_unit[1:, 0] = -mean[m][active] / unit[m][active]
            if models[m].check(sums[k] / n[m], g, tol):
                steps.append((models[m], g[columns[k]], to_unit @ h @ to_unit.T))
        for (model, _, _), solved in zip(steps, _solve(steps)):
            model.move(solved, tol)
    theta = np.stack([x.last for x in models]) if models else np.zeros((0, d + 1))
    return Fits(theta[:, 1:], theta[:, 0], center + scale * mean, scale * sd,
                np.array([x.done for x in models], bool), len(sent), sent)


def _solve(steps: list[tuple[_Model, np.ndarray, np.ndarray]], sweeps: int = 1000, tol: float = 1e-13) -> list[np.ndarray]:
    """Coordinate descent on the quadratic models of all steps at once, each
    g'(t - t0) + 1/2 (t - t0)' H (t - t0) + l1 |t|_1 + l2/2 |t|^2 around its
    model's point t0 (index 0, the intercept, is not penalised). Smaller models
    are padded with features that stay 0."""
    if not steps:
        return []
    sizes = [len(g) for _, g, _ in steps]
    k = max(sizes)
    t, lead = np.zeros((len(steps), k)), np.zeros((len(steps), k))
    hess = np.tile(np.eye(k), (len(steps), 1, 1))
    for i, (model, g, h) in enumerate(steps):
        start = model.theta[np.r_[0, model.active]]
        t[i, :sizes[i]], lead[i, :sizes[i]] = start, g - h @ start   # the gradient at t is lead + H t
        hess[i, :sizes[i], :sizes[i]] = h
    l1, l2 = (np.array([getattr(m, name) for m, _, _ in steps]) for name in ("l1", "l2"))
    for _ in range(sweeps):
        big = 0.0
        for j in range(k):
            hjj = hess[:, j, j]
            z = hjj * t[:, j] - lead[:, j] - np.einsum("mk,mk->m", hess[:, j], t)
            if j:
                z, hjj = np.sign(z) * np.maximum(np.abs(z) - l1, 0.0), hjj + l2
            new = np.divide(z, hjj, out=np.zeros_like(z), where=hjj > 0)
            big = max(big, np.abs(new - t[:, j]).max())
            t[:, j] = new
        if big < tol:
            break
    return [t[i, :size] for i, size in enumerate(sizes)]


def scores_long(data: DataFrame, features: Sequence[str], spec: WeightSpec, fits: Fits) -> DataFrame:
    """Linear scores of every model on the rows it weights (validation masks)
    as a long table ``(model, score, y)`` for distributed AUC."""
    eff = fits.coefs / np.where(fits.sd > 0, fits.sd, 1.0)
    c0 = fits.intercepts - (fits.mean * eff).sum(axis=1)

    def fn(it):
        for pdf in it:
            if not len(pdf):
                continue
            s = pdf[list(features)].to_numpy(np.float64) @ eff.T + c0[None, :]
            rr, mm = np.nonzero(spec.weights(pdf) > 0)
            yield pd.DataFrame({"model": mm.astype(np.int64), "score": s[rr, mm],
                                "y": pdf["_y"].to_numpy(np.float64)[rr]})
    return (data.select("_id", "_y", "_outer", "_inner", *features)
            .mapInPandas(fn, "model long, score double, y double"))
