"""Random-intercept logistic regression (M22) in one pass per step.

The marginal likelihood of a group is an integral over its intercept ``u ~
N(0, sigma^2)``, taken by Gauss-Hermite quadrature around the group's own mode
with its own width (adaptive), so the nodes lie where the integrand is whether
a group has two rows or a million. Gradient and second derivatives are
quadratures over the same nodes (Fisher's and Louis' identities), so one pass
over the rows gives all three, and a step of Newton's method in a trust region
costs one pass. At most 1 + D + D (D + 1) / 2 numbers per task reach the driver,
with D features, intercept and log sigma.

Rows are dealt to tasks by group once. A group of more than ``big`` rows is
dealt to several tasks, which send its sums at its nodes; these are added by
Spark and turned into the group's share there. The driver keeps a mode and a
width for each such group, moved one Newton step in each pass.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusdelta.session import cut, target_partitions

#: log sigma is kept at or above this.
LEAST = -8.0


class Sums(NamedTuple):
    """Log-likelihood with its gradient and second derivatives, and the slope
    in sigma^2 at 0."""

    loglik: float
    gradient: np.ndarray
    hessian: np.ndarray
    slope: float


class Fit(NamedTuple):
    theta: np.ndarray            # intercept, coefficients, log sigma (-inf: no variance)
    loglik: float
    converged: bool
    passes: int


class _Nodes:
    def __init__(self, n: int):
        self.z, w = np.polynomial.hermite.hermgauss(n)
        self.log_w = np.log(w) + self.z ** 2 + 0.5 * math.log(2)


def _log1pexp(x):
    return np.logaddexp(0, x)


def _sigmoid(x):
    return np.exp(-_log1pexp(-x))


def _modes(eta, y, starts, sizes, sigma):
    """Mode and width of each group's integrand."""
    u = np.zeros(len(starts))
    for _ in range(30):
        p = _sigmoid(eta + np.repeat(u, sizes))
        slope = np.add.reduceat(y - p, starts) - u / sigma ** 2
        curve = np.add.reduceat(p * (1 - p), starts) + 1 / sigma ** 2
        step = np.clip(slope / curve, -3, 3)
        u += step
        if np.abs(step).max() < 1e-10:
            break
    p = _sigmoid(eta + np.repeat(u, sizes))
    return u, 1 / np.sqrt(np.add.reduceat(p * (1 - p), starts) + 1 / sigma ** 2)


def _close_groups(lp, score, second, u, sigma, nodes, width):
    """From sums at the nodes to log-likelihoods, posteriors and derivatives of
    whole groups. ``lp``: G x Q, ``score``: G x (d+1) x Q; ``second(post)``: the
    sum of x x' p (1 - p) under the posterior weights."""
    log_f = lp - 0.5 * (u / sigma) ** 2 - math.log(sigma * math.sqrt(2 * math.pi)) + nodes.log_w + np.log(width)[:, None]
    top = log_f.max(axis=1, keepdims=True)
    ll = top[:, 0] + np.log(np.exp(log_f - top).sum(axis=1))
    post = np.exp(log_f - ll[:, None])
    s = np.concatenate([score, ((u / sigma) ** 2 - 1)[:, None, :]], axis=1)          # G x D x Q
    mean = (s * post[:, None, :]).sum(axis=2)
    flat = (s * np.sqrt(post)[:, None, :]).transpose(0, 2, 1).reshape(-1, s.shape[1])
    hessian = flat.T @ flat - mean.T @ mean
    hessian[:-1, :-1] -= second(post)
    hessian[-1, -1] -= 2 * (post * u ** 2).sum() / sigma ** 2
    return ll.sum(), mean.sum(axis=0), hessian


def _runs(batches):
    """Whole runs of a group's rows, which may reach over batches."""
    rest = None
    for pdf in batches:
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        last = pdf.iloc[-1]
        same = (pdf["_g"].isna() if pd.isna(last["_g"]) else pdf["_g"] == last["_g"]) & (pdf["_sub"] == last["_sub"])
        at = int(len(pdf) - same.to_numpy()[::-1].argmin()) if not same.all() else 0
        if at:
            yield pdf.iloc[:at]
        rest = pdf.iloc[at:]
    if rest is not None and len(rest):
        yield rest


class Rows:
    """The rows of a model, dealt by group."""

    def __init__(self, df: DataFrame, features: Sequence[str], label: str, group: str, nodes: int = 15, big: int = 65_536):
        self.features, self.nodes = list(features), _Nodes(nodes)
        self.d1 = len(self.features) + 1
        data = cut(df.select(F.col(group).alias("_g"), F.col(label).cast("double").alias("_y"),
                             *[F.col(f).cast("double").alias(f) for f in features]))
        large = data.groupBy("_g").agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > big)
        large = cut(large.select(F.col("_g").alias("_l"), F.ceil(F.col("_size") / big).alias("_parts")))
        rows = data.withColumn("_row", F.monotonically_increasing_id())
        rows = rows.join(large, rows["_g"].eqNullSafe(large["_l"]), "left")
        rows = rows.withColumn("_sub", F.coalesce(F.pmod("_row", "_parts"), F.lit(0))).withColumn("_split", F.col("_parts").isNotNull())
        n = target_partitions(df.sparkSession)
        self.data = cut(rows.select("_g", "_sub", "_split", "_y", *self.features).repartition(n, "_g", "_sub")
                        .sortWithinPartitions("_g", "_sub"))
        self.kind = data.schema["_g"].dataType.simpleString()
        self.modes: dict = {r["_l"]: (0.0, 1.0, math.inf) for r in large.select("_l").collect()}

    def sums(self, theta: np.ndarray) -> Sums:
        """One pass. ``theta[-1]`` is log sigma; -inf leaves the variance out."""
        d1, nodes, features, modes = self.d1, self.nodes, self.features, self.modes
        beta, sigma = theta[:-1], math.exp(theta[-1])
        q, tri = len(nodes.z), np.triu_indices(d1)
        size = 1 + (d1 + 1) + (d1 + 1) ** 2 + 1

        def plain(x, y, eta):
            p = _sigmoid(eta)
            h = np.zeros((d1 + 1, d1 + 1))
            h[:-1, :-1] = -(x * (p * (1 - p))[:, None]).T @ x
            return np.concatenate([[(y * eta - _log1pexp(eta)).sum()], x.T @ (y - p), [0.0], h.ravel(), [0.0]])

        def whole(x, y, eta, starts, sizes):
            u0, width = _modes(eta, y, starts, sizes, sigma)
            u = u0[:, None] + math.sqrt(2) * width[:, None] * nodes.z
            at = eta[:, None] + np.repeat(u, sizes, axis=0)
            p = _sigmoid(at)
            lp = np.add.reduceat(y[:, None] * at - _log1pexp(at), starts, axis=0)
            r = y[:, None] - p
            score = np.stack([np.add.reduceat(x[:, j:j + 1] * r, starts, axis=0) for j in range(d1)], axis=1)
            v = p * (1 - p)

            def second(post):
                return (x * (v * np.repeat(post, sizes, axis=0)).sum(axis=1)[:, None]).T @ x
            ll, g, h = _close_groups(lp, score, second, u, sigma, nodes, width)
            p0 = _sigmoid(eta)
            slope = 0.5 * (np.add.reduceat(y - p0, starts) ** 2 - np.add.reduceat(p0 * (1 - p0), starts)).sum()
            return np.concatenate([[ll], g, h.ravel(), [slope]])

        def part(x, y, eta, key):
            """A split group's sums at its nodes."""
            u0, width, _ = modes[key]
            at = eta[:, None] + u0 + math.sqrt(2) * width * nodes.z
            p = _sigmoid(at)
            v = p * (1 - p)
            seconds = [((x * v[:, k:k + 1]).T @ x)[tri] for k in range(q)]
            pu, p0 = _sigmoid(eta + u0), _sigmoid(eta)
            ends = [(y - pu).sum(), (pu * (1 - pu)).sum(), (y - p0).sum(), (p0 * (1 - p0)).sum()]
            return np.concatenate([(y[:, None] * at - _log1pexp(at)).sum(axis=0), (x.T @ (y[:, None] - p)).ravel(), *seconds, ends])

        def run(batches):
            total, parts = np.zeros(size), {}
            for pdf in _runs(batches):
                x = np.column_stack([np.ones(len(pdf)), pdf[features].to_numpy(np.float64)])
                y, eta = pdf["_y"].to_numpy(np.float64), x @ beta
                if not sigma:
                    total += plain(x, y, eta)
                    continue
                key = pdf["_g"].astype(object).where(pdf["_g"].notna(), None)
                new = np.r_[True, (key.to_numpy()[1:] != key.to_numpy()[:-1]) | (pdf["_sub"].to_numpy()[1:] != pdf["_sub"].to_numpy()[:-1])]
                starts = np.flatnonzero(new)
                sizes = np.diff(np.r_[starts, len(pdf)])
                split = pdf["_split"].to_numpy()[starts]
                for s, n in zip(starts[split], sizes[split]):
                    rows, k = slice(s, s + n), key.iloc[s]
                    parts[k] = parts.get(k, 0.0) + part(x[rows], y[rows], eta[rows], k)
                if not split.all():
                    mine = np.repeat(~split, sizes)
                    kept = sizes[~split]
                    total += whole(x[mine], y[mine], eta[mine], np.r_[0, np.cumsum(kept)[:-1]], kept)
            yield pd.DataFrame({"_g": [None] * size, "split": False, "place": np.arange(size), "val": total})
            for k, v in parts.items():
                yield pd.DataFrame({"_g": [k] * len(v), "split": True, "place": np.arange(len(v)), "val": v})

        sent = self.data.mapInPandas(run, f"_g {self.kind}, split boolean, place int, val double")
        added = sent.groupBy("split", "_g", "place").agg(F.sum("val").alias("val"))
        if not (modes and sigma):
            total = np.zeros(size)
            for r in added.collect():
                total[r["place"]] = r["val"]
        else:
            total = self._with_split(added, beta, sigma, size)
        return Sums(total[0], total[1:d1 + 2], total[d1 + 2:-1].reshape(d1 + 1, d1 + 1), total[-1])

    def _with_split(self, added: DataFrame, beta: np.ndarray, sigma: float, size: int) -> np.ndarray:
        """Turn the added sums of split groups into their share, and move their
        modes a step."""
        d1, nodes, modes = self.d1, self.nodes, self.modes
        q, tri = len(nodes.z), np.triu_indices(d1)

        def close(batches):
            for pdf in batches:
                for key, split, sums in zip(pdf["_g"], pdf["split"], pdf["sums"]):
                    v = np.array([s["val"] for s in sums])
                    if not split:
                        yield pd.DataFrame({"_g": [None], "v": [v], "slope": [0.0], "curve": [0.0]})
                        continue
                    u0, width, _ = modes[None if pd.isna(key) else key]
                    lp, score = v[:q], v[q:q + q * d1].reshape(d1, q)
                    half = v[q + q * d1:-4].reshape(q, -1)

                    def second(post):
                        h = np.zeros((d1, d1))
                        h[tri] = post[0] @ half
                        return h + np.triu(h, 1).T
                    u = (u0 + math.sqrt(2) * width * nodes.z)[None, :]
                    ll, g, h = _close_groups(lp[None, :], score[None, :, :], second, u, sigma, nodes, np.array([width]))
                    out = np.concatenate([[ll], g, h.ravel(), [0.5 * (v[-2] ** 2 - v[-1])]])
                    yield pd.DataFrame({"_g": [key], "v": [out], "slope": [v[-4] - u0 / sigma ** 2], "curve": [v[-3] + 1 / sigma ** 2]})
        lists = added.groupBy("split", "_g").agg(F.array_sort(F.collect_list(F.struct("place", "val"))).alias("sums"))
        total = np.zeros(size)
        for r in lists.mapInPandas(close, f"_g {self.kind}, v array<double>, slope double, curve double").collect():
            total += np.array(r["v"])
            if r["curve"]:
                step = float(np.clip(r["slope"] / r["curve"], -3, 3))
                u0 = modes[r["_g"]][0]
                modes[r["_g"]] = (u0 + step, 1 / math.sqrt(r["curve"]), abs(step) * math.sqrt(r["curve"]))
        return total

    def settled(self) -> bool:
        """Whether the modes of split groups have come to rest."""
        return all(gap < 1e-3 for _, _, gap in self.modes.values())


def _step(g: np.ndarray, h: np.ndarray, radius: float) -> np.ndarray:
    """The least of the quadratic ``g't + t'Ht/2`` within ``radius``."""
    values, vectors = np.linalg.eigh((h + h.T) / 2)
    gv = vectors.T @ g
    low = max(0.0, -values.min() + 1e-12)

    def at(shift):
        return -vectors @ (gv / (values + shift))
    if values.min() > 1e-12 and np.linalg.norm(at(0.0)) <= radius:
        return at(0.0)
    high = low + 1.0
    while np.linalg.norm(at(high)) > radius:
        high = low + 2 * (high - low)
    lo = low
    for _ in range(100):
        mid = (lo + high) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            far = not np.linalg.norm(at(mid)) <= radius
        lo, high = (mid, high) if far else (lo, mid)
    return at(high)


def _newton(rows: Rows, theta: np.ndarray, free: np.ndarray, passes: int, max_iter: int, tol: float) -> tuple[np.ndarray, Sums, bool, int]:
    """Maximise over the ``free`` parameters: one pass for each step tried."""
    now = rows.sums(theta)
    passes += 1
    radius, n = 1.0, max(1.0, abs(now.loglik))
    while True:
        g, h = -now.gradient[free], -now.hessian[np.ix_(free, free)]
        if np.abs(g).max() < tol * n and rows.settled():
            return theta, now, True, passes
        if passes >= max_iter:
            return theta, now, False, passes
        move = np.zeros(len(theta))
        move[free] = _step(g, h, radius)
        if free[-1] and theta[-1] + move[-1] < LEAST:
            move[-1] = LEAST - theta[-1]
        there = rows.sums(theta + move)
        passes += 1
        promised = -(g @ move[free] + 0.5 * move[free] @ h @ move[free])
        gained = there.loglik - now.loglik
        noise = 1e-10 * n
        if gained < -noise and rows.settled():
            radius = 0.25 * min(radius, float(np.linalg.norm(move)))
            if radius < 1e-10:
                return theta, now, False, passes
            continue
        if promised > 0 and gained > 0.75 * promised:
            radius = min(max(radius, 2 * float(np.linalg.norm(move))), 100.0)
        theta, now = theta + move, there


def fit(rows: Rows, max_iter: int = 60, tol: float = 1e-8) -> Fit:
    """Maximum marginal likelihood. Where the variance runs to 0 and the
    likelihood falls in it from there, the model without one is fitted."""
    theta = np.zeros(rows.d1 + 1)
    theta[-1] = -math.inf                       # the plain model first: a good start, and the boundary
    beta = np.arange(rows.d1 + 1) < rows.d1
    theta, at_zero, plain_done, passes = _newton_plain(rows, theta, beta, max_iter, tol)
    start = theta.copy()
    start[-1] = math.log(0.5)
    found, now, done, passes = _newton(rows, start, np.ones(rows.d1 + 1, bool), passes, passes + max_iter, tol)
    if now.slope <= 0 and (now.loglik <= at_zero.loglik + 1e-9 * max(1.0, abs(at_zero.loglik)) or found[-1] < math.log(0.05)):
        return Fit(theta, at_zero.loglik, plain_done, passes)
    return Fit(found, now.loglik, done, passes)


def _newton_plain(rows: Rows, theta: np.ndarray, free: np.ndarray, max_iter: int, tol: float):
    """Newton's method without the variance (the modes play no part)."""
    kept, rows.modes = rows.modes, {}
    try:
        return _newton(rows, theta, free, 0, max_iter, tol)
    finally:
        rows.modes = kept
