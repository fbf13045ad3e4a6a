"""Exact neighbour search over balls of vectors (T3 beyond a few blocks).

Vectors are dealt to the nearest of as many centres as there are blocks, at most
``BALLS``. What a ball can offer a vector ``x`` is bounded: ``x.y <= x.c + |x|
radius``, and for unit vectors by the cosine of the angle to the centre less the
ball's. Balls that lie together form portions of at most ``PORTION_BYTES`` (a ball
that holds more than a block is cut by the hash of the word). Every portion first
meets itself, which gives each vector a k-th best value; then a vector asks only
the portions with a ball whose bound reaches it, and two portions between which
nobody asks are never shipped. Inside a portion, or a pair of them, the bounds
choose the balls to multiply with. The result is exact for any vectors; how much
is saved depends on how clustered they are (``scored_share``).

What is shipped at worst is every vector once for each portion: few, as only
their memory is bounded, not the matrices of products, which are made a few rows
and columns at a time. What the driver holds is bounded: a centre, a radius and a
size of each ball, and the blocks of all.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusdelta.session import cut

#: Slack of the bounds, far above the rounding of a dot product or an angle.
SLACK = 1e-6
#: Bounds of what is held at once: balls, blocks that balls are cut into, bytes of
#: the vectors of a portion, rows and columns of a matrix of products; and the
#: portions that share the work at least.
BALLS, BLOCKS, PORTION_BYTES, ROWS, COLUMNS, PORTIONS = 1024, 4096, 32 << 20, 512, 4096, 8


def best_of(sims: np.ndarray, words: np.ndarray, others: np.ndarray, k: int) -> pd.DataFrame:
    """The k highest columns of each row, without those at -inf."""
    if not sims.size:
        return pd.DataFrame({"w": [], "nb": [], "sim": []})
    kk = min(k, sims.shape[1])
    if kk < sims.shape[1]:
        idx = np.argpartition(-sims, kk - 1, axis=1)[:, :kk]
        # ties at the k-th value go to the smaller word
        for r in np.flatnonzero((sims >= np.take_along_axis(sims, idx, axis=1).min(axis=1, keepdims=True)).sum(axis=1) > kk):
            idx[r] = np.lexsort((others.astype(str), -sims[r]))[:kk]
    else:
        idx = np.tile(np.arange(sims.shape[1]), (sims.shape[0], 1))
    top = np.take_along_axis(sims, idx, axis=1)
    keep = np.isfinite(top).ravel()
    rows = np.repeat(np.arange(len(words)), idx.shape[1])[keep]
    return pd.DataFrame({"w": words[rows], "nb": others[idx.ravel()[keep]], "sim": top.ravel()[keep]})


def top_k(candidates: DataFrame, k: int) -> DataFrame:
    """``(w, rank, nb, sim)``: rank <= k is planned with a partial
    WindowGroupLimit, so every map task ships at most k rows per word."""
    w = Window.partitionBy("w").orderBy(F.col("sim").desc(), F.col("nb"))
    return candidates.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(np.float64)


def _slices(rows: int, width: int):
    """Slices of ``rows`` rows so that a matrix of ``width`` columns stays small."""
    step = max(1, (1 << 21) // max(width, 1))
    return [slice(at, at + step) for at in range(0, rows, step)]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    size = (centres * centres).sum(axis=1)
    return np.concatenate([np.argmin(size - 2 * (x[at] @ centres.T), axis=1) for at in _slices(len(x), len(centres))])


class Bounds:
    """The balls: a centre, a radius and an angle of each (``unit``: whether all
    of its vectors have length 1)."""

    def __init__(self, centres: np.ndarray, far: np.ndarray, angle: np.ndarray, unit: np.ndarray):
        self.centres, self.far, self.angle, self.unit = centres, far, angle, unit

    def __call__(self, x: np.ndarray, balls: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The most that a vector of each of ``balls`` can give each row of ``x``."""
        centres = self.centres[balls]
        size = np.linalg.norm(x, axis=1, keepdims=True)
        dots = x @ centres.T
        most = dots + size * self.far[balls]
        across = np.linalg.norm(centres, axis=1)
        angle = np.arccos(np.clip(dots / np.maximum(size * across, 1e-300), -1, 1))
        by_angle = np.cos(np.maximum(0.0, angle - self.angle[balls] - SLACK))
        usable = (np.abs(size - 1) < 1e-9) & self.unit[balls]
        most = np.where(usable, np.minimum(most, by_angle), most)
        return most + SLACK * np.maximum(1.0, np.abs(most))


def _first(r: np.ndarray, c: np.ndarray, s: np.ndarray, k: int) -> tuple:
    """The k highest products of each row, ties to the smaller column, in order
    of row and rank; and each one's rank from 0."""
    order = np.lexsort((c, -s, r))
    r, c, s = r[order], c[order], s[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    keep = rank < k
    return r[keep], c[keep], s[keep], rank[keep]


def _reaching(x: np.ndarray, y: np.ndarray, floor: np.ndarray) -> tuple:
    """(row of ``x``, row of ``y``, product) of all products that reach the row's
    ``floor``. Single precision, with its error allowed for, finds those worth an
    exact product; too many of them (or odd sizes) are multiplied whole."""
    size, most = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1).max()
    if 1e-12 < most < 1e12 and size.max() < 1e12:
        slack = (x.shape[1] + 8) * 2.0 ** -23 * size * most + 1e-30
        low = np.nextafter((floor - slack).astype(np.float32), np.float32(-np.inf))
        r, c = np.nonzero(x.astype(np.float32) @ y.astype(np.float32).T >= low[:, None])
        if len(r) <= 64 * len(x):
            s = np.einsum("ij,ij->i", x[r], y[c])
            keep = s >= floor[r]
            return r[keep], c[keep], s[keep]
    sims = x @ y.T
    r, c = np.nonzero(sims >= floor[:, None])
    return r, c, sims[r, c]


def best_between(x: pd.DataFrame, y: pd.DataFrame, bounds: Bounds, k: int) -> tuple:
    """(row of ``x``, row of ``y``, product) of the k best rows of ``y`` for each
    row of ``x``, of those that reach its ``kth``. ``y`` is in order of words.
    The rows' own balls come first and raise what other balls must reach."""
    xm, ym, xw, yw = _matrix(x.v), _matrix(y.v), x.w.to_numpy(), y.w.to_numpy()
    xb, yb, kth = x.ball.to_numpy(), y.ball.to_numpy(), x.kth.to_numpy(np.float64)
    balls, place = np.unique(yb, return_inverse=True)
    out = []
    for at in range(0, len(xm), ROWS):
        part, words, need = xm[at:at + ROWS], xw[at:at + ROWS], np.nan_to_num(kth[at:at + ROWS], nan=-np.inf)
        last = np.full(len(part), len(ym))          # column of the k-th best found
        found = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        own = np.isin(balls, xb[at:at + ROWS])
        for home in (True, False):
            wanted = own if home else (bounds(part, balls) >= need[:, None]).any(axis=0) & ~own
            columns, width, start = np.flatnonzero(wanted[place]), 256, 0
            while start < len(columns):
                cols = columns[start:start + width]
                # a later word must exceed the k-th best, an earlier one may equal it
                r, c, s = _reaching(part, ym[cols], np.where(last < cols[0], np.nextafter(need, np.inf), need))
                other = words[r] != yw[cols[c]]
                found = tuple(map(np.concatenate, zip(found, (r[other], cols[c[other]], s[other]))))
                start, width = start + width, COLUMNS
                if len(found[0]) > 2 * k * len(part) or start >= len(columns):
                    *found, rank = _first(*found, k)
                    full = rank == k - 1
                    need[found[0][full]], last[found[0][full]] = found[2][full], found[1][full]
        out.append((found[0] + at, found[1], found[2]))
    return tuple(map(np.concatenate, zip(*out)))


def portions(centres: np.ndarray, sizes: np.ndarray, limit: float, least: int) -> np.ndarray:
    """A portion for each block: blocks are halved across their widest direction
    until ``least`` portions and at most ``limit`` rows in each."""
    groups = [np.arange(len(sizes))]
    while True:
        at = max(range(len(groups)), key=lambda i: sizes[groups[i]].sum() if len(groups[i]) > 1 else 0)
        g = groups[at]
        if len(g) == 1 or (sizes[g].sum() <= limit and len(groups) >= least):
            break
        c = centres[g] - centres[g].mean(axis=0)
        order = g[np.argsort(c @ np.linalg.eigh(c.T @ c)[1][:, -1], kind="stable")]
        total = np.cumsum(sizes[order])
        half = min(max(int(np.searchsorted(total, total[-1] / 2)), 1), len(g) - 1)
        groups[at:at + 1] = [order[:half], order[half:]]
    out = np.zeros(len(sizes), int)
    for i, g in enumerate(groups):
        out[g] = i
    return out


class BallIndex:
    """``vectors``: ``(w string, v array<double>)``, words unique; read several times."""

    def __init__(self, vectors: DataFrame, block_rows: int = 2048, min_blocks: int = 4):
        self.vectors, self.spark = vectors.select("w", "v"), vectors.sparkSession
        self.n = self.vectors.count()
        b = min(self.n, max(min_blocks, min(BALLS, math.ceil(self.n / max(block_rows, 1)))))
        if not self.n:
            return
        self.block_rows = max(block_rows, math.ceil(self.n / BLOCKS))
        pivots = self.vectors.orderBy(F.xxhash64("w"), "w").limit(b).collect()     # at most BALLS
        self.centres = np.array([r.v for r in pivots], dtype=np.float64)
        self._refine()
        self._assign()

    def _refine(self) -> None:
        """One step towards the means of the balls: sums by ball in each task."""
        centres, (b, d) = self.centres, self.centres.shape

        def sums(batches):
            total, count = np.zeros((b, d)), np.zeros(b)
            for pdf in batches:
                if len(pdf):
                    x = _matrix(pdf.v)
                    ball = _nearest(x, centres)
                    np.add.at(total, ball, x)
                    count += np.bincount(ball, minlength=b)
            some = np.flatnonzero(count)
            yield pd.DataFrame({"ball": np.repeat(some, d + 1), "place": np.tile(np.arange(d + 1), len(some)),
                                "val": np.column_stack([total, count])[some].ravel()})
        got = (self.vectors.select("v").mapInPandas(sums, "ball long, place long, val double")
               .groupBy("ball", "place").agg(F.sum("val").alias("val")).toPandas())
        total = np.zeros((b, d + 1))
        total[got.ball, got.place] = got.val
        some = total[:, d] > 0
        self.centres[some] = total[some, :d] / total[some, d:]

    def _assign(self) -> None:
        """The balls' bounds, blocks of about ``block_rows`` vectors, portions of blocks."""
        centres = self.centres

        def assign(batches):
            for pdf in batches:
                if len(pdf):
                    x = _matrix(pdf.v)
                    ball = _nearest(x, centres)
                    c = centres[ball]
                    size, across = np.linalg.norm(x, axis=1), np.linalg.norm(c, axis=1)
                    cosine = (x * c).sum(axis=1) / np.maximum(size * across, 1e-300)
                    yield pdf.assign(ball=ball, far=np.linalg.norm(x - c, axis=1), angle=np.arccos(np.clip(cosine, -1, 1)),
                                     unit=(np.abs(size - 1) < 1e-9) & (across > 1e-9))
        rows = cut(self.vectors.mapInPandas(assign, "w string, v array<double>, ball int, far double, angle double, unit boolean"))
        balls = rows.groupBy("ball").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far"), F.max("angle").alias("angle"),
                                         F.min("unit").alias("unit")).orderBy("ball").toPandas()
        b, d = centres.shape
        far, angle, unit, self.sizes = np.zeros(b), np.zeros(b), np.ones(b, bool), np.zeros(b, int)
        far[balls.ball], angle[balls.ball], unit[balls.ball], self.sizes[balls.ball] = balls.far, balls.angle, balls.unit, balls.n
        self.bounds = Bounds(centres, far, angle, unit)
        parts = np.ceil(balls.n / self.block_rows).astype(int).to_numpy()
        ball = np.repeat(balls.ball.to_numpy(), parts)
        self.blocks = len(ball)
        portion = portions(centres[ball], np.repeat(balls.n.to_numpy() / parts, parts), max(1, PORTION_BYTES // (8 * d)), PORTIONS)
        self.held = np.zeros((b, portion.max() + 1))        # which portions hold some of a ball
        self.held[ball, portion] = 1
        table = self.spark.createDataFrame(
            [(int(x), int(y), portion[ball == x].tolist()) for x, y in zip(balls.ball, parts)], "ball int, parts long, of array<int>")
        self.rows = rows.join(F.broadcast(table), "ball").select(
            "w", "v", "ball", F.get("of", F.pmod(F.xxhash64("w"), F.col("parts")).cast("int")).alias("portion"))

    def search(self, k: int) -> DataFrame:
        """``(w, rank, nb, sim)``, exact; ties to the smaller word."""
        if not self.n:
            return self.spark.createDataFrame([], "w string, rank long, nb string, sim double")
        bounds = self.bounds

        def meet_itself(pdf: pd.DataFrame) -> pd.DataFrame:
            x = pdf.sort_values("w", ignore_index=True)
            by_ball = x.assign(kth=np.nan).sort_values("ball", kind="stable", ignore_index=True)
            r, c, s = best_between(by_ball, x, bounds, k)
            count = np.bincount(r, minlength=len(x))
            ends = np.cumsum(count)[:-1]
            kth = np.full(len(x), np.nan)
            kth[count == k] = s[np.cumsum(count)[count == k] - 1]
            return by_ball.assign(kth=kth, nb=np.split(x.w.to_numpy()[c], ends), sim=np.split(s, ends))

        def meet(pdf: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({"w": [], "nb": [], "sim": []})]
            left, right = (pdf[side].sort_values("w") for side in (~pdf.right, pdf.right))
            for mine, theirs in ((left, right), (right, left)):
                mine, theirs = mine[mine.asks].sort_values("ball", kind="stable"), theirs[theirs.offers]
                if len(mine) and len(theirs):
                    r, c, s = best_between(mine, theirs, bounds, k)
                    out.append(pd.DataFrame({"w": mine.w.to_numpy()[r], "nb": theirs.w.to_numpy()[c], "sim": s}))
            return pd.concat(out)
        self.known = cut(self.rows.groupBy("portion").applyInPandas(
            meet_itself, "w string, v array<double>, ball int, portion int, kth double, nb array<string>, sim array<double>"))
        known = self.known.select("w", F.explode(F.arrays_zip("nb", "sim")).alias("x")).select("w", "x.nb", "x.sim")
        more = self.shipped().groupBy("pair").applyInPandas(meet, "w string, nb string, sim double")
        return top_k(known.unionByName(more), k)

    def _asked(self) -> DataFrame:
        """Each vector with the portions that it asks after the first round, and
        the number of vectors in the balls that its bounds leave."""
        bounds, held, sizes = self.bounds, self.held, self.sizes

        def ask(batches):
            for pdf in batches:
                for at in _slices(len(pdf), len(sizes)):
                    some = pdf.iloc[at]
                    wanted = bounds(_matrix(some.v)) >= some.kth.fillna(-np.inf).to_numpy()[:, None]
                    asks = wanted @ held > 0
                    asks[np.arange(len(some)), some.portion] = False
                    yield some.assign(asks=[np.flatnonzero(r) for r in asks], reach=wanted @ sizes)
        return self.known.select("w", "v", "ball", "portion", "kth").mapInPandas(
            ask, "w string, v array<double>, ball int, portion int, kth double, asks array<int>, reach long")

    def _askers(self) -> DataFrame:
        """Each ball with the portions that ask it."""
        bounds, shape = self.bounds, self.held.shape[::-1]

        def ask(batches):
            asked = np.zeros(shape, bool)
            for pdf in batches:
                for portion, own in pdf.groupby("portion"):
                    for at in _slices(len(own), shape[1]):
                        some = own.iloc[at]
                        asked[portion] |= (bounds(_matrix(some.v)) >= some.kth.fillna(-np.inf).to_numpy()[:, None]).any(axis=0)
            by, ball = np.nonzero(asked)
            yield pd.DataFrame({"ball": ball, "by": by})
        pairs = self.known.select("v", "portion", "kth").mapInPandas(ask, "ball int, by int")
        return pairs.groupBy("ball").agg(F.collect_set("by").alias("by"))

    def shipped(self) -> DataFrame:
        """What the second round ships: a row once for each pair of portions in
        which it asks or is asked."""
        p, other = self.held.shape[1], F.col("other")
        rows = self._asked().join(F.broadcast(self._askers()), "ball", "left").withColumn(
            "by", F.array_remove(F.coalesce("by", F.array().cast("array<int>")), F.col("portion")))
        return (rows.select("w", "v", "ball", "portion", "kth", "asks", "by", F.explode(F.array_union("asks", "by")).alias("other"))
                .select((F.least("portion", other).cast("long") * p + F.greatest("portion", other)).alias("pair"),
                        (F.col("portion") > other).alias("right"), "w", "v", "ball", "kth",
                        F.array_contains("asks", other).alias("asks"), F.array_contains("by", other).alias("offers")))

    def scored_share(self) -> float:
        """Share of all pairs of vectors that the bounds leave to ``search``."""
        return self._asked().agg(F.sum("reach")).first()[0] / self.n ** 2
