"""k-means of many targets at once.

All targets share one table of centres, and every pass over the vectors serves
all of them: each task assigns its rows to the centres of their own target and
sends sums by target and centre. No task needs a target's vectors together, so
neither many targets nor a large one is a problem. ``restarts`` independent
starts run in the same passes, and each target keeps its best one.

The table of centres is what the driver holds and the tasks receive; targets
are worked on in lots whose table has at most ``TABLE_BYTES``.

Seeds are drawn one per pass by squared distance (k-means++): a row's key is
exponential with its squared distance as rate, and the least key wins, so the
draw needs only a minimum per target.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusdelta.operators.batched_logit import splitmix64
from corpusdelta.session import cut

#: Bound of the table of centres of a lot, and rows that are compared at once.
TABLE_BYTES, ROWS = 64 << 20, 2048


def _uniform(ids: np.ndarray, *salts: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the row and the salts alone."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.int64).view(np.uint64)
        for s in salts:
            h = splitmix64(h ^ splitmix64(np.array([s], np.uint64)))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _squared(x: np.ndarray, t: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to their target's centres: rows x restarts x
    centres (infinite where a centre is missing)."""
    c = centres[t]
    d = ((x[:, None, None, :] - c) ** 2).sum(axis=3)
    return np.where(np.isnan(d), np.inf, d)


def _slices(batches):
    for pdf in batches:
        for at in range(0, len(pdf), ROWS):
            part = pdf.iloc[at:at + ROWS]
            yield part, np.vstack(part["vec"].to_numpy()).astype(np.float64), part["t"].to_numpy()


class Lot:
    """The targets numbered from ``first`` on whose centres fit one table."""

    def __init__(self, rows: DataFrame, first: int, n: int, d: int, k: int, restarts: int, seed: int):
        self.rows = rows.select("id", (F.col("t") - first).cast("int").alias("t"), "vec")
        self.spark, self.n, self.d, self.k, self.restarts, self.seed = rows.sparkSession, n, d, k, restarts, seed
        self.centres = np.full((n, restarts, k, d), np.nan)

    def _shared(self, value):
        return self.spark.sparkContext.broadcast(value)

    def draw(self, place: int) -> None:
        """One more centre for each target and restart."""
        shared, seed, restarts = self._shared(self.centres), self.seed, self.restarts

        def run(batches):
            best: dict = {}
            for _, x, t, ids in ((p, x, t, p["id"].to_numpy()) for p, x, t in _slices(batches)):
                rate = _squared(x, t, shared.value).min(axis=2) if place else np.ones((len(x), restarts))
                for r in range(restarts):
                    with np.errstate(divide="ignore"):
                        key = -np.log(_uniform(ids, seed, r, place)) / rate[:, r]
                    order = np.lexsort((ids, key))
                    for i in order[np.unique(t[order], return_index=True)[1]].tolist():
                        if rate[i, r] > 0:
                            found = (key[i], int(ids[i]))
                            if (t[i], r) not in best or found < best[t[i], r][:2]:
                                best[t[i], r] = (*found, x[i].tolist())
            rows = [(int(t), r, *v) for (t, r), v in best.items()]
            yield pd.DataFrame(rows, columns=["t", "r", "key", "id", "vec"])
        drawn = self.rows.mapInPandas(run, "t int, r int, key double, id long, vec array<double>")
        for row in drawn.groupBy("t", "r").agg(F.min_by("vec", F.struct("key", "id")).alias("vec")).collect():
            self.centres[row["t"], row["r"], place] = row["vec"]
        shared.destroy()

    def step(self, moving: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Means of the rows of each centre and the inertia of each restart, for
        the targets and restarts that still move."""
        shared, d, k = self._shared((self.centres, moving)), self.d, self.k

        def run(batches):
            centres, moving = shared.value
            sums: dict = {}
            for _, x, t in _slices(batches):
                some = moving[t].any(axis=1)
                if not some.any():
                    continue
                x, t = x[some], t[some]
                squared = _squared(x, t, centres)
                nearest, least = squared.argmin(axis=2), squared.min(axis=2)
                extended = np.column_stack([x, np.ones(len(x))])
                for r in range(centres.shape[1]):
                    group = t.astype(np.int64) * k + nearest[:, r]
                    groups, place = np.unique(group, return_inverse=True)
                    total = np.zeros((len(groups), d + 2))
                    np.add.at(total, place, np.column_stack([extended, least[:, r]]))
                    for g, v in zip(groups.tolist(), total):
                        if moving[g // k, r]:
                            sums[g // k, r, g % k] = sums.get((g // k, r, g % k), 0.0) + v
            yield pd.DataFrame([(*key, v.tolist()) for key, v in sums.items()], columns=["t", "r", "c", "sums"])
        parts = self.rows.mapInPandas(run, "t int, r int, c int, sums array<double>")
        added = parts.groupBy("t", "r", "c").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(d + 2)]).toPandas()
        total = np.zeros((*self.centres.shape[:3], d + 2))
        total[added["t"], added["r"], added["c"]] = added[[f"s{i}" for i in range(d + 2)]].to_numpy()
        shared.destroy()
        some = total[..., d] > 0
        means = self.centres.copy()
        means[some] = total[some][:, :d] / total[some][:, d:d + 1]
        return means, total[..., d + 1].sum(axis=2)

    def fit(self, max_iter: int) -> np.ndarray:
        """Centres of the best restart of each target; passes are counted."""
        for place in range(self.k):
            self.draw(place)
        moving = np.ones((self.n, self.restarts), bool)
        inertia = np.full((self.n, self.restarts), np.inf)
        self.passes = self.k
        for _ in range(max_iter):
            means, now = self.step(moving)
            self.passes += 1
            inertia = np.where(moving, now, inertia)
            still = ~np.isclose(means, self.centres, equal_nan=True).all(axis=(2, 3))
            self.centres = np.where(moving[:, :, None, None], means, self.centres)
            moving &= still
            if not moving.any():
                break
        self.inertia = inertia.min(axis=1)
        return self.centres[np.arange(self.n), inertia.argmin(axis=1)]

    def assign(self, best: np.ndarray) -> DataFrame:
        """``(id, clust, dist)``: the nearest centre, and the cosine distance to it."""
        shared = self._shared(best)

        def run(batches):
            for part, x, t in _slices(batches):
                clust = _squared(x, t, shared.value[:, None])[:, 0].argmin(axis=1)
                c = shared.value[t, clust]
                size = np.linalg.norm(x, axis=1) * np.linalg.norm(c, axis=1)
                cosine = np.divide((x * c).sum(axis=1), size, out=np.zeros(len(x)), where=size > 0)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "clust": clust.astype(np.int64), "dist": 1 - cosine})
        return self.rows.mapInPandas(run, "id long, clust long, dist double")


def cluster(emb: DataFrame, by: str, vec: str, order: str, k: int, seed: int = 42, restarts: int = 3, max_iter: int = 100) -> DataFrame:
    """``emb`` with ``clust`` and ``dist``. Centres are numbered as they were
    drawn; a group with fewer different vectors than ``k`` has fewer centres."""
    from corpusdelta.operators.tokens import dense_ids
    emb = cut(emb)
    groups = dense_ids(emb.select(F.col(by).alias("_by")).distinct(), ["_by"], "t")
    keyed = dense_ids(emb, [by, order], "id")
    rows = cut(keyed.join(groups, keyed[by].eqNullSafe(groups["_by"])).drop("_by"))
    n = groups.count()
    if not n:
        return emb.withColumn("clust", F.lit(None).cast("long")).withColumn("dist", F.lit(None).cast("double"))
    d = rows.select(F.size(vec).alias("d")).first()["d"]
    size = max(1, TABLE_BYTES // (8 * restarts * k * d))
    vectors = rows.select("id", "t", F.col(vec).alias("vec"))
    out = None
    for first in range(0, n, size):
        mine = vectors if n <= size else cut(vectors.where(F.col("t").between(first, first + size - 1)))
        lot = Lot(mine, first, min(size, n - first), d, k, restarts, seed)
        found = lot.assign(lot.fit(max_iter))
        out = found if out is None else out.unionByName(found)
    return rows.join(out, "id").select(*emb.columns, "clust", "dist")
