"""Word vectors: training, normalisation, neighbourhood density, alignment
and comparison (M1-M8, T3, J12, J17, X5, X6, J8).

The V x V similarity matrix is never materialised. Exact neighbour search
deals words to blocks; a pair of blocks is one Arrow group in which numpy
multiplies two bounded blocks and keeps only the top-k of each row. Large
vocabularies go through a ball index (neighbours.py), which ships only the
pairs of blocks that can hold a neighbour.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusdelta.functions import stats as S
from corpusdelta.operators.neighbours import BallIndex, best_of, top_k
from corpusdelta.session import cut


def _c(c):
    return F.col(c) if isinstance(c, str) else c


# ------------------------------------------------------------------ M1
def train_word2vec(sentences: DataFrame, tokens: str = "tokens", dims: int = 100,
                   window: int = 5, min_count: int = 100, seed: int = 42,
                   max_iter: int = 1, partitions: int | None = None) -> DataFrame:
    """M1: skip-gram Word2Vec (MLlib; hierarchical softmax). Returns
    ``(word, vec array<float>, count)``."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array
    n = partitions or max(int(sentences.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    w2v = Word2Vec(vectorSize=dims, windowSize=window, minCount=min_count, seed=seed,
                   maxIter=max_iter, numPartitions=n, inputCol=tokens, outputCol="_v")
    model = w2v.fit(sentences.select(tokens))
    counts = (sentences.select(F.explode(tokens).alias("word")).groupBy("word")
              .agg(F.count(F.lit(1)).alias("count")))
    vecs = model.getVectors().select("word", vector_to_array("vector", "float32").alias("vec"))
    return vecs.join(counts, "word", "left")


# ------------------------------------------------------------------ M2
def norm(v) -> "F.Column":
    v = _c(v)
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalise(v) -> "F.Column":
    """M2: unit-length vector (array<double>); a zero vector stays zero."""
    v = _c(v)
    # the length is an element of its own, so it is computed once for each vector
    return F.get(F.transform(F.array(norm(v)), lambda n: F.transform(
        v, lambda x: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0)))), 0)


def dot(a, b) -> "F.Column":
    """Row-wise dot product of two equal-length arrays."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


# ------------------------------------------------------------------ M3
def concat_runs(vectors: DataFrame, runs: Sequence, word: str = "word", run: str = "run",
                vec: str = "vec") -> DataFrame:
    """M3: one vector per word whose dot products equal the mean over runs of
    the per-run cosines: normalised run vectors scaled by 1/sqrt(R) and
    concatenated in run order. Vocabularies must be equal across runs."""
    r = len(runs)
    counts = vectors.groupBy(word).agg(F.count_distinct(run).alias("_n"))
    if counts.filter(F.col("_n") != r).limit(1).count():
        raise ValueError("vocabularies differ between runs")
    scale = 1.0 / math.sqrt(r)
    v = vectors.select(word, run, F.transform(normalise(vec), lambda x: x * scale).alias("_v"))
    g = v.groupBy(word).agg(F.array_sort(F.collect_list(F.struct(run, "_v"))).alias("_s"))
    return g.select(word, F.flatten(F.col("_s._v")).alias(vec))


# ------------------------------------------------------------------ M4 / T3
def top_k_neighbours(vectors: DataFrame, k: int = 10, word: str = "word", vec: str = "vec",
                     block_rows: int = 2048, normalised: bool = False, min_blocks: int = 4,
                     indexed: bool | None = None) -> DataFrame:
    """The k most similar other words per word by cosine, exact, ties to
    the smaller word. Returns ``(word, rank, neighbour, sim)``.

    A vocabulary that fits ``min_blocks`` blocks of ``block_rows`` vectors is
    scored whole, every unordered pair of blocks as one group; a larger one
    goes through :class:`neighbours.BallIndex`, which ships only the pairs of
    portions that can hold a neighbour. ``indexed`` forces either; the rows are
    the same."""
    v = cut(vectors.select(F.col(word).cast("string").alias("w"),
                           (F.col(vec).cast("array<double>") if normalised else normalise(vec)).alias("v")))
    if indexed is None:
        indexed = v.count() > min_blocks * block_rows
    if indexed:
        top = BallIndex(v, block_rows, min_blocks).search(k)
    else:
        top = _all_pairs(v, k, min_blocks)
    return top.select(F.col("w").alias(word), "rank", F.col("nb").alias("neighbour"), "sim")


def _all_pairs(v: DataFrame, k: int, b: int) -> DataFrame:
    """Every unordered pair of ``b`` blocks is one group and serves both directions."""
    v = v.withColumn("blk", F.pmod(F.xxhash64("w"), F.lit(b)).cast("int"))
    each = v.select("w", "v", "blk", F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("j")).select(
        (F.least("blk", "j") * b + F.greatest("blk", "j")).alias("pair"), (F.col("blk") > F.col("j")).alias("right"), "w", "v")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf.pair.iloc[0] // b, pdf.pair.iloc[0] % b
        left, right = (pdf, pdf) if lo == hi else (pdf[~pdf.right], pdf[pdf.right])
        if left.empty or right.empty:
            return pd.DataFrame({"w": [], "nb": [], "sim": []})
        lm, rm = (np.vstack(x.v.to_numpy()).astype(np.float64) for x in (left, right))
        lw, rw = left.w.to_numpy(), right.w.to_numpy()
        sims = lm @ rm.T
        sims[lw[:, None] == rw[None, :]] = -np.inf          # self excluded
        if lo == hi:
            return best_of(sims, lw, rw, k)
        return pd.concat([best_of(sims, lw, rw, k), best_of(sims.T, rw, lw, k)])

    return top_k(each.groupBy("pair").applyInPandas(kernel, "w string, nb string, sim double"), k)


def neighbour_density(vectors: DataFrame, k: int = 10, word: str = "word", vec: str = "vec",
                      block_rows: int = 2048, normalised: bool = False, min_blocks: int = 4) -> DataFrame:
    """M4: mean and sample sd (ddof 1) of each word's top-k cosines, with
    the cosines themselves (descending)."""
    t = top_k_neighbours(vectors, k, word, vec, block_rows, normalised, min_blocks)
    return (t.groupBy(word).agg(F.avg("sim").alias("mean"), F.stddev_samp("sim").alias("std"),
                                F.array_sort(F.collect_list("sim"), lambda a, b: F.when(a > b, -1)
                                             .when(a < b, 1).otherwise(0)).alias("cosines")))


# ------------------------------------------------------------------ J17 / M5 / M6
def shared_vocab(v1: DataFrame, v2: DataFrame, word: str = "word", count: str = "count") -> DataFrame:
    """Words in both vocabularies, most frequent (summed counts) first."""
    a = v1.select(word, F.col(count).alias("c1"))
    b = v2.select(word, F.col(count).alias("c2"))
    return a.join(b, word).withColumn("total", F.col("c1") + F.col("c2")).orderBy(
        F.col("total").desc(), word)


def _grams(pairs: DataFrame, d: int, run: str) -> dict:
    """Sum over a run's rows of outer(o, b), for all runs in one pass:
    per-task d x d sums by run in Arrow batches, then an aggregation by run and
    place; d * d numbers per run reach the driver."""
    kind = pairs.schema[run].dataType.simpleString()

    def part(batches):
        sums: dict = {}
        for pdf in batches:
            for key, rows in pdf.groupby(run, dropna=False, sort=False):
                o, b = (np.vstack(rows[c].to_numpy()).astype(np.float64) for c in "ob")
                sums[key] = sums.get(key, 0.0) + o.T @ b
        for key, total in sums.items():
            yield pd.DataFrame({run: [key] * (d * d), "place": np.arange(d * d), "val": total.ravel()})
    partial = pairs.select(run, "o", "b").mapInPandas(part, f"`{run}` {kind}, place long, val double")
    rows = partial.groupBy(run, "place").agg(F.sum("val").alias("val")).collect()
    out: dict = {}
    for key, place, val in rows:
        out.setdefault(key, np.zeros(d * d))[place] = val
    return {key: m.reshape(d, d) for key, m in out.items()}


def procrustes_rotations(base: DataFrame, other: DataFrame, run: str = "run", word: str = "word",
                         vec: str = "vec") -> dict:
    """M5 for every run at once: orthogonal R = U V^T from the SVD of
    other^T . base over the words that both tables of a run hold (normalised
    vectors); one pass over the joined vectors, one batched SVD."""
    first = base.select(vec).first()
    if first is None:
        return {}
    pairs = (base.select(run, word, normalise(vec).alias("b"))
             .join(other.select(run, word, normalise(vec).alias("o")), [run, word]))
    grams = _grams(pairs, len(first[0]), run)
    if not grams:
        return {}
    u, _, vt = np.linalg.svd(np.stack(list(grams.values())))
    return dict(zip(grams, u @ vt))


def procrustes_rotation(base: DataFrame, other: DataFrame, word: str = "word", vec: str = "vec") -> np.ndarray:
    """M5: the rotation of a single pair of tables."""
    one = F.lit(0).alias("_run")
    return procrustes_rotations(base.select(one, word, vec), other.select(one, word, vec), "_run", word, vec)[0]


def rotate(df: DataFrame, rot: np.ndarray, vec: str = "vec", out: str | None = None) -> DataFrame:
    """Apply a d x d rotation to every vector (Arrow UDF; the matrix travels
    with the function, d*d numbers)."""
    r = np.asarray(rot, dtype=np.float64)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def _rot(s: pd.Series) -> pd.Series:
        if len(s) == 0:
            return pd.Series([], dtype=object)
        m = np.vstack(s.to_numpy()).astype(np.float64) @ r
        return pd.Series(list(m))
    return df.withColumn(out or vec, _rot(F.col(vec)))


def procrustes_align(base: DataFrame, other: DataFrame, word: str = "word", vec: str = "vec") -> DataFrame:
    """M5: ``other`` rotated onto ``base`` (raw vectors rotated)."""
    return rotate(other, procrustes_rotation(base, other, word, vec), vec)


def aligned_self_similarity(base: DataFrame, aligned: DataFrame, word: str = "word",
                            vec: str = "vec", by: Sequence[str] = ()) -> DataFrame:
    """M6: per word (and run) cosine between the base vector and the
    aligned other vector."""
    j = base.select(*by, word, F.col(vec).alias("a")).join(
        aligned.select(*by, word, F.col(vec).alias("b")), [*by, word])
    return j.select(*by, word, dot(normalise("a"), normalise("b")).alias("sim"))


def rotate_runs(df: DataFrame, rotations: dict, run: str = "run", vec: str = "vec") -> DataFrame:
    """Every vector rotated by the matrix of its run (Arrow; the matrices travel
    with the function, d * d numbers per run); runs without one drop out."""
    keyed = {k: np.asarray(m, dtype=np.float64) for k, m in rotations.items()}
    fields = T.StructType([T.StructField(f.name, T.ArrayType(T.DoubleType()) if f.name == vec else f.dataType) for f in df.schema.fields])

    def run_all(batches):
        for pdf in batches:
            for key, rows in pdf.groupby(run, dropna=False, sort=False):
                if key in keyed:
                    yield rows.assign(**{vec: list(np.vstack(rows[vec].to_numpy()).astype(np.float64) @ keyed[key])})
    return df.mapInPandas(run_all, fields)


def aligned_similarity_runs(base: DataFrame, other: DataFrame, runs: Sequence, run: str = "run", word: str = "word",
                            vec: str = "vec") -> DataFrame:
    """M6 over runs: in each run, ``other`` is aligned to ``base``; one row per
    word with ``sims`` (in the order of ``runs``, NULL where a run lacks the
    word) and their mean ``avg``."""
    runs = list(runs)
    base, other = (x.where(F.col(run).isin(runs)).select(run, word, vec) for x in (base, other))
    aligned = rotate_runs(other, procrustes_rotations(base, other, run, word, vec), run, vec)
    sims = aligned_self_similarity(base, aligned, word, vec, by=[run])
    return sims.groupBy(word).agg(F.array(*[F.max(F.when(F.col(run) == r, F.col("sim"))) for r in runs]).alias("sims"),
                                  F.avg("sim").alias("avg"))


# ------------------------------------------------------------------ X6 / M7 / M8
def mann_whitney_u(a, b) -> "F.Column":
    """X6, U statistic of sample a: sum over pairs of [x > y] + 1/2 [x = y]
    (row-local, both arrays bounded by k)."""
    return F.aggregate(
        F.transform(_c(a), lambda x: F.aggregate(
            F.transform(_c(b), lambda y: F.when(x > y, 1.0).when(x == y, 0.5).otherwise(0.0)),
            F.lit(0.0), lambda s, z: s + z)),
        F.lit(0.0), lambda s, z: s + z)


def density_compare(d1: DataFrame, d2: DataFrame, word: str = "word", method: str = "auto") -> DataFrame:
    """M7 (with J12): inner join of two density tables by word, Mann-Whitney
    U of the two cosine lists and its p-value (``method``: auto, exact or
    asymptotic), the means and sds kept."""
    j = (d1.select(word, F.col("mean").alias("mean1"), F.col("std").alias("std1"),
                   F.col("cosines").alias("c1"))
         .join(d2.select(word, F.col("mean").alias("mean2"), F.col("std").alias("std2"),
                         F.col("cosines").alias("c2")), word))
    j = j.withColumn("stat", mann_whitney_u("c1", "c2"))
    return j.withColumn("pval", S.mann_whitney_p("stat", "c1", "c2", method)).drop("c1", "c2")


def density_shift(df: DataFrame) -> DataFrame:
    """M8: ``delta_nn = mean2 - mean1``."""
    return df.withColumn("delta_nn", F.col("mean2") - F.col("mean1"))


# ------------------------------------------------------------------ J8 / X5
def attach_density(keyness: DataFrame, density: DataFrame, on: str = "target",
                   word: str = "word", how: str = "left") -> DataFrame:
    """Keyness rows with the density comparison of their word."""
    return keyness.join(density.withColumnRenamed(word, on), on, how)


def spearman(df: DataFrame, x: str, y: str) -> dict:
    """Spearman rank correlation (MLlib, average ranks for ties, a
    distributed sort) and its two-sided p from t with n - 2 df."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation
    d = cut(df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna())
    n = d.count()
    if n < 3:
        return {"rho": float("nan"), "pval": float("nan"), "n": n}
    va = VectorAssembler(inputCols=["x", "y"], outputCol="f").transform(d).select("f")
    rho = float(Correlation.corr(va, "f", "spearman").first()[0][0, 1])
    if abs(rho) >= 1.0:
        return {"rho": rho, "pval": 0.0, "n": n}
    t = rho * math.sqrt((n - 2) / (1 - rho * rho))
    return {"rho": rho, "pval": S.t_two_sided_p(t, n - 2), "n": n}
