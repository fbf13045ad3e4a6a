"""Feature cleaning, model fitting and feature selection (P11-P18, M17,
M19-M23, A18-A20, A22, W8, W10, W11, T4, X10-X18).

Fits are MLlib estimators on the cluster; what reaches the driver is a
coefficient vector per fit (features x 1) or a correlation matrix
(features x features), both bounded by the feature count.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusdelta.functions import stats as S
from corpusdelta.operators.groups import numeric_columns

NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


# ------------------------------------------------------------------ P12-P18
def drop_nested_columns(df: DataFrame) -> DataFrame:
    """Drop array, map, struct, binary and vector columns (schema only)."""
    keep = []
    for f in df.schema.fields:
        if isinstance(f.dataType, NESTED) or f.dataType.typeName() in ("vector", "udt"):
            continue
        keep.append(f.name)
    return df.select(*keep)


def constant_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """P13 decision: one aggregation of min, max and count per column
    (min = max or no values => constant); one row reaches the driver."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}"), F.count(c).alias(f"n{i}")]
    r = df.agg(*aggs).first()
    return [c for i, c in enumerate(cols) if r[f"n{i}"] == 0 or r[f"a{i}"] == r[f"b{i}"]]


def drop_constant_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop all-NULL or single-valued columns."""
    cols = list(cols or numeric_columns(df))
    return df.drop(*constant_columns(df, cols))


def nonfinite_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """+-inf and NaN -> NULL."""
    cols = set(cols or numeric_columns(df))
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name in cols and isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def impute(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Numeric NULL -> column mean (one pass), others -> 0."""
    cols = list(cols or numeric_columns(df))
    means = df.agg(*[F.avg(c).alias(c) for c in cols]).first().asDict()
    return df.fillna({c: (v if v is not None else 0.0) for c, v in means.items()})


def null_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NULL count per column, only columns with NULLs."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "n_null").filter(F.col("n_null") > 0)


def select_features(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Keep the named features in table order (pruned at the scan)."""
    wanted = set(names)
    return df.select(*keep, *[c for c in df.columns if c in wanted and c not in keep])


def add_class_label(a: DataFrame, b: DataFrame, label: str = "after") -> DataFrame:
    """Label 0 for ``a``, 1 for ``b``, stacked by name."""
    return a.withColumn(label, F.lit(0)).unionByName(b.withColumn(label, F.lit(1)))


# ------------------------------------------------------------------ M19
def standardise(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Z-scores with the sample sd from one aggregation; a constant
    column becomes 0."""
    r = df.agg(*[x for c in cols for x in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))]).first()
    out = []
    for c in df.columns:
        if c in cols:
            m, s = r[f"m_{c}"], r[f"s_{c}"]
            e = F.coalesce(F.try_divide(F.col(c) - F.lit(m), F.lit(s)), F.lit(0.0)) if s else F.lit(0.0)
            out.append(e.alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


# ------------------------------------------------------------------ W8, W10
def seeded_order(seed: int, key: str) -> Column:
    """Seeded pseudo-random order key shared with SQL engines (md5 hex)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def stratified_folds(df: DataFrame, label: str | Sequence[str], key: str, k: int = 5, seed: int = 42,
                     fold: str = "fold") -> DataFrame:
    """Exactly class-balanced folds: rank rows by a seeded hash inside
    each class (of one or more label columns) and deal them round-robin (fold
    = rank mod k). The rank comes from range partitions plus offsets
    (tokens.rank_within), so a class holding most rows is still spread over
    many tasks."""
    from corpusdelta.operators.tokens import rank_within
    labels = [label] if isinstance(label, str) else list(label)
    r = rank_within(df, labels, [seeded_order(seed, key), F.col(key)], "_r")
    return r.withColumn(fold, ((F.col("_r") - 1) % k).cast("int")).drop("_r")


def hash_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42,
               fold: str = "fold") -> DataFrame:
    """W8 at scale: ``pmod(xxhash64(seed, class, id), k)`` (no window)."""
    return df.withColumn(fold, F.pmod(F.xxhash64(F.lit(seed), F.col(label), F.col(key)), F.lit(k)).cast("int"))


def balanced_sample(df: DataFrame, label: str, key: str, n_per_class: int | None = None,
                    seed: int = 42) -> DataFrame:
    """The same number of rows from each class (the smallest class size
    unless given), chosen by a seeded hash order inside each class."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}   # one row per class
    n = n_per_class if n_per_class is not None else min(counts.values())
    from corpusdelta.operators.tokens import rank_within
    r = rank_within(df, [label], [seeded_order(seed, key), F.col(key)], "_r")
    return r.filter(F.col("_r") <= n).drop("_r")


# ------------------------------------------------------------------ X10-X12
def binary_log_likelihood(df: DataFrame, y: str, p: str) -> DataFrame:
    """Sum of ``y ln p + (1-y) ln(1-p)`` with p clipped to 1e-15."""
    return df.agg(F.sum(S.binary_log_likelihood(y, p)).alias("log_likelihood"))


def pseudo_r2(df: DataFrame, y: str, p: str) -> DataFrame:
    """X11: McFadden ``1 - LL/LL0`` and the reference's ratio
    ``McF / (1 - LL0/n)`` (named ``nagelkerke_as_coded``) plus the textbook
    Nagelkerke ``(1 - exp(2(LL0-LL)/n)) / (1 - exp(2 LL0 / n))``."""
    ybar = df.agg(F.avg(F.col(y).cast("double"))).first()[0]
    a = df.agg(F.sum(S.binary_log_likelihood(y, p)).alias("ll"),
               F.sum(S.binary_log_likelihood(y, F.lit(ybar))).alias("ll0"),
               F.count(F.lit(1)).alias("n"))
    mcf = 1 - F.col("ll") / F.col("ll0")
    return a.select(mcf.alias("mcfadden"),
                    (mcf / (1 - F.col("ll0") / F.col("n"))).alias("nagelkerke_as_coded"),
                    ((1 - F.exp(2 * (F.col("ll0") - F.col("ll")) / F.col("n")))
                     / (1 - F.exp(2 * F.col("ll0") / F.col("n")))).alias("nagelkerke"))


def auc(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact ROC AUC (ties count one half), optionally per ``by`` group
    (e.g. per model), from a histogram of distinct scores:
    range-partition the histogram on (by, score); a window inside each range
    partition gives the negatives below each score, plus an offset for the
    few groups that span several partitions (tokens._with_offsets)."""
    by = list(by)
    h = (df.groupBy(*by, F.col(score).cast("double").alias("s"))
         .agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg")))
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    r = h.repartitionByRange(n, *by, "s").withColumn("_p", F.spark_partition_id())
    from corpusdelta.operators.tokens import _with_offsets
    from corpusdelta.session import cut
    r = _with_offsets(cut(r), by, F.sum("neg"))
    w = Window.partitionBy("_p", *by).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(w), F.lit(0)) + F.col("_offset_p")
    c = r.withColumn("below", below)
    g = c.groupBy(*by) if by else c.groupBy()
    return g.agg((F.sum(F.col("pos") * (F.col("below") + 0.5 * F.col("neg")))
                  / (F.sum("pos") * F.sum("neg"))).alias("auc"))


# ------------------------------------------------------------------ M20, M21, X13, X14
def logistic_regression(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Unpenalised binomial GLM (IRLS). Returns ``(term, estimate, se,
    z, p)`` with the intercept first, plus deviances as extra columns."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression
    va = VectorAssembler(inputCols=list(features), outputCol="_x")
    data = va.transform(df.select(*features, F.col(label).cast("double").alias("_y")))
    glm = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="_x",
                                      labelCol="_y", maxIter=50)
    m = glm.fit(data)
    s = m.summary
    terms = list(features) + ["(Intercept)"]
    est = list(m.coefficients) + [m.intercept]
    rows = [(t, float(b), float(se), float(z), float(p))
            for t, b, se, z, p in zip(terms, est, s.coefficientStandardErrors, s.tValues, s.pValues)]
    rows = [rows[-1]] + rows[:-1]
    out = df.sparkSession.createDataFrame(rows, "term string, estimate double, se double, z double, p double")
    return out.withColumn("deviance", F.lit(float(s.deviance))) \
              .withColumn("null_deviance", F.lit(float(s.nullDeviance)))


def wald_ci(coefs: DataFrame, z: float = 1.96) -> DataFrame:
    """Odds ratio and Wald interval ``exp(b +- z se)``."""
    return coefs.select("term", F.exp("estimate").alias("odds_ratio"),
                        F.exp(F.col("estimate") - z * F.col("se")).alias("ci_lower"),
                        F.exp(F.col("estimate") + z * F.col("se")).alias("ci_upper"),
                        "se", "z", "p")


def relative_importance(coefs: DataFrame) -> DataFrame:
    """Per term Wald chi-square ``(b/se)^2`` and its percent share,
    rounded to 2, largest first (intercept excluded)."""
    c = coefs.filter(F.col("term") != "(Intercept)").withColumn(
        "chi2", F.pow(F.col("estimate") / F.col("se"), 2))
    tot = c.agg(F.sum("chi2")).first()[0]
    return (c.select("term", "chi2", F.round(F.col("chi2") / F.lit(tot) * 100, 2).alias("share"))
            .orderBy(F.col("share").desc(), "term"))


# ------------------------------------------------------------------ M17 + A20
def fit_elastic_net(train: DataFrame, features, label, c: float, l1: float, n: int, weight=None, tol: float = 1e-6):
    """One logistic elastic-net fit as an MLlib pipeline (scaler inside):
    lam = 1/(C n), elasticNetParam = l1_ratio; optional weight column."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    va = VectorAssembler(inputCols=list(features), outputCol="_raw")
    sc = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True)
    lr = LogisticRegression(featuresCol="_x", labelCol=label, elasticNetParam=l1,
                            regParam=1.0 / (c * n), standardization=False, maxIter=2000, tol=tol)
    if weight:
        lr.setWeightCol(weight)
    return Pipeline(stages=[va, sc, lr]).fit(train)


def elastic_net_nested_cv(df: DataFrame, features: Sequence[str], label: str, key: str,
                          outer: int = 5, inner: int = 5, n_iter: int = 20, seed: int = 42):
    """Nested CV of a logistic elastic net, scaler inside the folds.

    ``n_iter`` seeded draws of C ~ loguniform(1e-4, 1) and l1_ratio from
    linspace(.7, 1, 6); lam = 1/(C n) maps C onto the mean-loss objective.
    Folds are exactly class-balanced (W8); inner folds are balanced within
    every outer fold, so they are in every outer training part. All outer x
    inner x n_iter inner models are fitted together (one pass per Newton
    iteration, see batched_logit), scored by AUC on their validation folds
    (distributed AUC per model), the best setting per outer fold is refitted on
    the whole outer training part (again batched) and scored on the outer test
    fold. Returns ``(fold_results, coefficients)`` DataFrames; ``converged``
    says of a fold whether its refit met the optimality conditions, and
    ``n_unconverged`` how many of its inner fits did not."""
    from corpusdelta.operators import batched_logit as BL
    from corpusdelta.session import cut
    spark = df.sparkSession
    rng = np.random.default_rng(seed)
    cs = np.exp(rng.uniform(np.log(1e-4), np.log(1.0), n_iter))
    l1s = rng.choice(np.linspace(0.7, 1.0, 6), n_iter)
    data = df.select(F.col(key).cast("long").alias("_id"), F.col(label).cast("double").alias("_y"),
                     *[F.col(f).cast("double").alias(f) for f in features])
    data = stratified_folds(data, ["_y"], "_id", outer, seed, "_outer")
    data = cut(stratified_folds(data, ["_y", "_outer"], "_id", inner, seed + 1, "_inner"))
    counts = {(r["_outer"], r["_inner"]): r["count"] for r in data.groupBy("_outer", "_inner").count().collect()}
    models = [(fo, fi, g) for fo in range(outer) for fi in range(inner) for g in range(n_iter)]
    n_train = np.array([sum(v for (o, i), v in counts.items() if o != fo and i != fi) for fo, fi, _ in models])
    lam = 1.0 / (cs[[g for _, _, g in models]] * np.maximum(n_train, 1))
    alpha = l1s[[g for _, _, g in models]]
    spec = BL.WeightSpec("folds", outer_out=[m[0] for m in models], inner_out=[m[1] for m in models],
                         inner_only=[-1] * len(models))
    fits = BL.fit_batched(data, features, spec, lam, alpha)
    val = BL.WeightSpec("folds", outer_out=[m[0] for m in models], inner_out=[-1] * len(models),
                        inner_only=[m[1] for m in models])
    aucs = {r["model"]: r["auc"] for r in
            auc(BL.scores_long(data, features, val, fits), "y", "score", ["model"]).collect()}
    best = []
    for fo in range(outer):
        mean_auc = {g: np.nanmean([aucs.get(models.index((fo, fi, g)), np.nan) for fi in range(inner)])
                    for g in range(n_iter)}
        best.append(max(range(n_iter), key=lambda g: (mean_auc[g], -cs[g])))
    n_out = np.array([sum(v for (o, _), v in counts.items() if o != fo) for fo in range(outer)])
    spec2 = BL.WeightSpec("folds", outer_out=list(range(outer)), inner_out=[-1] * outer, inner_only=[-1] * outer)
    refits = BL.fit_batched(data, features, spec2, 1.0 / (cs[best] * np.maximum(n_out, 1)), l1s[best])
    # test rows of outer fold f: reuse the validation mask with inner := outer
    sc = BL.scores_long(data.withColumn("_inner", F.col("_outer")), features, BL.WeightSpec(
        "folds", outer_out=[-1] * outer, inner_out=[-1] * outer, inner_only=list(range(outer))), refits)
    taucs = {r["model"]: r["auc"] for r in auc(sc, "y", "score", ["model"]).collect()}
    missed = [sum(not fits.converged[k] for k, m in enumerate(models) if m[0] == fo) for fo in range(outer)]
    results = [(fo + 1, float(taucs.get(fo, float("nan"))), float(cs[best[fo]]), float(l1s[best[fo]]),
                bool(refits.converged[fo]), missed[fo]) for fo in range(outer)]
    rows = [(fo + 1, f, float(refits.coefs[fo, j])) for fo in range(outer) for j, f in enumerate(features)]
    res = spark.createDataFrame(results, "fold int, auc double, best_c double, best_l1_ratio double, converged boolean, n_unconverged int")
    cf = spark.createDataFrame(rows, "fold int, feature string, coef double")
    return res, cf


def fold_stability(coefs: DataFrame, n_folds: int | None = None) -> DataFrame:
    """Per feature the selection frequency (share of folds with a
    non-zero coefficient), the mean non-zero coefficient (0 when never
    selected) and the absolute mean sign."""
    k = n_folds if n_folds is not None else F.count(F.lit(1))
    nz = F.col("coef") != 0
    return coefs.groupBy("feature").agg(
        (F.count_if(nz) / k).alias("selection_freq"),
        F.coalesce(F.avg(F.when(nz, F.col("coef"))), F.lit(0.0)).alias("avg_std_coef"),
        F.abs(F.sum(F.signum("coef")) / k).alias("sign_consistency"))


# ------------------------------------------------------------------ A18, A19
def run_mean_std(results: DataFrame, metrics: Sequence[str], fold: str = "fold",
                 ddof: int = 0, digits: int = 3) -> DataFrame:
    """Per-fold rows plus a ``mean`` and a ``std`` row (over the folds
    only; ``ddof`` 0 as in the published summary), rounded."""
    per = results.select(F.col(fold).cast("string").alias("row"), *[F.col(m).cast("double") for m in metrics])
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    mean = results.agg(*[F.avg(m).alias(m) for m in metrics]).select(F.lit("mean").alias("row"), *metrics)
    std = results.agg(*[sd(m).alias(m) for m in metrics]).select(F.lit("std").alias("row"), *metrics)
    out = per.unionByName(mean).unionByName(std)
    return out.select("row", *[F.round(m, digits).alias(m) for m in metrics])


def selection_counts(lists: DataFrame, fold: str = "fold", feature: str = "feature"):
    """Occurrences of each feature over the fold lists, the number of
    features with each occurrence count, and the size of each fold list."""
    occ = lists.groupBy(feature).agg(F.count(F.lit(1)).alias("occurrences"))
    cc = occ.groupBy("occurrences").agg(F.count(F.lit(1)).alias("n_features"))
    sizes = lists.groupBy(fold).agg(F.count(F.lit(1)).alias("n_features"))
    return occ, cc, sizes


# ------------------------------------------------------------------ A22, X18, M23
def correlation_matrix(df: DataFrame, cols: Sequence[str], absolute: bool = True) -> DataFrame:
    """Pearson correlation of every feature pair (i < j) over the rows
    where both are known; long ``(feature1, feature2, r)``, |r| by default, NULL
    for a constant feature.

    One pass: each task sums the products of its (mean-centred) rows as a matrix
    product, and the tasks' sums are added by pair; the cost per row is one
    matrix row, not one aggregate per pair."""
    cols = list(cols)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "feature1 string, feature2 string, r double")
    x = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    means = np.array([v or 0.0 for v in x.agg(*[F.avg(c) for c in cols]).first()], dtype=float)   # one number per feature
    i, j = np.triu_indices(len(cols), 1)

    def partial(batches):
        total = np.zeros((6, len(i)))
        for b in batches:
            m = b.to_numpy(dtype=float)
            known = ~np.isnan(m)
            m = np.where(known, m - means, 0.0)
            k = known.astype(float)
            n, sx, sxx, sxy = k.T @ k, m.T @ k, (m * m).T @ k, m.T @ m
            total += np.stack([n[i, j], sx[i, j], sx[j, i], sxx[i, j], sxx[j, i], sxy[i, j]])
        yield pd.DataFrame({"i": i, "j": j, **dict(zip(("n", "x", "y", "xx", "yy", "xy"), total))})

    s = (x.mapInPandas(partial, "i int, j int, n double, x double, y double, xx double, yy double, xy double")
         .groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")]))
    var = [F.col(q) - F.try_divide(F.col(v) * F.col(v), F.col("n")) for q, v in (("xx", "x"), ("yy", "y"))]
    tiny = [v > 1e-12 * F.col(q) for v, q in zip(var, ("xx", "yy"))]
    r = F.when(tiny[0] & tiny[1], (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.sqrt(var[0] * var[1]))
    names = F.array(*[F.lit(c) for c in cols])
    return s.select(F.get(names, F.col("i")).alias("feature1"), F.get(names, F.col("j")).alias("feature2"),
                    (F.abs(r) if absolute else r).alias("r"))


def correlated_groups(corr_long: DataFrame, threshold: float = 0.9, literal: bool = False) -> list[set]:
    """Features linked by |r| > threshold merged into sets. The pairs
    (at most features^2, bounded) come to the driver; default is connected
    components, ``literal=True`` reproduces the order-dependent greedy merge."""
    pairs = [(r["feature1"], r["feature2"]) for r in
             corr_long.filter(F.col("r") > threshold).orderBy("feature1", "feature2").collect()]
    if literal:
        sets: list[set] = []
        for a, b in pairs:
            for s in sets:
                if a in s or b in s:
                    s.update([a, b])
                    break
            else:
                sets.append({a, b})
        return sets
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in pairs:
        parent[find(a)] = find(b)
    groups: dict = {}
    for x in list(parent):
        groups.setdefault(find(x), set()).add(x)
    return sorted(groups.values(), key=lambda s: sorted(s))


def feature_prefilter(df: DataFrame, cols: Sequence[str], threshold: float = 0.9) -> list[str]:
    """Drop constant features, then keep one representative (first in
    table order) of each correlated group."""
    constant = set(constant_columns(df, cols))
    keep = [c for c in cols if c not in constant]
    groups = correlated_groups(correlation_matrix(df, keep), threshold)
    drop = set()
    for g in groups:
        first = min(g, key=keep.index)
        drop |= set(g) - {first}
    return [c for c in keep if c not in drop]


# ------------------------------------------------------------------ X15-X17, F13, W11, T4
def bootstrap_coefs(df: DataFrame, features: Sequence[str], label: str, key: str,
                    reps: int = 200, seed: int = 42, c: float = 0.1, l1: float = 0.9) -> DataFrame:
    """X15 fits: ``reps`` refits on bootstrap resamples, expressed as
    replicate weights ~ Poisson(1) drawn from a hash of (seed, rep, id) and
    fitted together (batched_logit). Returns long ``(rep, feature, coef,
    converged)``."""
    from corpusdelta.operators import batched_logit as BL
    from corpusdelta.session import cut
    spark = df.sparkSession
    data = df.select(F.col(key).cast("long").alias("_id"), F.col(label).cast("double").alias("_y"),
                     F.lit(0).alias("_outer"), F.lit(0).alias("_inner"),
                     *[F.col(f).cast("double").alias(f) for f in features])
    data = cut(data)
    n = max(data.count(), 1)
    spec = BL.WeightSpec("bootstrap", reps=np.arange(reps), seed=seed)
    fits = BL.fit_batched(data, features, spec, np.full(reps, 1.0 / (c * n)), np.full(reps, l1))
    rows = [(r, f, float(fits.coefs[r, j]), bool(fits.converged[r])) for r in range(reps) for j, f in enumerate(features)]
    return spark.createDataFrame(rows, "rep int, feature string, coef double, converged boolean")


def bootstrap_ci(boot: DataFrame, alpha: float = 0.05) -> DataFrame:
    """X15 summary, joined by feature name: percentile CI and
    ``p = 2 min(share > 0, share < 0)``."""
    return boot.groupBy("feature").agg(
        F.percentile("coef", alpha / 2).alias("ci_lower"),
        F.percentile("coef", 1 - alpha / 2).alias("ci_upper"),
        (2 * F.least(F.avg((F.col("coef") > 0).cast("double")),
                     F.avg((F.col("coef") < 0).cast("double")))).alias("p_approx"))


def with_reliability(summary: DataFrame, freq: float = 1.0, sign: float = 1.0, p: float = 0.0,
                     min_pct: float = 5.0) -> DataFrame:
    """X16 (+ X17, F13) as columns: odds ratio, percent change in odds,
    reliability score, and whether the feature meets all criteria."""
    from corpusdelta.functions.text import odds_pct_change, odds_ratio
    s = (summary.withColumn("odds_ratio", odds_ratio("avg_std_coef"))
         .withColumn("pct_change_odds", odds_pct_change("avg_std_coef"))
         .withColumn("reliability_score", reliability_score()))
    return s.withColumn("reliable", (
        (F.col("selection_freq") >= freq) & (F.col("sign_consistency") >= sign)
        & (F.col("p_approx") <= p) & ~((F.col("ci_lower") < 0) & (F.col("ci_upper") > 0))
        & (F.abs("pct_change_odds") >= min_pct)))


def reliable_features(summary: DataFrame, freq: float = 1.0, sign: float = 1.0, p: float = 0.0,
                      min_pct: float = 5.0) -> DataFrame:
    """The reliable features only, sorted by the score."""
    s = with_reliability(summary, freq, sign, p, min_pct)
    return s.filter("reliable").drop("reliable").orderBy(F.col("reliability_score").desc(), "feature")


class Selection(NamedTuple):
    """Results of :func:`robust_feature_selection`, as DataFrames."""

    folds: DataFrame
    coefficients: DataFrame
    bootstrap: DataFrame
    summary: DataFrame


def robust_feature_selection(df: DataFrame, features: Sequence[str], label: str, key: str, outer: int = 5,
                             inner: int = 5, n_iter: int = 20, reps: int = 200, seed: int = 42,
                             ci_alpha: float = 0.05, c: float = 0.1, l1: float = 0.9) -> Selection:
    """M17 -> A20 -> X15, one chain on fitted coefficients: nested CV, the
    stability of each feature over the refits of its outer folds, and bootstrap
    intervals, joined by feature name (``with_reliability`` judges them).
    ``n_unconverged`` counts the replicates that missed the optimality
    conditions."""
    folds, coefs = elastic_net_nested_cv(df, features, label, key, outer, inner, n_iter, seed)
    boot = bootstrap_coefs(df, features, label, key, reps, seed, c, l1)
    missed = boot.groupBy("feature").agg(F.count_if(~F.col("converged")).alias("n_unconverged"))
    summary = (fold_stability(coefs, n_folds=outer).join(bootstrap_ci(boot, ci_alpha), "feature").join(missed, "feature"))
    return Selection(folds, coefs, boot, summary)


def reliability_score() -> Column:
    """``.2 freq + .3 sign + .2 (1 - p) + .3 |coef|``."""
    return (0.2 * F.col("selection_freq") + 0.3 * F.col("sign_consistency")
            + 0.2 * (1 - F.col("p_approx")) + 0.3 * F.abs("avg_std_coef"))


def top_features_per_group(df: DataFrame, group: str, n: int, score: str = "pct_change_odds") -> DataFrame:
    """The n features with the largest absolute score per feature group."""
    w = Window.partitionBy(group).orderBy(F.abs(score).desc(), F.col("feature"))
    return df.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n)


def head_by_rank(df: DataFrame, n: int = 30, order: str = "reliability_score") -> DataFrame:
    """T4: the first n rows of a ranked table."""
    return df.orderBy(F.col(order).desc(), "feature").limit(n)


# ------------------------------------------------------------------ M22
def paired_logistic(df: DataFrame, features: Sequence[str], label: str, group: str,
                    nodes: int = 15, max_iter: int = 60, tol: float = 1e-8) -> DataFrame:
    """Logistic regression with a random intercept per group (pair),
    maximum marginal likelihood by adaptive Gauss-Hermite quadrature, one pass
    over the rows per step of Newton's method (see mixed_logit). A variance on
    the boundary (sd 0) is the plain GLM (M20). Returns ``(term, estimate)``
    rows plus ``sd_intercept``, ``loglik``, ``converged`` and ``passes``."""
    from corpusdelta.operators import mixed_logit as ML
    fitted = ML.fit(ML.Rows(df, features, label, group, nodes), max_iter, tol)
    terms = ["(Intercept)", *features]
    sd = math.exp(fitted.theta[-1])
    rows = [(t, float(b), sd, float(fitted.loglik), fitted.converged, fitted.passes) for t, b in zip(terms, fitted.theta)]
    return df.sparkSession.createDataFrame(
        rows, "term string, estimate double, sd_intercept double, loglik double, converged boolean, passes int")
