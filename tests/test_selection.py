"""Feature selection on fitted coefficients: fits, folds, and the chain."""

import duckdb
import numpy as np
import pytest

from corpusdelta.operators import batched_logit as BL
from corpusdelta.operators import selection as SE
from corpusdelta.plans import selection_plans as SP
from tests.conftest import SF_SMALL


def wide(spark, n=500, d=40, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * rng.uniform(0.1, 30, d) + rng.uniform(-100, 100, d)
    beta = np.zeros(d)
    beta[:6] = [1.5, -1, 0.8, 0.5, -0.3, 0.2]
    z = (x - x.mean(0)) / x.std(0)
    y = (rng.uniform(size=n) < 1 / (1 + np.exp(-(z @ beta - 0.5)))).astype(float)
    names = [f"f{j}" for j in range(d)]
    df = spark.createDataFrame([(i, float(y[i]), 0, 0, *map(float, x[i])) for i in range(n)],
                               "_id long, _y double, _outer int, _inner int, " + ", ".join(f"{c} double" for c in names))
    return df, names, x, y


def test_active_sets_give_the_fit_of_mllib(spark):
    df, names, x, y = wide(spark)
    grid = [(0.002, 0.9), (0.01, 0.7), (0.05, 1.0), (0.3, 0.9)]
    spec = BL.WeightSpec("folds", outer_out=[-1] * 4, inner_out=[-1] * 4, inner_only=[-1] * 4)
    fits = BL.fit_batched(df, names, spec, np.array([g[0] for g in grid]), np.array([g[1] for g in grid]))
    assert fits.converged.all() and fits.passes == len(fits.sent) < 40
    n = len(y)
    for m, (lam, alpha) in enumerate(grid):
        model = SE.fit_elastic_net(df, names, "_y", 1 / (lam * n), alpha, n, tol=1e-10).stages[-1]
        # MLlib's scaler divides by the sample sd: the coefficient per sd differs by that factor at most
        exact = np.array(model.coefficients.toArray())
        np.testing.assert_allclose(fits.coefs[m], exact, atol=2e-3)
        z = np.column_stack([np.ones(n), (x - x.mean(0)) / x.std(0)])
        t = np.r_[fits.intercepts[m], fits.coefs[m]]
        g = z.T @ (1 / (1 + np.exp(-z @ t)) - y) / n
        slope = g[1:] + lam * (1 - alpha) * t[1:]
        assert abs(g[0]) < 1e-6
        assert np.all(np.where(t[1:] != 0, np.abs(slope + lam * alpha * np.sign(t[1:])), np.maximum(np.abs(slope) - lam * alpha, 0)) < 1e-6)


def test_coefficients_equal_mllib_on_the_same_scale(spark):
    df, names, x, y = wide(spark, n=300, d=12, seed=8)
    z = (x - x.mean(0)) / x.std(0)
    scaled = spark.createDataFrame([(i, float(y[i]), 0, 0, *map(float, z[i])) for i in range(len(y))], df.schema)
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    data = VectorAssembler(inputCols=names, outputCol="x").transform(scaled)
    spec = BL.WeightSpec("folds", outer_out=[-1], inner_out=[-1], inner_only=[-1])
    for lam, alpha in ((0.005, 0.7), (0.03, 1.0)):
        fits = BL.fit_batched(df, names, spec, np.array([lam]), np.array([alpha]))
        model = LogisticRegression(featuresCol="x", labelCol="_y", elasticNetParam=alpha, regParam=lam,
                                   standardization=False, maxIter=2000, tol=1e-12).fit(data)
        np.testing.assert_allclose(fits.coefs[0], model.coefficients.toArray(), atol=1e-4)
        assert fits.intercepts[0] == pytest.approx(model.intercept, abs=1e-4)


def test_only_active_features_send_second_derivatives(spark):
    df, names, _, _ = wide(spark, d=60)
    spec = BL.WeightSpec("bootstrap", reps=np.arange(10), seed=1)
    fits = BL.fit_batched(df, names, spec, np.full(10, 0.08), np.full(10, 0.9))
    assert fits.converged.all()
    used = int((fits.coefs != 0).sum(axis=1).max())
    assert used < 15
    full = 10 * (1 + 61 + 61 * 62 // 2)
    assert max(fits.sent) < full / 5 and fits.sent[0] == 10 * (1 + 61 + 1)
    assert fits.sent[-1] <= max(fits.sent)


def test_unfinished_fits_say_so(spark):
    df, names, _, _ = wide(spark, d=10)
    spec = BL.WeightSpec("folds", outer_out=[-1], inner_out=[-1], inner_only=[-1])
    fits = BL.fit_batched(df, names, spec, np.array([1e-4]), np.array([0.9]), max_iter=2)
    assert not fits.converged.any() and fits.passes == 2


def test_constant_features_and_one_class(spark):
    rows = [(i, float(i % 2), 0, 0, 5.0, float(i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "_id long, _y double, _outer int, _inner int, a double, b double")
    spec = BL.WeightSpec("folds", outer_out=[-1], inner_out=[-1], inner_only=[-1])
    fits = BL.fit_batched(df, ["a", "b"], spec, np.array([0.01]), np.array([0.8]))
    assert fits.converged.all() and fits.coefs[0, 0] == 0
    one = BL.fit_batched(df.where("_y = 1"), ["a", "b"], spec, np.array([0.01]), np.array([0.8]))
    assert np.all(one.coefs == 0) and one.intercepts[0] > 5


def test_chain_summary_follows_from_its_coefficients(spark):
    df, names, _, _ = wide(spark, n=240, d=9)
    chosen = SE.robust_feature_selection(df, names, "_y", "_id", outer=3, inner=2, n_iter=4, reps=25)
    folds = chosen.folds.toPandas()
    assert list(folds.fold) == [1, 2, 3] and folds.converged.all() and (folds.n_unconverged == 0).all()
    assert (folds.auc > 0.7).all()
    coefs, boot = chosen.coefficients.toPandas(), chosen.bootstrap.toPandas()  # noqa: F841  (read by the SQL)
    want = duckdb.sql("""
        WITH st AS (SELECT feature, COUNT(*) FILTER (WHERE coef <> 0) / 3.0 AS selection_freq,
               COALESCE(AVG(coef) FILTER (WHERE coef <> 0), 0) AS avg_std_coef, abs(SUM(sign(coef)) / 3.0) AS sign_consistency
               FROM coefs GROUP BY feature),
        ci AS (SELECT feature, quantile_cont(coef, 0.025) AS ci_lower, quantile_cont(coef, 0.975) AS ci_upper,
               2 * least(AVG((coef > 0)::INT), AVG((coef < 0)::INT)) AS p_approx, COUNT(*) FILTER (WHERE NOT converged) AS n_unconverged
               FROM boot GROUP BY feature)
        SELECT st.*, ci.* EXCLUDE (feature), exp(avg_std_coef) AS odds_ratio, (exp(avg_std_coef) - 1) * 100 AS pct_change_odds,
               0.2 * selection_freq + 0.3 * sign_consistency + 0.2 * (1 - p_approx) + 0.3 * abs(avg_std_coef) AS reliability_score,
               selection_freq >= 1 AND sign_consistency >= 1 AND p_approx <= 0 AND NOT (ci_lower < 0 AND ci_upper > 0)
               AND abs(exp(avg_std_coef) - 1) * 100 >= 5 AS reliable
        FROM st JOIN ci USING (feature) ORDER BY feature""").df()
    got = SE.with_reliability(chosen.summary).toPandas().sort_values("feature", ignore_index=True)[list(want.columns)]
    for c in want.columns:
        if want[c].dtype == float:
            np.testing.assert_allclose(got[c].astype(float), want[c], atol=1e-9, err_msg=c)
        else:
            assert list(got[c]) == list(want[c]), c
    assert got.reliable.any() and set(got.feature[got.reliable]) == {r.feature for r in SE.reliable_features(chosen.summary).collect()}


def test_folds_are_balanced_within_each_outer_fold(spark):
    df = spark.createDataFrame([(i, float(i % 10 == 0)) for i in range(500)], "_id long, _y double")
    d = SE.stratified_folds(df, ["_y"], "_id", 5, 1, "_outer")
    d = SE.stratified_folds(d, ["_y", "_outer"], "_id", 2, 2, "_inner")
    counts = {tuple(r)[:3]: r["count"] for r in d.groupBy("_y", "_outer", "_inner").count().collect()}
    assert {n for (y, _, _), n in counts.items() if y == 1.0} == {5} and {n for (y, _, _), n in counts.items() if y == 0.0} == {45}


def test_regression_report_of_the_fitted_model(spark):
    got = {r.term: r for r in SP.q_regression_report(spark, SF_SMALL).collect()}
    f, kept = SP._fit_features(spark, SF_SMALL)
    pdf = SE.standardise(f, kept).toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf[kept].to_numpy(float)])
    y = pdf.quality.to_numpy(float)
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        h = (x * (p * (1 - p))[:, None]).T @ x
        b = b + np.linalg.solve(h, x.T @ (y - p))
    if np.isfinite(b).all() and np.abs(b).max() < 15:        # the GLM exists (the classes are not separable)
        se = np.sqrt(np.diag(np.linalg.inv(h)))
        chi2 = (b[1:] / se[1:]) ** 2
        assert set(got) == {"(Intercept)", *kept}
        for j, name in enumerate(kept):
            assert got[name].odds_ratio == pytest.approx(np.exp(b[j + 1]), rel=1e-3)
            assert got[name].ci_upper == pytest.approx(np.exp(b[j + 1] + 1.96 * se[j + 1]), rel=1e-2)
            assert got[name].share == pytest.approx(100 * chi2[j] / chi2.sum(), abs=0.05)
