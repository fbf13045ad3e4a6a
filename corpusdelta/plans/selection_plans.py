"""Registered selection/regression plans (P11-P18, M17, M19-M23, A18-A20,
A22, W8, W10, W11, T4, X10-X18, F13).

Feature matrix (FIXTURES.md #12): per-document features of the labelled
documents, label = ``labels.quality``. Fold results, coefficients and
bootstrap replicates (FIXTURES.md #18): ``events`` with fold =
``event_id % 5``, replicate = ``event_id % 40``, feature = ``event_type``,
coefficient = ``value / 100 - 0.1``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusdelta.operators import features as FT
from corpusdelta.operators import groups as G
from corpusdelta.operators import selection as SE
from corpusdelta.operators import tokens as tok
from corpusdelta.plans.common import rounded, table
from corpusdelta.plans.features_plans import feature_sql
from corpusdelta.session import cut

PLANS: dict = {}


def plan(name, sql=None):
    def deco(fn):
        PLANS[name] = (fn, sql)
        return fn
    return deco


FEATS = ["t_word", "t_stopword", "t_punct", "t_uword", "t_sent", "t_char", "cttr", "entropy",
         "simpsons_d", "avg_word_length", "gunning_fog", "n_noun", "n_verb", "n_adj", "n_propn", "n_x"]


#: The whole feature table of :func:`features.doc_features`.
ALL_FEATS = [c for family in FT.FAMILIES.values() for c in family]


def labelled_features(spark, sf, names=FEATS):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    d = docs.join(lab, "doc_id")
    f = FT.doc_features(tok.annotate_tokens(tok.tokenize(d.select("doc_id", "text"))))
    return lab.join(f, "doc_id").select("doc_id", "quality", *[F.col(c).cast("double") for c in names])


FEAT_SQL = (feature_sql("quality") + ",\nlf AS (SELECT feat.doc_id, l.quality, "
            + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in FEATS)
            + " FROM feat JOIN labels l ON feat.doc_id = l.doc_id)")


# ------------------------------------------------------------------ P11-P17
LINE_NUM = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@plan("numeric_columns", f"SELECT {', '.join(LINE_NUM)} FROM lineitem")
def q_numeric_columns(spark, sf):
    li = table(spark, sf, "lineitem")
    cols = G.numeric_columns(li, exclude=("l_orderkey", "l_partkey", "l_suppkey"))
    return li.select(*cols)


@plan("drop_nested_columns", "SELECT vec_id, label FROM embeddings")
def q_drop_nested_columns(spark, sf):
    return SE.drop_nested_columns(table(spark, sf, "embeddings"))


@plan("drop_constant_columns", FEAT_SQL + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, (COUNT({c}) = 0 OR MIN({c}) = MAX({c})) AS constant FROM lf" for c in FEATS))
def q_drop_constant_columns(spark, sf):
    f = cut(labelled_features(spark, sf))
    const = set(SE.constant_columns(f, FEATS))
    kept = SE.drop_constant_columns(f, FEATS).columns
    assert not (const & set(kept))
    return spark.createDataFrame([(c, c in const) for c in FEATS], "feature string, constant boolean")


RATIO_SQL = "CASE WHEN l_discount = 0 THEN NULL ELSE l_quantity / l_discount END"


def _ratio(spark, sf):
    li = table(spark, sf, "lineitem")
    x = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_quantity") / F.col("l_discount"))
    return li.select("l_orderkey", "l_linenumber", x.alias("x"), F.col("l_tax").alias("y"))


@plan("nonfinite_to_null", f"SELECT l_orderkey, l_linenumber, round({RATIO_SQL}, 6) AS x, round(l_tax, 6) AS y FROM lineitem")
def q_nonfinite_to_null(spark, sf):
    return rounded(SE.nonfinite_to_null(_ratio(spark, sf), ["x", "y"]))


@plan("impute", f"""SELECT l_orderkey, l_linenumber, round(COALESCE({RATIO_SQL}, AVG({RATIO_SQL}) OVER ()), 6) AS x,
round(l_tax, 6) AS y FROM lineitem""")
def q_impute(spark, sf):
    return rounded(SE.impute(SE.nonfinite_to_null(_ratio(spark, sf), ["x", "y"]), ["x", "y"]))


@plan("null_report", f"""SELECT 'x' AS "column", COUNT(*) FILTER (WHERE ({RATIO_SQL}) IS NULL) AS n_null FROM lineitem
HAVING COUNT(*) FILTER (WHERE ({RATIO_SQL}) IS NULL) > 0""")
def q_null_report(spark, sf):
    return SE.null_report(SE.nonfinite_to_null(_ratio(spark, sf), ["x", "y"]), ["x", "y"])


@plan("select_features", FEAT_SQL + "\nSELECT doc_id, t_word, cttr, entropy FROM lf")
def q_select_features(spark, sf):
    return rounded(SE.select_features(labelled_features(spark, sf), ["entropy", "t_word", "cttr"], keep=["doc_id"]))


@plan("add_class_label", FEAT_SQL + "\nSELECT doc_id, t_word, quality AS after FROM lf")
def q_add_class_label(spark, sf):
    f = labelled_features(spark, sf).select("doc_id", "t_word", "quality")
    a = f.filter(F.col("quality") == 0).drop("quality")
    b = f.filter(F.col("quality") == 1).drop("quality")
    return rounded(SE.add_class_label(a, b, "after"))


@plan("standardise", FEAT_SQL + "\nSELECT doc_id, " + ", ".join(
    f"round(CASE WHEN stddev_samp({c}) OVER () > 0 THEN ({c} - AVG({c}) OVER ()) / stddev_samp({c}) OVER () ELSE 0.0 END, 6) AS {c}"
    for c in FEATS) + " FROM lf")
def q_standardise(spark, sf):
    f = labelled_features(spark, sf).select("doc_id", *FEATS)
    return rounded(SE.standardise(f, FEATS))


# ------------------------------------------------------------------ X10-X12, A22
P_SQL = "1.0 / (1.0 + exp(-((cttr - AVG(cttr) OVER ()) / stddev_samp(cttr) OVER ())))"


def _scored(spark, sf):
    f = labelled_features(spark, sf)
    z = SE.standardise(f.select("doc_id", "quality", "cttr"), ["cttr"])
    return z.withColumn("p", 1.0 / (1.0 + F.exp(-F.col("cttr"))))


@plan("binary_log_likelihood", FEAT_SQL + f""",
sc AS (SELECT quality, {P_SQL} AS p FROM lf)
SELECT round(SUM(quality * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - quality) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15))), 6)
AS log_likelihood FROM sc""")
def q_binary_log_likelihood(spark, sf):
    return rounded(SE.binary_log_likelihood(_scored(spark, sf), "quality", "p"))


def _ll(p):
    q = f"least(greatest({p}, 1e-15), 1 - 1e-15)"
    return f"SUM(quality * ln({q}) + (1 - quality) * ln(1 - {q}))"


@plan("pseudo_r2", FEAT_SQL + f""",
sc AS (SELECT quality, {P_SQL} AS p, AVG(CAST(quality AS DOUBLE)) OVER () AS pbar FROM lf),
a AS (SELECT {_ll('p')} AS ll, {_ll('pbar')} AS ll0, COUNT(*) AS n FROM sc)
SELECT round(1 - ll / ll0, 6) AS mcfadden, round((1 - ll / ll0) / (1 - ll0 / n), 6) AS nagelkerke_as_coded,
       round((1 - exp(2 * (ll0 - ll) / n)) / (1 - exp(2 * ll0 / n)), 6) AS nagelkerke FROM a""")
def q_pseudo_r2(spark, sf):
    return rounded(SE.pseudo_r2(_scored(spark, sf), "quality", "p"))


@plan("auc", FEAT_SQL + """,
h AS (SELECT t_word AS s, COUNT(*) FILTER (WHERE quality = 1) AS pos, COUNT(*) FILTER (WHERE quality <> 1) AS neg FROM lf GROUP BY t_word),
c AS (SELECT *, COALESCE(SUM(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM h)
SELECT round(SUM(pos * (below + 0.5 * neg)) / (SUM(pos) * SUM(neg)), 6) AS auc FROM c""")
def q_auc(spark, sf):
    return rounded(SE.auc(labelled_features(spark, sf), "quality", "t_word"))


CORR_FEATS = FEATS


@plan("correlation_matrix", FEAT_SQL + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS feature1, '{b}' AS feature2, round(abs(corr({a}, {b})), 6) AS r FROM lf"
    for i, a in enumerate(CORR_FEATS) for b in CORR_FEATS[i + 1:]))
def q_correlation_matrix(spark, sf):
    return rounded(SE.correlation_matrix(labelled_features(spark, sf), CORR_FEATS))


CORR_PAIRS_SQL = "\nUNION ALL\n".join(
    f"SELECT '{a}' AS feature1, '{b}' AS feature2, abs(corr({a}, {b})) AS r FROM lf"
    for i, a in enumerate(CORR_FEATS) for b in CORR_FEATS[i + 1:])
GROUPS_SQL = ("WITH RECURSIVE " + FEAT_SQL[len("WITH "):] + f""",
cm AS ({CORR_PAIRS_SQL}),
hi AS (SELECT feature1, feature2 FROM cm WHERE r > 0.9 AND NOT isnan(r)),
edges AS (SELECT feature1 AS a, feature2 AS b FROM hi UNION SELECT feature2, feature1 FROM hi),
reach(src, dst) AS (SELECT a, b FROM edges UNION SELECT reach.src, edges.b FROM reach JOIN edges ON reach.dst = edges.a),
root AS (SELECT src AS feature, least(src, MIN(dst)) AS root FROM reach GROUP BY src)
SELECT CAST(dense_rank() OVER (ORDER BY root) - 1 AS INTEGER) AS group_id, feature FROM root""")


@plan("correlated_groups", GROUPS_SQL)
def q_correlated_groups(spark, sf):
    c = SE.correlation_matrix(cut(labelled_features(spark, sf)), CORR_FEATS)
    groups = SE.correlated_groups(c, 0.9)
    return spark.createDataFrame([(i, f) for i, g in enumerate(groups) for f in sorted(g)],
                                 "group_id int, feature string")


PREFILTER_SQL = ("WITH RECURSIVE " + FEAT_SQL[len("WITH "):] + ",\n"
                 + "fl AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', {i})" for i, f in enumerate(FEATS))
                 + ") v(feature, idx)),\ncst AS (" + "\nUNION ALL\n".join(
                     f"SELECT '{c}' AS feature, (COUNT({c}) = 0 OR MIN({c}) = MAX({c})) AS c FROM lf" for c in FEATS)
                 + "),\nkp AS (SELECT fl.feature, fl.idx FROM fl JOIN cst ON fl.feature = cst.feature WHERE NOT cst.c),\n"
                 + "cm AS (" + "\nUNION ALL\n".join(
                     f"SELECT '{a}' AS feature1, '{b}' AS feature2, abs(corr({a}, {b})) AS r FROM lf"
                     for i, a in enumerate(FEATS) for b in FEATS[i + 1:]) + """),
edges AS (SELECT feature1 AS a, feature2 AS b FROM cm WHERE r > 0.9 AND feature1 IN (SELECT feature FROM kp)
          AND feature2 IN (SELECT feature FROM kp)
          UNION SELECT feature2, feature1 FROM cm WHERE r > 0.9 AND feature1 IN (SELECT feature FROM kp)
          AND feature2 IN (SELECT feature FROM kp)),
reach(src, dst) AS (SELECT a, b FROM edges UNION SELECT reach.src, edges.b FROM reach JOIN edges ON reach.dst = edges.a),
comp AS (SELECT src, dst FROM reach UNION SELECT src, src FROM reach),
rep AS (SELECT comp.src AS feature, arg_min(comp.dst, kp.idx) AS rep FROM comp JOIN kp ON kp.feature = comp.dst GROUP BY comp.src)
SELECT feature FROM kp WHERE feature NOT IN (SELECT feature FROM rep WHERE rep <> feature)""")


@plan("feature_prefilter", PREFILTER_SQL)
def q_feature_prefilter(spark, sf):
    keep = SE.feature_prefilter(cut(labelled_features(spark, sf)), FEATS, 0.9)
    return spark.createDataFrame([(f,) for f in keep], "feature string")


# ------------------------------------------------------------------ W8, W10
@plan("stratified_folds", """SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality
ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels""")
def q_stratified_folds(spark, sf):
    return SE.stratified_folds(table(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id", 5, 42)


@plan("balanced_sample", """WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality
ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM labels)
SELECT doc_id, quality FROM r WHERE rn <= (SELECT MIN(c) FROM (SELECT COUNT(*) AS c FROM labels GROUP BY quality))""")
def q_balanced_sample(spark, sf):
    return SE.balanced_sample(table(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id")


# ------------------------------------------------------------------ fold results and coefficients from events
EV_SQL = """ev AS (SELECT CAST(event_id % 5 + 1 AS INTEGER) AS fold, CAST(event_id % 40 AS INTEGER) AS rep, event_type AS feature,
 value / 100 - 0.1 AS coef, value FROM events)"""


def _events(spark, sf):
    e = table(spark, sf, "events")
    return e.select((F.col("event_id") % 5 + 1).cast("int").alias("fold"),
                    (F.col("event_id") % 40).cast("int").alias("rep"),
                    F.col("event_type").alias("feature"), (F.col("value") / 100 - 0.1).alias("coef"), "value")


def _fold_coefs(ev):
    return ev.groupBy("fold", "feature").agg(F.avg("coef").alias("coef"))


@plan("run_mean_std", f"""WITH {EV_SQL},
r AS (SELECT fold, AVG(value) / 100 AS auc, COUNT(*) AS n FROM ev GROUP BY fold)
SELECT CAST(fold AS VARCHAR) AS "row", round(auc, 3) AS auc, round(CAST(n AS DOUBLE), 3) AS n FROM r
UNION ALL SELECT 'mean', round(AVG(auc), 3), round(AVG(n), 3) FROM r
UNION ALL SELECT 'std', round(stddev_pop(auc), 3), round(stddev_pop(n), 3) FROM r""")
def q_run_mean_std(spark, sf):
    ev = _events(spark, sf)
    r = ev.groupBy("fold").agg((F.avg("value") / 100).alias("auc"), F.count(F.lit(1)).alias("n"))
    return SE.run_mean_std(r, ["auc", "n"], "fold", ddof=0)


@plan("selection_counts", f"""WITH {EV_SQL},
l AS (SELECT DISTINCT fold, feature FROM ev WHERE coef > 0.3),
occ AS (SELECT feature, COUNT(*) AS occurrences FROM l GROUP BY feature)
SELECT occurrences, COUNT(*) AS n_features FROM occ GROUP BY occurrences""")
def q_selection_counts(spark, sf):
    ev = _events(spark, sf)
    lists = ev.filter(F.col("coef") > 0.3).select("fold", "feature").distinct()
    _, cc, _ = SE.selection_counts(lists)
    return cc


@plan("fold_stability", f"""WITH {EV_SQL},
fc AS (SELECT fold, feature, AVG(coef) AS coef FROM ev GROUP BY fold, feature)
SELECT feature, round(COUNT(*) FILTER (WHERE coef <> 0) / 5.0, 6) AS selection_freq,
 round(COALESCE(AVG(CASE WHEN coef <> 0 THEN coef END), 0.0), 6) AS avg_std_coef, round(abs(SUM(sign(coef)) / 5.0), 6) AS sign_consistency
FROM fc GROUP BY feature""")
def q_fold_stability(spark, sf):
    return rounded(SE.fold_stability(_fold_coefs(_events(spark, sf)), n_folds=5))


def _summary(spark, sf):
    ev = _events(spark, sf)
    st = SE.fold_stability(_fold_coefs(ev), n_folds=5)
    boot = ev.groupBy("rep", "feature").agg(F.avg("coef").alias("coef"))
    return st.join(SE.bootstrap_ci(boot), "feature")


SUM_SQL = f"""WITH {EV_SQL},
fc AS (SELECT fold, feature, AVG(coef) AS coef FROM ev GROUP BY fold, feature),
st AS (SELECT feature, COUNT(*) FILTER (WHERE coef <> 0) / 5.0 AS selection_freq,
  COALESCE(AVG(CASE WHEN coef <> 0 THEN coef END), 0.0) AS avg_std_coef, abs(SUM(sign(coef)) / 5.0) AS sign_consistency
  FROM fc GROUP BY feature),
bt AS (SELECT rep, feature, AVG(coef) AS coef FROM ev GROUP BY rep, feature),
ci AS (SELECT feature, quantile_cont(coef, 0.025) AS ci_lower, quantile_cont(coef, 0.975) AS ci_upper,
  2 * least(AVG(CASE WHEN coef > 0 THEN 1.0 ELSE 0.0 END), AVG(CASE WHEN coef < 0 THEN 1.0 ELSE 0.0 END)) AS p_approx
  FROM bt GROUP BY feature),
sm AS (SELECT st.*, ci.ci_lower, ci.ci_upper, ci.p_approx, exp(avg_std_coef) AS odds_ratio, (exp(avg_std_coef) - 1) * 100 AS pct_change_odds,
  0.2 * selection_freq + 0.3 * sign_consistency + 0.2 * (1 - p_approx) + 0.3 * abs(avg_std_coef) AS reliability_score
  FROM st JOIN ci ON st.feature = ci.feature)"""


@plan("bootstrap_ci", SUM_SQL + "\nSELECT feature, round(ci_lower, 6) AS ci_lower, round(ci_upper, 6) AS ci_upper, round(p_approx, 6) AS p_approx FROM ci")
def q_bootstrap_ci(spark, sf):
    ev = _events(spark, sf)
    return rounded(SE.bootstrap_ci(ev.groupBy("rep", "feature").agg(F.avg("coef").alias("coef"))))


@plan("odds_ratio", SUM_SQL + "\nSELECT feature, round(odds_ratio, 6) AS odds_ratio, round(pct_change_odds, 6) AS pct_change_odds FROM sm")
def q_odds_ratio(spark, sf):
    from corpusdelta.functions.text import odds_pct_change, odds_ratio
    s = _summary(spark, sf)
    return rounded(s.select("feature", odds_ratio("avg_std_coef").alias("odds_ratio"),
                            odds_pct_change("avg_std_coef").alias("pct_change_odds")))


@plan("reliability_score", SUM_SQL + "\nSELECT feature, round(reliability_score, 6) AS reliability_score FROM sm")
def q_reliability_score(spark, sf):
    return rounded(_summary(spark, sf).select("feature", SE.reliability_score().alias("reliability_score")))


@plan("reliable_features", SUM_SQL + """
SELECT feature, round(reliability_score, 6) AS reliability_score FROM sm WHERE selection_freq >= 0.4 AND sign_consistency >= 0.4
AND p_approx <= 1.0 AND NOT (ci_lower < 0 AND ci_upper > 0) AND abs(pct_change_odds) >= 5""")
def q_reliable_features(spark, sf):
    r = SE.reliable_features(_summary(spark, sf), freq=0.4, sign=0.4, p=1.0, min_pct=5.0)
    return rounded(r.select("feature", "reliability_score"))


@plan("top_features_per_group", SUM_SQL + """,
g AS (SELECT *, substr(feature, 1, 1) AS grp, row_number() OVER (PARTITION BY substr(feature, 1, 1)
      ORDER BY abs(pct_change_odds) DESC, feature) AS rank FROM sm)
SELECT feature, grp, rank FROM g WHERE rank <= 1""")
def q_top_features_per_group(spark, sf):
    s = _summary(spark, sf).withColumn("pct_change_odds", (F.exp("avg_std_coef") - 1) * 100) \
        .withColumn("grp", F.substring("feature", 1, 1))
    return SE.top_features_per_group(s, "grp", 1).select("feature", "grp", "rank")


@plan("head_by_rank", SUM_SQL + "\nSELECT feature, round(reliability_score, 6) AS reliability_score FROM sm ORDER BY reliability_score DESC, feature LIMIT 3")
def q_head_by_rank(spark, sf):
    s = _summary(spark, sf).withColumn("reliability_score", SE.reliability_score())
    return rounded(SE.head_by_rank(s, 3).select("feature", "reliability_score"))


COEF_SQL = """cf AS (SELECT event_type AS term, AVG(value) / 100 - 0.1 AS estimate, stddev_samp(value) / 1000 AS se FROM events GROUP BY event_type)"""


def _coefs(spark, sf):
    e = table(spark, sf, "events")
    c = e.groupBy(F.col("event_type").alias("term")).agg((F.avg("value") / 100 - 0.1).alias("estimate"),
                                                         (F.stddev_samp("value") / 1000).alias("se"))
    return c.withColumn("z", F.col("estimate") / F.col("se")).withColumn("p", F.lit(None).cast("double"))


@plan("wald_ci", f"""WITH {COEF_SQL}
SELECT term, round(exp(estimate), 6) AS odds_ratio, round(exp(estimate - 1.96 * se), 6) AS ci_lower,
 round(exp(estimate + 1.96 * se), 6) AS ci_upper FROM cf""")
def q_wald_ci(spark, sf):
    return rounded(SE.wald_ci(_coefs(spark, sf)).select("term", "odds_ratio", "ci_lower", "ci_upper"))


@plan("odds_table", f"""WITH {COEF_SQL}
SELECT term, round(exp(estimate), 6) AS odds_ratio, round(se, 6) AS se, round(estimate / se, 6) AS z FROM cf""")
def q_odds_table(spark, sf):
    return rounded(SE.wald_ci(_coefs(spark, sf)).select("term", "odds_ratio", "se", "z"))


@plan("relative_importance", f"""WITH {COEF_SQL}
SELECT term, round(power(estimate / se, 2), 6) AS chi2, round(round(power(estimate / se, 2) / SUM(power(estimate / se, 2)) OVER () * 100, 2), 6)
AS share FROM cf""")
def q_relative_importance(spark, sf):
    return rounded(SE.relative_importance(_coefs(spark, sf)))


# ------------------------------------------------------------------ model fits (rows only)
def _fit_features(spark, sf, names=FEATS):
    """The cleaned feature table (P13-P15) and the features that the prefilter
    keeps (M23)."""
    f = SE.drop_constant_columns(cut(labelled_features(spark, sf, names)), names)
    left = [c for c in names if c in f.columns]
    f = cut(SE.impute(SE.nonfinite_to_null(f, left), left))
    return f, SE.feature_prefilter(f, left, 0.9)


@plan("logistic_regression")
def q_logistic_regression(spark, sf):
    f, kept = _fit_features(spark, sf)
    return rounded(SE.logistic_regression(SE.standardise(f, kept), kept, "quality"))


@plan("regression_report")
def q_regression_report(spark, sf):
    """M19 -> M20 -> M21, X13, X14: the odds table of the fitted regression."""
    f, kept = _fit_features(spark, sf)
    fit = cut(SE.logistic_regression(SE.standardise(f, kept), kept, "quality"))
    return rounded(SE.wald_ci(fit).join(SE.relative_importance(fit), "term", "left"))


@plan("elastic_net_nested_cv")
def q_elastic_net_nested_cv(spark, sf):
    f, kept = _fit_features(spark, sf)
    res, coefs = SE.elastic_net_nested_cv(f, kept, "quality", "doc_id", outer=5, inner=5, n_iter=20)
    return rounded(res)


@plan("bootstrap_refits")
def q_bootstrap_refits(spark, sf):
    f, kept = _fit_features(spark, sf)
    boot = SE.bootstrap_coefs(f, kept, "quality", "doc_id", reps=200)
    return rounded(SE.bootstrap_ci(boot))


@plan("feature_selection")
def q_feature_selection(spark, sf):
    """P13-P15 -> M23 -> M17 -> A20, X15 -> X16, X17, F13 over the whole feature
    table: every feature that the prefilter keeps, with its stability over the
    outer folds, bootstrap interval, score and verdict."""
    f, kept = _fit_features(spark, sf, ALL_FEATS)
    chosen = SE.robust_feature_selection(f, kept, "quality", "doc_id", outer=5, inner=5, n_iter=20, reps=200)
    return rounded(SE.with_reliability(chosen.summary))


@plan("paired_logistic")
def q_paired_logistic(spark, sf):
    f, kept = _fit_features(spark, sf)
    f = SE.standardise(f, kept).withColumn("pair_id", (F.col("doc_id") / 2).cast("long"))
    return rounded(SE.paired_logistic(f, kept, "quality", "pair_id"))
