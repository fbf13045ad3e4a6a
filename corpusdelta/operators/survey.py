"""Paired human ratings.

All statistics are aggregates per rating dimension (a handful of rows);
p-values are computed on those rows with ``math``-only helpers.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusdelta.functions import stats as S
from corpusdelta.functions import text as T

# fixed values: rating dimensions and the rating order of the share table
DIMENSIONS = ["clarity", "authenticity", "convincingness", "excitement"]
RATING_ORDER = ["human strong", "human moderate", "neutral", "model moderate", "model strong"]


def preferences(df: DataFrame, dims: Sequence[str] = DIMENSIONS, human_col: str = "which_text_is_human",
                human_a_value: str = "A=human") -> DataFrame:
    """F15 + F16: per dimension ``<dim>_preference`` and ``<dim>_score``."""
    is_a = F.col(human_col) == human_a_value
    out = df
    for d in dims:
        lab = T.preference_label(F.col(f"{d}_1"), F.col(f"{d}_2"), is_a)
        out = out.withColumn(f"{d}_preference", lab).withColumn(f"{d}_score", T.preference_score(lab))
    return out


def scores_long(df: DataFrame, id_col: str, dims: Sequence[str] = DIMENSIONS) -> DataFrame:
    """U5 on the scores: ``(id, dimension, score)``."""
    return df.unpivot([id_col], [f"{d}_score" for d in dims], "dimension", "score") \
        .withColumn("dimension", F.regexp_replace("dimension", "_score$", ""))


def rating_shares(df: DataFrame, id_col: str, dims: Sequence[str] = DIMENSIONS) -> DataFrame:
    """A13 (+ W12): percent of each preference per dimension including zero
    cells (the 4 x 5 grid), wide in the fixed rating order."""
    long = df.unpivot([id_col], [f"{d}_preference" for d in dims], "dimension", "rating") \
        .withColumn("dimension", F.regexp_replace("dimension", "_preference$", ""))
    counts = long.groupBy("dimension", "rating").agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.createDataFrame([(d, r) for d in dims for r in RATING_ORDER],
                                           "dimension string, rating string")
    full = F.broadcast(grid).join(counts, ["dimension", "rating"], "left").fillna(0, subset=["n"])
    full = share_of_partition(full, "n", ["dimension"], "pct")
    return full.groupBy("dimension").pivot("rating", RATING_ORDER).agg(F.first("pct"))


def share_of_partition(df: DataFrame, value: str, by: Sequence[str], out: str = "pct") -> DataFrame:
    """Value as a percent of its partition total (bounded partitions)."""
    w = Window.partitionBy(*by)
    return df.withColumn(out, F.try_divide(F.col(value) * 100.0, F.sum(value).over(w)))


def score_summary(long: DataFrame) -> DataFrame:
    """X7 + X9 (SQL part): n, mean, sample sd, t statistic and Cohen's d per
    dimension."""
    g = long.filter(F.col("score").isNotNull()).groupBy("dimension").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"))
    return (g.withColumn("t", F.try_divide(F.col("mean"), F.col("sd") / F.sqrt("n")))
            .withColumn("cohens_d", F.try_divide(F.col("mean"), F.col("sd"))))


def signed_rank_summary(long: DataFrame) -> DataFrame:
    """X8 (SQL part): Wilcoxon signed-rank with zeros dropped: ranks of |x|
    averaged over ties, from a histogram of distinct |x| per dimension
    (cumulative counts over distinct values), ``W = min(W+, W-)``."""
    nz = long.filter(F.col("score").isNotNull() & (F.col("score") != 0)) \
        .withColumn("a", F.abs("score").cast("double"))
    h = nz.groupBy("dimension", "a").agg(F.count(F.lit(1)).alias("c"),
                                         F.count_if(F.col("score") > 0).alias("cpos"))
    w = Window.partitionBy("dimension").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("below", F.coalesce(F.sum("c").over(w), F.lit(0)))
    h = h.withColumn("rank", F.col("below") + (F.col("c") + 1) / 2.0)
    cube = F.col("c").cast("double") * F.col("c") * F.col("c")      # beyond a long from two million ties on
    return (h.groupBy("dimension").agg(
        F.sum(F.col("rank") * F.col("cpos")).alias("w_plus"),
        F.sum(F.col("rank") * (F.col("c") - F.col("cpos"))).alias("w_minus"),
        F.sum("c").alias("n_nonzero"),
        F.sum(cube - F.col("c")).alias("tie_term"))
        .withColumn("w", F.least("w_plus", "w_minus")))


def preference_tests(long: DataFrame) -> DataFrame:
    """X7-X9 with p-values: one-sample t test against 0 (t with n-1 df),
    Wilcoxon signed-rank (normal approximation with tie correction), Cohen's
    d. Both inputs to the driver have one row per dimension."""
    a = {r["dimension"]: r.asDict() for r in score_summary(long).collect()}
    b = {r["dimension"]: r.asDict() for r in signed_rank_summary(long).collect()}
    rows = []
    for d in sorted(a):
        s = a[d]
        t = s["t"]
        p_t = S.t_two_sided_p(t, s["n"] - 1) if t is not None else None
        w = b.get(d)
        p_w = None
        if w and w["n_nonzero"]:
            n = w["n_nonzero"]
            mu = n * (n + 1) / 4.0
            var = n * (n + 1) * (2 * n + 1) / 24.0 - w["tie_term"] / 48.0
            p_w = min(1.0, 2 * S.normal_sf(abs(w["w"] - mu) / math.sqrt(var))) if var > 0 else 1.0
        rows.append((d, int(s["n"]), float(s["mean"]), t, p_t, w["w"] if w else None, p_w, s["cohens_d"]))
    return long.sparkSession.createDataFrame(
        rows, "dimension string, n long, mean double, t double, p_t double, w double, p_w double, cohens_d double")
