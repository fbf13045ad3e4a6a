"""Group statistics over a feature table.

Aggregations run wide (one ``groupBy(group)`` with every feature's
aggregates, partial-aggregated before the exchange) and only the small
result is unpivoted to long form; the document-level table is never
multiplied by the number of features.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusdelta.operators.tokens import rank_within

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns minus ids/labels, in table order (schema only)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC) and f.name not in exclude]


def group_means(features: DataFrame, by: str, cols: Sequence[str] | None = None) -> DataFrame:
    """A5 (wide): one row per group, the mean of every feature."""
    cols = list(cols or numeric_columns(features, exclude=(by, "doc_id")))
    return features.groupBy(by).agg(*[F.avg(c).alias(c) for c in cols])


def group_means_long(features: DataFrame, by: str, cols: Sequence[str] | None = None) -> DataFrame:
    """A5 (long): ``(group, feature, mean)``: the feature x group matrix."""
    cols = list(cols or numeric_columns(features, exclude=(by, "doc_id")))
    wide = group_means(features, by, cols)
    return wide.unpivot(by, cols, "feature", "mean")


def group_stats_long(features: DataFrame, by: str, cols: Sequence[str] | None = None) -> DataFrame:
    """``(group, feature, mean, std, median)``; std is the sample sd, the
    median the exact one (the mean of the two middle values if their number is
    even). Values are ranked by range partitions, so a group of any size is
    spread over many tasks."""
    cols = list(cols or numeric_columns(features, exclude=(by, "doc_id")))
    values = (features.select(by, *[F.col(c).cast("double").alias(c) for c in cols])
              .unpivot(by, cols, "feature", "value"))
    stats = values.groupBy(by, "feature").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("_n"))
    ranked = rank_within(values.where(F.col("value").isNotNull()), [by, "feature"], ["value"], "_r")
    sizes = stats.select(F.col(by).alias("_by"), F.col("feature").alias("_feature"), "_n")
    middle = ranked.join(sizes, F.col(by).eqNullSafe(F.col("_by")) & (F.col("feature") == F.col("_feature"))).where(
        (F.col("_r") == F.floor((F.col("_n") + 1) / 2)) | (F.col("_r") == F.floor((F.col("_n") + 2) / 2)))
    median = middle.groupBy("_by", "_feature").agg(F.avg("value").alias("median"))
    return (stats.join(median, F.col(by).eqNullSafe(F.col("_by")) & (F.col("feature") == F.col("_feature")), "left")
            .select(by, "feature", "mean", "std", "median"))


def _gaps(means_long: DataFrame) -> DataFrame:
    return means_long.groupBy("feature").agg(
        F.max("mean").alias("_max"), F.min("mean").alias("_min"),
        F.avg(F.abs("mean")).alias("_mabs"))


def feature_gaps_mean(means_long: DataFrame, groups: Sequence[str] = (), by: str = "corpus") -> DataFrame:
    """``abs_gap = max - min`` over group means,
    ``rel_gap = abs_gap / (mean(|means|) + 1e-9)``, largest first, and beside
    them the mean of each of the named ``groups``."""
    g = means_long.groupBy("feature").agg(
        F.max("mean").alias("_max"), F.min("mean").alias("_min"), F.avg(F.abs("mean")).alias("_mabs"),
        *[F.max(F.when(F.col(by) == c, F.col("mean"))).alias(c) for c in groups])
    out = g.select("feature", (F.col("_max") - F.col("_min")).alias("abs_gap"),
                   ((F.col("_max") - F.col("_min")) / (F.col("_mabs") + 1e-9)).alias("rel_gap"), *groups)
    return out.orderBy(F.col("rel_gap").desc(), "feature")


def feature_gaps_sum(means_long: DataFrame) -> DataFrame:
    """Same with ``rel_gap = (max - min) / (|max| + |min| + 1e-9)``."""
    g = _gaps(means_long)
    out = g.select("feature", (F.col("_max") - F.col("_min")).alias("abs_gap"),
                   ((F.col("_max") - F.col("_min"))
                    / (F.abs("_max") + F.abs("_min") + 1e-9)).alias("rel_gap"))
    return out.orderBy(F.col("rel_gap").desc(), "feature")


def per_word_means(group_means_wide: DataFrame, by: str,
                   cols: Sequence[str] = ("t_stopword", "t_punct", "t_uword", "t_sent", "t_char"),
                   denom: str = "t_word") -> DataFrame:
    """``<feature>_pw = mean(feature) / mean(t_word)`` (ratio of means)."""
    return group_means_wide.select(by, *[F.try_divide(F.col(c), F.col(denom)).alias(f"{c}_pw")
                                         for c in cols])
