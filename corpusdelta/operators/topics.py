"""Topic modelling (M12-M16, A12), re-aimed onto MLlib: TF-IDF features,
(bisecting) k-means clusters, small clusters as the outlier topic -1,
class-based TF-IDF topic words and MMR diversification."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusdelta.operators.vectors import dot, norm


def topic_model(docs: DataFrame, k: int = 20, min_topic_size: int = 100, seed: int = 42,
                text: str = "text", doc: str = "doc_id", num_features: int = 1 << 14) -> DataFrame:
    """Documents -> topic id. Word tokens -> HashingTF -> IDF ->
    normalised -> KMeans; clusters smaller than ``min_topic_size`` become -1.
    Returns ``(doc_id, topic)``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    d = docs.select(doc, F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), 0).alias("_w"))
    pipe = Pipeline(stages=[HashingTF(inputCol="_w", outputCol="_tf", numFeatures=num_features),
                            IDF(inputCol="_tf", outputCol="_idf"),
                            Normalizer(inputCol="_idf", outputCol="_x"),
                            KMeans(featuresCol="_x", predictionCol="_t", k=k, seed=seed)])
    out = pipe.fit(d).transform(d).select(doc, F.col("_t").cast("long").alias("topic"))
    sizes = out.groupBy("topic").count()
    small = [r["topic"] for r in sizes.filter(F.col("count") < min_topic_size).collect()]   # <= k rows
    return out.withColumn("topic", F.when(F.col("topic").isin(*small), F.lit(-1)).otherwise(F.col("topic")))


def _distances(df: DataFrame, vec: str, topic: str) -> "F.Column":
    """Array of (distance to the topic's centroid, topic) of a row. The
    centroids, one per topic (their number is the model's parameter), travel as
    a literal array, so every row finds its distances locally: no join."""
    d = len(df.select(vec).first()[0])
    rows = (df.filter(F.col(topic) != -1).groupBy(topic)
            .agg(*[F.avg(F.element_at(vec, i + 1)).alias(f"_c{i}") for i in range(d)])
            .select(F.col(topic).alias("_topic"), F.array(*[F.col(f"_c{i}") for i in range(d)]).alias("_cen"))
            .orderBy("_topic").collect())
    cents = F.array(*[F.struct(F.lit(r["_topic"]).alias("t"),
                               F.array(*[F.lit(float(v)) for v in r["_cen"]]).alias("c")) for r in rows])

    def dist(c):
        return F.sqrt(F.aggregate(F.zip_with(F.col(vec), c["c"], lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)),
                                  F.lit(0.0), lambda s, x: s + x))
    return F.transform(cents, lambda c: F.struct(dist(c).alias("d"), c["t"].alias("t")))


def reassign_outliers(df: DataFrame, vec: str = "vec", topic: str = "topic") -> DataFrame:
    """Documents of topic -1 move to the topic of the highest probability
    (:func:`topic_probability`), which is the one with the nearest centroid."""
    nearest = F.array_min(_distances(df, vec, topic))["t"]
    return df.withColumn(topic, F.when(F.col(topic) == -1, nearest).otherwise(F.col(topic)))


def topic_probability(df: DataFrame, vec: str = "vec", topic: str = "topic", name: str = "prob") -> DataFrame:
    """Add the probability of the row's own topic, ``exp(-distance)`` to its
    centroid as a share of the sum over all topics; 0 for topic -1."""
    scored = _distances(df, vec, topic)
    total = F.aggregate(scored, F.lit(0.0), lambda s, x: s + F.exp(-x["d"]))
    own = F.aggregate(scored, F.lit(0.0), lambda s, x: s + F.when(x["t"] == F.col(topic), F.exp(-x["d"])).otherwise(0.0))
    return df.withColumn(name, F.try_divide(own, total))


def topic_terms(tokens: DataFrame, n: int = 10, topic: str = "topic", term: str = "term") -> DataFrame:
    """Class-based TF-IDF ``tf(t, c) * ln(1 + A / f(t))`` with A the
    average number of words per topic and f(t) the count of t over all
    topics; top-n per topic (ties by term)."""
    tf = tokens.groupBy(topic, term).agg(F.count(F.lit(1)).alias("tf"))
    ft = tf.groupBy(term).agg(F.sum("tf").alias("f"))
    a = tf.agg((F.sum("tf") / F.count_distinct(topic)).alias("a")).first()["a"]
    s = tf.join(ft, term).withColumn("score", F.col("tf") * F.log1p(F.lit(a) / F.col("f")))
    w = Window.partitionBy(topic).orderBy(F.round("score", 9).desc(), F.col(term))
    return s.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n)


def mmr_terms(cands: DataFrame, n: int = 10, diversity: float = 0.3, topic: str = "topic") -> DataFrame:
    """Maximal marginal relevance per topic over a bounded candidate
    list ``(topic, term, score, vec)``: repeatedly take the term maximising
    (1-diversity) sim(term, topic) - diversity max sim(term, chosen), with
    the topic vector the score-weighted mean of the candidates."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("term").reset_index(drop=True)
        x = np.vstack(pdf.vec.to_numpy()).astype(np.float64)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        tv = (pdf.score.to_numpy()[:, None] * x).sum(0)
        tv = tv / max(np.linalg.norm(tv), 1e-12)
        rel = x @ tv
        chosen = [int(np.argmax(rel))]
        while len(chosen) < min(n, len(pdf)):
            rest = [i for i in range(len(pdf)) if i not in chosen]
            red = (x[rest] @ x[chosen].T).max(1)
            val = (1 - diversity) * rel[rest] - diversity * red
            chosen.append(rest[int(np.argmax(val))])
        out = pdf.iloc[chosen][[topic, "term"]].copy()
        out["mmr_rank"] = np.arange(1, len(chosen) + 1, dtype=np.int64)
        return out
    return cands.groupBy(topic).applyInPandas(fn, f"{topic} long, term string, mmr_rank long")


def document_topics(docs: DataFrame, assign: DataFrame, terms: DataFrame, doc: str = "doc_id",
                    topic: str = "topic", n_name: int = 3) -> DataFrame:
    """Documents with topic id, name (``id_term1_term2_term3``) and the
    further columns of ``assign`` (the probability)."""
    names = (terms.filter(F.col("rank") <= n_name).groupBy(topic)
             .agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("_t"))
             .select(topic, F.concat_ws("_", F.col(topic).cast("string"), F.array_join("_t.term", "_")).alias("name")))
    return docs.join(assign, doc).join(names, topic, "left")


def topic_period_table(df: DataFrame, name: str = "name", periods: Sequence[str] = ("t1", "t2")) -> DataFrame:
    """Topic x period counts and percentages. ``perc_in_t1_norm`` is
    the literal computation (it equals ``perc_in_t1``); ``share_t1_by_period``
    normalises by the period totals instead."""
    a, b = periods
    p = df.groupBy(name).pivot("time", list(periods)).count()
    tot = {r["time"]: r["count"] for r in df.groupBy("time").count().collect()}   # one row per period
    p = (p.withColumn("total_t1t2", F.col(a) + F.col(b))
         .withColumn("perc_in_t1", F.col(a) / F.col("total_t1t2") * 100)
         .withColumn("perc_in_t2", F.col(b) / F.col("total_t1t2") * 100)
         .withColumn("total_t1t2_norm", F.col("perc_in_t1") + F.col("perc_in_t2"))
         .withColumn("perc_in_t1_norm", F.col("perc_in_t1") / F.col("total_t1t2_norm") * 100)
         .withColumn("perc_in_t2_norm", F.col("perc_in_t2") / F.col("total_t1t2_norm") * 100))
    ra = F.col(a) / F.lit(tot.get(a, 0))
    rb = F.col(b) / F.lit(tot.get(b, 0))
    return p.withColumn("share_t1_by_period", ra / (ra + rb) * 100)
