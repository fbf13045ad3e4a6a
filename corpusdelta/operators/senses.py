"""Sense clustering of target words.

Sentences per target can be sampled (W9); clustering needs no target's
sentences together, so neither their number nor that of the targets is bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def target_sentences(sentences: DataFrame, targets: DataFrame, lemmas: str = "lemmas",
                     keep: Sequence[str] = ("time",), sent: str = "sent_id") -> DataFrame:
    """Inverted index lookup: distinct (target, sentence) pairs whose
    lemma array contains the target (a sentence is listed once even when
    the lemma repeats)."""
    t = targets.select("target").distinct()
    ex = sentences.select(*keep, sent, F.explode(F.array_distinct(lemmas)).alias("target"))
    return ex.join(t, "target").select("target", *keep, sent)


def sample_per_group(df: DataFrame, by: Sequence[str], n: int, key: str = "sent_id",
                     seed: int = 42) -> DataFrame:
    """At most n rows per group, chosen by a seeded hash order (md5,
    reproducible in SQL); rank <= n runs as a partial WindowGroupLimit."""
    w = Window.partitionBy(*by).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def target_embeddings(sent_tokens: DataFrame, hits: DataFrame, vectors: DataFrame,
                      window: int = 5, tokens: str = "tokens", sent: str = "sent_id",
                      keep: Sequence[str] = ("time",), encoder=None) -> DataFrame:
    """M9: one vector per (target, sentence), with the ``keep`` columns of the
    hit: by default the mean of the word vectors within +-window tokens of the
    first occurrence of the target (the target itself excluded); sentences
    without a vector in the context are skipped. ``encoder`` plugs in another
    model through ``mapInPandas`` (pandas batch of target/sentence rows ->
    ``vec``)."""
    j = hits.join(sent_tokens.select(sent, tokens), sent)
    cols = ["target", *keep, sent]
    if encoder is not None:
        kinds = ", ".join(f"{c} {hits.schema[c].dataType.simpleString()}" for c in cols)
        return j.mapInPandas(lambda it: (encoder(b) for b in it), f"{kinds}, vec array<double>")
    pos = F.array_position(F.col(tokens), F.col("target"))
    ctx = j.select(*cols, tokens, pos.alias("_p")).filter(F.col("_p") > 0)
    ctx = ctx.select(*cols, F.posexplode(
        F.slice(tokens, F.greatest(F.col("_p") - window, F.lit(1)),
                F.col("_p") - F.greatest(F.col("_p") - window, F.lit(1)) + window + 1)).alias("_i", "word"),
        (F.col("_p") - F.greatest(F.col("_p") - window, F.lit(1))).alias("_self"))
    ctx = ctx.filter(F.col("_i") != F.col("_self"))
    v = ctx.join(vectors.select("word", "vec"), "word")
    d = len(vectors.select("vec").first()[0])
    return (v.groupBy(*cols)
            .agg(*[F.avg(F.element_at("vec", i + 1)).alias(f"_d{i}") for i in range(d)])
            .select(*cols, F.array(*[F.col(f"_d{i}") for i in range(d)]).alias("vec")))


def cluster_target_senses(emb: DataFrame, k: int = 8, seed: int = 42, sent: str = "sent_id",
                          keep: Sequence[str] = ("time",), restarts: int = 3) -> DataFrame:
    """M10 + M11: k-means (k-means++ seeds) of each target's sentence vectors,
    all targets in the same passes (see batched_kmeans); returns the cluster and
    the cosine distance to the own centroid."""
    from corpusdelta.operators.batched_kmeans import cluster
    found = cluster(emb.select("target", sent, "vec", *keep), "target", "vec", sent, k, seed, restarts)
    return found.select("target", sent, *keep, "clust", "dist")


def centroid_distance(emb: DataFrame, by: Sequence[str] = ("target", "clust")) -> DataFrame:
    """M11 with given labels: cosine distance of each vector to the mean
    vector of its (target, cluster)."""
    d = len(emb.select("vec").first()[0])
    cent = emb.groupBy(*by).agg(*[F.avg(F.element_at("vec", i + 1)).alias(f"_c{i}") for i in range(d)])
    cent = cent.select(*by, F.array(*[F.col(f"_c{i}") for i in range(d)]).alias("_cen"))
    from corpusdelta.operators.vectors import dot, norm
    j = emb.join(cent, list(by))
    return j.withColumn("dist", 1 - F.coalesce(F.try_divide(dot("vec", "_cen"), norm("vec") * norm("_cen")),
                                               F.lit(0.0))).drop("_cen")


def centroid_order(df: DataFrame, by: Sequence[str] = ("target", "clust"), sent: str = "sent_id") -> DataFrame:
    """Order inside each cluster by distance to the centroid."""
    w = Window.partitionBy(*by).orderBy("dist", sent)
    return df.withColumn("order", F.row_number().over(w).cast("long"))


def kwic(df: DataFrame, keyword, tokens: str = "tokens", width: int = 8) -> DataFrame:
    """Keyword in context: for each hit (case-insensitive) up to
    ``width`` tokens before it, counted since the previous hit, then the hit;
    after the last hit up to ``width`` tokens. Segments joined by `` & ``."""
    kw = F.lower(keyword if not isinstance(keyword, str) else F.lit(keyword))
    t = F.col(tokens)
    df = df.withColumn("_hits", F.filter(F.sequence(F.lit(1), F.greatest(F.size(t), F.lit(1))),
                                         lambda i: F.coalesce(F.lower(F.try_element_at(t, i)) == kw,
                                                              F.lit(False))))
    hits = F.col("_hits")
    nh = F.size(hits)

    def seg(j):
        h = F.element_at(hits, j)
        prev = F.when(j > 1, F.element_at(hits, F.greatest(j - 1, F.lit(1)))).otherwise(F.lit(0))
        start = F.greatest(prev + 1, h - width)
        return F.concat_ws(" & ", F.array_join(F.slice(t, start, h - start), " "), F.element_at(t, h))
    last = F.when(nh > 0, F.element_at(hits, -1)).otherwise(F.lit(0))
    right = F.array_join(F.slice(t, last + 1, F.lit(width)), " ")
    segs = F.transform(F.sequence(F.lit(1), nh + 1), lambda j: F.when(j <= nh, seg(j)).otherwise(right))
    return df.withColumn("kwic", F.array_join(segs, " & ")).drop("_hits")


def cluster_period_table(df: DataFrame, periods: Sequence[str] = ("t1", "t2"),
                         fill_zero: bool = False, by: Sequence[str] = ("target",)) -> DataFrame:
    """Per target, cluster x period counts, ``total`` and ``prop_t2``; a
    period with no sentences gives a NULL total as in the reference (or 0
    with ``fill_zero``)."""
    p = df.groupBy(*by, "clust").pivot("time", list(periods)).count()
    if fill_zero:
        p = p.fillna(0, subset=list(periods))
    a, b = periods
    return (p.withColumn("total", F.col(a) + F.col(b))
            .withColumn("prop_t2", F.try_divide(F.col(b).cast("double"), F.col("total"))))
