"""Keyness: two-corpus comparison of frequency tables (J1-J3, X1-X4),
content-word filters (P1-P4, P8-P10, P20-P22), rankings (W1, W2, T2),
report joins (J9-J11, J14) and pair summaries (A14-A16).

Design: a comparison of two corpora is *one* conditional aggregation
``groupBy(target).agg(sum(freq if corpus=c1), sum(freq if corpus=c2))`` rather
than a join of two vocabularies, so it costs one exchange; the inner join is
the ``having both > 0`` variant. The aggregate is checkpointed once; corpus
totals (one row per corpus) are joined, or read as two numbers for two corpora.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusdelta.functions import fixed
from corpusdelta.functions import stats as S
from corpusdelta.session import cut

KEYS = ["target", "lemma", "pos"]
MEASURES = ["freq_norm1", "freq_norm2", "ratio_t2", "ratio_t1",
            "logratio_t1", "logratio_t2", "ll"]


def keyness_measures(df: DataFrame, total1="total1", total2="total2") -> DataFrame:
    """X1-X4 on a table with ``freq1``, ``freq2`` and the two totals."""
    t1 = F.col(total1) if isinstance(total1, str) else total1
    t2 = F.col(total2) if isinstance(total2, str) else total2
    return (df.withColumn("freq_norm1", S.per_million("freq1", t1))
            .withColumn("freq_norm2", S.per_million("freq2", t2))
            .withColumn("ratio_t2", S.ratio("freq_norm2", "freq_norm1"))
            .withColumn("ratio_t1", S.ratio("freq_norm1", "freq_norm2"))
            .withColumn("logratio_t1", S.log_ratio("ratio_t1"))
            .withColumn("logratio_t2", S.log_ratio("ratio_t2"))
            # target corpus = 2, base = 1 (the measure is symmetric)
            .withColumn("ll", S.log_likelihood("freq2", "freq1", t2, t1)))


def _side_agg(df: DataFrame, keys: Sequence[str], cond1: Column, cond2: Column,
              value: Column | None, how: str) -> DataFrame:
    v = F.lit(1) if value is None else value
    agg = df.groupBy(*keys).agg(
        F.sum(F.when(cond1, v)).cast("long").alias("freq1"),
        F.sum(F.when(cond2, v)).cast("long").alias("freq2"))
    return agg


def _finish(agg: DataFrame, keys: Sequence[str], how: str,
            totals: tuple[int, int] | None) -> DataFrame:
    agg = (agg.withColumn("freq1", F.coalesce("freq1", F.lit(0)).cast("long"))
              .withColumn("freq2", F.coalesce("freq2", F.lit(0)).cast("long")))
    if totals is None:
        # The aggregate is the persistence point: checkpoint it once, read the
        # two corpus sizes from it (a tiny job), then rank/filter from it.
        agg = cut(agg)
        row = agg.agg(F.sum("freq1").cast("long"), F.sum("freq2").cast("long")).first()
        totals = (row[0] or 0, row[1] or 0)
    out = agg
    if how == "inner":
        out = out.filter((F.col("freq1") > 0) & (F.col("freq2") > 0))
    elif how not in ("outer", "full", "full_outer"):
        raise ValueError(f"how must be inner or outer, got {how!r}")
    out = keyness_measures(out, F.lit(totals[0]).cast("long"), F.lit(totals[1]).cast("long"))
    return out.select(*keys, "freq1", "freq2", *MEASURES)


def corpus_totals(totals: DataFrame, by: str = "corpus") -> dict:
    """The ``(by, total)`` rows of the compared corpora as a dict."""
    return {r[by]: r["total"] for r in totals.collect()}


def keyness(freqs: DataFrame, corpus1: str, corpus2: str, how: str = "inner",
            totals=None, by: str = "corpus",
            keys: Sequence[str] = KEYS) -> DataFrame:
    """Compare corpus2 (target, t2) against corpus1 (base, t1) in a
    long frequency table ``(by, target, lemma, pos, freq)``.

    ``totals`` gives corpus sizes, e.g. the unigram totals for n-gram tables
    (A4), as a ``(by, total)`` DataFrame or a ``{corpus: total}`` dict; by
    default they are the sums of ``freq``."""
    f = freqs.filter(F.col(by).isin(corpus1, corpus2))
    agg = _side_agg(f, keys, F.col(by) == corpus1, F.col(by) == corpus2, F.col("freq"), how)
    tot = None
    if isinstance(totals, dict):
        tot = (totals.get(corpus1, 0), totals.get(corpus2, 0))
    elif totals is not None:
        size = corpus_totals(totals.filter(F.col(by).isin(corpus1, corpus2)), by)
        tot = (size.get(corpus1, 0), size.get(corpus2, 0))
    return _finish(agg, keys, how, tot)


def keyness_from_tokens(tokens: DataFrame, side_col: str, side1, side2,
                        how: str = "inner", key: str = "target") -> DataFrame:
    """Fused A1 + J1: count both sides straight from the token table in a
    single aggregation (one exchange on the target)."""
    from corpusdelta.functions import text as T
    t = tokens.filter(F.col(side_col).isin(side1, side2))
    agg = _side_agg(t, [key], F.col(side_col) == side1, F.col(side_col) == side2, None, how)
    out = _finish(agg, [key], how, None)
    return out.select(F.col(key).alias("target"), T.split_lemma(key).alias("lemma"),
                      T.split_pos(key).alias("pos"), "freq1", "freq2", *MEASURES)


def keyness_all_pairs(freqs: DataFrame, how: str = "inner", by: str = "corpus",
                      totals: DataFrame | None = None,
                      pairs: Sequence[tuple[str, str]] | None = None,
                      min_freq: int = 0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keyness for every pair of corpora (or the listed pairs) in one plan.

    Corpus totals are joined to the frequency table once, before pairs form.
    ``inner``: an equi-join of the frequency table with itself on the target,
    ``corpus1 < corpus2``; since ``(corpus, target)`` is unique a target has at
    most one row per corpus, so the join emits exactly the result rows and no
    key can be hot. A list of pairs is joined first, so only its pairs form.
    ``outer``: every frequency row goes to the pairs its corpus takes part in
    and one aggregation on ``(pair, target)`` forms both sides. No driver loop
    over pairs."""
    spark = freqs.sparkSession
    if totals is None:
        freqs = cut(freqs)        # read twice: once for the totals, once here
        totals = freqs.groupBy(by).agg(F.sum("freq").cast("long").alias("total"))
    sizes = totals.select(F.col(by).alias("_c"), F.col("total").cast("long").alias("_total"))
    f = freqs if min_freq <= 0 else freqs.filter(F.col("freq") >= min_freq)
    wanted = None
    if pairs is not None:
        kind = freqs.schema[by].dataType.simpleString()
        wanted = spark.createDataFrame([tuple(p) for p in pairs], f"corpus1 {kind}, corpus2 {kind}").distinct()
    if how == "inner":
        f = f.join(sizes, f[by] == sizes["_c"]).drop("_c")
        a = f.select(F.col(by).alias("corpus1"), *keys, F.col("freq").alias("freq1"), F.col("_total").alias("total1"))
        b = f.select(F.col(by).alias("_corpus2"), *[F.col(k).alias(f"_{k}") for k in keys],
                     F.col("freq").alias("freq2"), F.col("_total").alias("total2"))
        same = [F.col(k) == F.col(f"_{k}") for k in keys]
        if wanted is not None:
            out = a.join(wanted, "corpus1").join(b, [*same, F.col("corpus2") == F.col("_corpus2")]).drop("_corpus2")
        else:
            out = (a.join(b, [*same, F.col("corpus1") < F.col("_corpus2")])
                   .withColumnRenamed("_corpus2", "corpus2"))
        out = out.drop(*[f"_{k}" for k in keys])
    else:
        if wanted is None:        # one literal for each corpus
            names = F.array(*[F.lit(r[by]) for r in totals.select(by).orderBy(by).collect()])
            j = (f.withColumn("_o", F.explode(F.filter(names, lambda x: x != F.col(by))))
                 .withColumns({"corpus1": F.least(by, "_o"), "corpus2": F.greatest(by, "_o")}))
        else:
            sides = wanted.select(F.col("corpus1").alias(by), "*").union(wanted.select(F.col("corpus2").alias(by), "*"))
            j = f.join(sides.distinct(), by)
        out = j.groupBy("corpus1", "corpus2", *keys).agg(
            F.coalesce(F.sum(F.when(F.col(by) == F.col("corpus1"), F.col("freq"))), F.lit(0)).cast("long").alias("freq1"),
            F.coalesce(F.sum(F.when(F.col(by) == F.col("corpus2"), F.col("freq"))), F.lit(0)).cast("long").alias("freq2"))
        for side in ("1", "2"):
            out = (out.join(sizes, F.col(f"corpus{side}") == F.col("_c")).drop("_c")
                   .withColumnRenamed("_total", f"total{side}"))
    out = keyness_measures(out)
    return out.select("corpus1", "corpus2", *keys, "freq1", "freq2", *MEASURES)


# ------------------------------------------------------------------ filters
def is_alpha(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.rlike(r"^\p{L}+$")


def content_words(df: DataFrame, pos: Sequence[str] = fixed.CONTENT_POS,
                  min_chars: int = fixed.MIN_CHARS) -> DataFrame:
    """Content POS, alphabetic lemma of at least ``min_chars``."""
    return df.filter(F.col("pos").isin(*pos) & is_alpha("lemma")
                     & (F.length("lemma") >= min_chars))


def target_filter(df: DataFrame, pos: Sequence[str] | None = None, min_chars: int = 0,
                  alpha: bool = True) -> DataFrame:
    """Optional POS list, minimum characters, optional alphabetic test."""
    cond = F.length("lemma") >= min_chars
    if pos:
        cond = cond & F.col("pos").isin(*pos)
    if alpha:
        cond = cond & is_alpha("lemma")
    return df.filter(cond)


def clean_ngrams(df: DataFrame, min_chars: int = 2) -> DataFrame:
    """Every lemma of the n-gram alphabetic with ``min_chars`` or more."""
    return df.filter(F.forall(F.split("lemma", " "),
                              lambda x: x.rlike(r"^\p{L}+$") & (F.length(x) >= min_chars)))


def min_freq_both(df: DataFrame, n: int = 10) -> DataFrame:
    """P4."""
    return df.filter((F.col("freq1") >= n) & (F.col("freq2") >= n))


def ll_significant(df: DataFrame, crit: float = fixed.LL_CRITICAL) -> DataFrame:
    """0/1 flag ``ll > crit``."""
    return df.withColumn("ll_signif", (F.col("ll") > crit).cast("int"))


def signed_ll(df: DataFrame) -> DataFrame:
    """``-ll`` when ``ratio_t2 < 1`` (NULL ratio keeps ``+ll``)."""
    return df.withColumn("signed_ll", F.when(F.col("ratio_t2") < 1, -F.col("ll"))
                         .otherwise(F.col("ll")))


def direction(df: DataFrame, base: str = "t1", target: str = "t2") -> DataFrame:
    """P10: label of the over-represented side (from signed LL)."""
    return df.withColumn("direction", F.when(F.col("signed_ll") > 0, F.lit(f"over in {target}"))
                         .otherwise(F.lit(f"over in {base}")))


def reorient_pair(df: DataFrame) -> DataFrame:
    """P20: swap sides 1 and 2 (``ll`` is symmetric)."""
    swap = {"freq1": "freq2", "freq2": "freq1", "freq_norm1": "freq_norm2",
            "freq_norm2": "freq_norm1", "ratio_t1": "ratio_t2", "ratio_t2": "ratio_t1",
            "logratio_t1": "logratio_t2", "logratio_t2": "logratio_t1",
            "corpus1": "corpus2", "corpus2": "corpus1"}
    return df.select(*[F.col(swap.get(c, c)).alias(c) for c in df.columns])


def significance_stars(p) -> Column:
    """``***`` < .001, ``**`` < .01, ``*`` < .05, else ``ns``."""
    p = F.col(p) if isinstance(p, str) else p
    return (F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*")
            .otherwise("ns"))


def format_report(df: DataFrame, decimals: dict[str, int]) -> DataFrame:
    """Fixed decimals per column, as strings."""
    return df.select(*[F.format_number(F.col(c), decimals[c]).alias(c) if c in decimals
                       else F.col(c) for c in df.columns])


# ------------------------------------------------------------------ rankings
def top_shifts_per_pos(df: DataFrame, n: int = 10, pos: Sequence[str] = fixed.CONTENT_POS,
                       min_chars: int = fixed.MIN_CHARS, part: Sequence[str] = ()) -> DataFrame:
    """Top-n by LL per POS and direction (``ratio_t2 > 1`` rising,
    ``< 1`` falling; NULL or exactly 1 in neither), plus signed LL.

    ``row_number`` with ``rank <= n`` is planned with a partial
    WindowGroupLimit, so each map task ships at most n rows per group.
    Ties: rounded LL, then target."""
    cw = content_words(df, pos, min_chars)
    cw = cw.withColumn("rising", F.when(F.col("ratio_t2") > 1, F.lit(1))
                       .when(F.col("ratio_t2") < 1, F.lit(0)))
    cw = cw.filter(F.col("rising").isNotNull())
    w = Window.partitionBy(*part, "pos", "rising").orderBy(F.round("ll", 6).desc(),
                                                          F.col("target").asc())
    out = cw.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n)
    return signed_ll(out).drop("rising")


def select_cluster_targets(df: DataFrame, n: int = 100) -> DataFrame:
    """Top-n falling then top-n rising words by LL (two partial top-k)."""
    fall = df.filter(F.col("ratio_t2") < 1).orderBy(F.round("ll", 6).desc(), "target").limit(n)
    rise = df.filter(F.col("ratio_t2") > 1).orderBy(F.round("ll", 6).desc(), "target").limit(n)
    return (fall.withColumn("direction", F.lit("falling"))
            .unionByName(rise.withColumn("direction", F.lit("rising"))))


def top_ngrams(df: DataFrame, n: int = 40, crit: float | None = None,
               part: Sequence[str] = ()) -> DataFrame:
    """N rising and n falling n-grams by LL (optionally only LL > crit)."""
    d = df if crit is None else df.filter(F.col("ll") > crit)
    d = d.withColumn("rising", F.when(F.col("ratio_t2") > 1, F.lit(1))
                     .when(F.col("ratio_t2") < 1, F.lit(0))).filter(F.col("rising").isNotNull())
    w = Window.partitionBy(*part, "rising").orderBy(F.round("ll", 6).desc(), F.col("target"))
    return (d.withColumn("rank", F.row_number().over(w).cast("long"))
            .filter(F.col("rank") <= n))


# ------------------------------------------------------------------ summaries
def pair_summary(df: DataFrame, crit: float = fixed.LL_CRITICAL,
                 by: Sequence[str] = ("corpus1", "corpus2")) -> DataFrame:
    """Per corpus pair over content words: shared words, significant,
    percent significant, over-represented in each side, mean LL of the
    significant ones."""
    sig = F.col("ll") > crit
    return (df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("shared_content_words"),
        F.count_if(sig).alias("signif_ll"),
        F.count_if(sig & (F.col("ratio_t2") < 1)).alias("over_in_1"),
        F.count_if(sig & (F.col("ratio_t2") > 1)).alias("over_in_2"),
        F.avg(F.when(sig, F.col("ll"))).alias("mean_abs_ll_signif"))
        .withColumn("pct_signif", F.round(F.lit(100.0) * F.col("signif_ll")
                                          / F.greatest(F.col("shared_content_words"), F.lit(1)), 1))
        .withColumn("mean_abs_ll_signif", F.round("mean_abs_ll_signif", 1)))


def lexical_distance(df: DataFrame, crit: float = fixed.LL_CRITICAL) -> DataFrame:
    """Symmetric corpus x corpus distance in long form
    ``(corpus_a, corpus_b, distance)``: mean LL over significant content
    words, 0 when none, 0 on the diagonal."""
    sig = F.col("ll") > crit
    d = df.groupBy("corpus1", "corpus2").agg(
        F.coalesce(F.avg(F.when(sig, F.col("ll"))), F.lit(0.0)).alias("distance"))
    both = (d.select(F.col("corpus1").alias("corpus_a"), F.col("corpus2").alias("corpus_b"), "distance")
            .unionByName(d.select(F.col("corpus2").alias("corpus_a"),
                                  F.col("corpus1").alias("corpus_b"), "distance")))
    diag = (d.select(F.col("corpus1").alias("c")).union(d.select("corpus2")).distinct()
            .select(F.col("c").alias("corpus_a"), F.col("c").alias("corpus_b"),
                    F.lit(0.0).alias("distance")))
    return both.unionByName(diag)


def distance_matrix(long: DataFrame, names: Sequence[str]) -> DataFrame:
    """A15 wide form: pivot the long distances with explicit column values."""
    return (long.groupBy("corpus_a").pivot("corpus_b", list(names))
            .agg(F.first("distance")).fillna(0.0))


def significant_share(df: DataFrame, crit: float = fixed.LL_CRITICAL,
                      by: Sequence[str] = ()) -> DataFrame:
    """Content words, significant, % significant, rising, % rising."""
    sig = F.col("ll") > crit
    g = df.groupBy(*by) if by else df.groupBy()
    out = g.agg(F.count(F.lit(1)).alias("n_words"),
                F.count_if(sig).alias("n_signif"),
                F.count_if(sig & (F.col("ratio_t2") > 1)).alias("n_rising"))
    return (out.withColumn("pct_signif", F.try_divide(F.lit(100.0) * F.col("n_signif"), F.col("n_words")))
            .withColumn("pct_rising", F.try_divide(F.lit(100.0) * F.col("n_rising"), F.col("n_signif"))))


# ------------------------------------------------------------------ report joins
def shift_agreement(a: DataFrame, b: DataFrame, key: str = "target") -> DataFrame:
    """Left join top shifts of A with those of B; ``agree`` when the
    signed LLs have the same sign (NULL when B lacks the word)."""
    bb = b.select(F.col(key), F.col("signed_ll").alias("signed_ll_b"))
    return (a.join(bb, key, "left")
            .withColumn("agree", F.when(F.col("signed_ll_b").isNull(), F.lit(None).cast("boolean"))
                        .otherwise(F.col("signed_ll") * F.col("signed_ll_b") > 0)))


def shift_overlap(a: DataFrame, b: DataFrame, key: str = "target") -> DataFrame:
    """Mark A's targets that are in B's top list for the same direction:
    ``*`` once, ``err`` when B lists it more than once, blank otherwise."""
    bc = b.groupBy(key, "rising").agg(F.count(F.lit(1)).alias("_n"))
    return (a.join(bc, [key, "rising"], "left")
            .withColumn("in_other", F.when(F.col("_n").isNull(), F.lit(""))
                        .when(F.col("_n") == 1, F.lit("*")).otherwise(F.lit("err")))
            .drop("_n"))


def ngram_overlap_flag(a: DataFrame, b_top: DataFrame, key: str = "target",
                       direction: str = "rising") -> DataFrame:
    """Flag rows of A whose n-gram is in B's top list of the same
    direction."""
    s = b_top.select(F.col(key).alias("_k"), F.col(direction).alias("_d")).distinct()
    return (a.join(s, (a[key] == s["_k"]) & (a[direction] == s["_d"]), "left")
            .withColumn("in_other", F.col("_k").isNotNull()).drop("_k", "_d"))


def side_by_side_ranks(a: DataFrame, b: DataFrame, n: int, order: str = "ll",
                       cols: Sequence[str] = ("target", "ll")) -> DataFrame:
    """Two ranked top-n lists next to each other by rank position."""
    def ranked(d, sfx):
        top = d.orderBy(F.round(order, 6).desc(), "target").limit(n)
        w = Window.orderBy(F.round(order, 6).desc(), "target")   # n rows only
        return top.select(F.row_number().over(w).cast("long").alias("rank"),
                          *[F.col(c).alias(f"{c}_{sfx}") for c in cols])
    return ranked(a, "a").join(ranked(b, "b"), "rank", "full_outer")


def ll_stars(ll) -> Column:
    """P21 on a log-likelihood column: stars from the chi-square (1 df)
    critical values, equivalent to p < .001/.01/.05."""
    v = F.col(ll) if isinstance(ll, str) else ll
    c = fixed.CHI2_1DF_CRIT
    return (F.when(v > c["***"], "***").when(v > c["**"], "**").when(v > c["*"], "*")
            .otherwise("ns"))
