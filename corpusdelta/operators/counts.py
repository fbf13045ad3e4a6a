"""Frequency tables (A1-A4): ``freqs(corpus, target, lemma, pos, freq)``.

Counting is a plain ``groupBy().count()``: Spark runs a partial hash
aggregate before the exchange, so a function word holding a third of all
tokens is reduced to one row per map task before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusdelta.functions import text as T
from corpusdelta.operators import runs as R
from corpusdelta.session import text_partitions, written


def _by(by) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def unigram_counts(tokens: DataFrame, by: Sequence[str] | str | None = "corpus",
                   key: str = "target") -> DataFrame:
    """A1: counts of ``key`` per ``by`` group with ``lemma``/``pos`` split
    from the target (F3). Sort with :func:`sort_desc` only for reports."""
    b = _by(by)
    return (tokens.groupBy(*b, key).agg(F.count(F.lit(1)).alias("freq"))
            .withColumn("lemma", T.split_lemma(key))
            .withColumn("pos", T.split_pos(key))
            .select(*b, F.col(key).alias("target"), "lemma", "pos", "freq"))


def sentence_ngrams(tokens: DataFrame, n: int, keep: Sequence[str] = (), key: str = "target",
                    doc: str = "doc_id") -> DataFrame:
    """Contiguous n-grams of an annotated token table, one row per n-gram
    start: ``lead`` over the sentence (a bounded window partition that the
    doc-id partitioning already satisfies, so no exchange), kept only where
    the n-th token exists."""
    if n == 1:
        return tokens.select(*keep, F.col(key).alias("target"))
    w = Window.partitionBy(doc, "sent_id").orderBy("pos_in_sent")
    parts = [F.col(key)] + [F.lead(key, i).over(w) for i in range(1, n)]
    return (tokens.select(*keep, F.concat_ws(" ", *parts).alias("target"),
                          F.lead(key, n - 1).over(w).alias("_last"))
            .filter(F.col("_last").isNotNull()).drop("_last"))


def _with_parts(freqs: DataFrame, by: list[str], n: int) -> DataFrame:
    """``(by..., target, lemma, pos, freq)``: each target is split once."""
    parts = freqs.select(*by, "target", F.split("target", " ").alias("_parts"), "freq")
    return parts.select(*by, "target", T.parts_of_ngram("_parts", n, T.split_lemma).alias("lemma"),
                        T.parts_of_ngram("_parts", n, T.split_pos).alias("pos"), "freq")


def ngram_counts(tokens: DataFrame, n: int = 1, by: Sequence[str] | str | None = "corpus",
                 key: str = "target") -> DataFrame:
    """A2: counts of contiguous n-grams inside each sentence of an annotated
    token table (shorter sentences give none). The n-gram target is the
    space-joined ``lemma:POS`` parts; ``lemma`` and ``pos`` are their
    space-joined parts (F4), derived after aggregation so they are computed
    once per type. Long n-grams are dealt as runs (:mod:`runs`)."""
    b = _by(by)
    if n >= R.FROM:
        return R.count_runs(R.ngram_runs(tokens, n, b, key), n, b, text_partitions(tokens)).transform(_with_parts, b, n)
    grams = sentence_ngrams(tokens, n, keep=b, key=key)
    return (grams.groupBy(*b, "target").agg(F.count(F.lit(1)).alias("freq"))
            .transform(_with_parts, b, n))


def ngram_counts_arrays(sent: DataFrame, n: int = 1, by: Sequence[str] | str | None = "corpus",
                        array_col: str = "targets") -> DataFrame:
    """A2 on sentence arrays (e.g. read from one-sentence-per-line files):
    array-native n-grams, guarded for sentences shorter than n."""
    b = _by(by)
    grams = sent.select(*b, F.explode(T.ngrams(array_col, n, " ")).alias("target"))
    return (grams.groupBy(*b, "target").agg(F.count(F.lit(1)).alias("freq"))
            .transform(_with_parts, b, n))


def pos_ngram_counts(freqs: DataFrame, by: Sequence[str] | str | None = "corpus") -> DataFrame:
    """A3: collapse lemma:POS n-grams to POS n-grams and sum the counts."""
    b = _by(by)
    return (freqs.select(*b, T.ngram_pos("target").alias("target"), "freq")
            .groupBy(*b, "target").agg(F.sum("freq").cast("long").alias("freq")))


def corpus_size(freqs: DataFrame, by: Sequence[str] | str | None = "corpus") -> DataFrame:
    """A4: total tokens per corpus (for n > 1 pass the *unigram* table)."""
    b = _by(by)
    return freqs.groupBy(*b).agg(F.sum("freq").cast("long").alias("total"))


def sort_desc(df: DataFrame, col: str = "freq", tie: str | Sequence[str] = "target") -> DataFrame:
    """Descending sort with the key as tie-break (range-partitioned)."""
    ties = _by(tie)
    return df.orderBy(F.col(col).desc(), *[F.col(t).asc() for t in ties])


def ngram_counts_and_totals(tokens: DataFrame, n: int, by: str = "corpus", key: str = "target", part: bool = False):
    """A2 + A4 in one tokenisation pass: every token row carries its n-gram
    (NULL when the sentence ends first), one aggregation counts both, and
    the token total per corpus is the sum over all rows. The aggregate is
    checkpointed; returns ``(freqs, {corpus: total})`` (one number per
    corpus reaches the driver). Of long n-grams the runs are kept, as Parquet,
    with the number of tokens.

    With ``part``, freqs has a column ``part``, which follows from the target: a
    grouping of all corpora by target and part finds long n-grams dealt by it."""
    from corpusdelta.session import cut
    extra = [F.col("_part").alias("part")] if part else []
    if n >= R.FROM:
        runs = written(R.ngram_runs(tokens, n, [by], key, totals=True))
        agg = runs.where("_text IS NULL").withColumn("freq", F.col("_c"))
        freqs = R.count_runs(runs.where("_text IS NOT NULL"), n, [by], text_partitions(tokens), deal=[])
    else:
        if n == 1:
            grams = tokens.select(by, F.col(key).alias("target"))
        else:
            w = Window.partitionBy("doc_id", "sent_id").orderBy("pos_in_sent")
            parts = [F.col(key)] + [F.lead(key, i).over(w) for i in range(1, n)]
            grams = tokens.select(by, F.when(F.lead(key, n - 1).over(w).isNotNull(),
                                             F.concat_ws(" ", *parts)).alias("target"))
        agg = cut(grams.groupBy(by, "target").agg(F.count(F.lit(1)).alias("freq")))
        freqs = agg.filter(F.col("target").isNotNull()).withColumn("_part", F.xxhash64("target"))
    totals = {r[by]: r["total"] for r in
              agg.groupBy(by).agg(F.sum("freq").cast("long").alias("total")).collect()}
    return _with_parts(freqs.select(by, *extra, "target", "freq"), [by, "part"] if part else [by], n), totals
