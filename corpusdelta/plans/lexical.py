"""Registered lexical plans: sentences, tokens, counts, keyness, rankings.

Each entry is ``name -> (spark_fn(spark, sf_dir), oracle_sql or None)``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusdelta.functions import fixed
from corpusdelta.operators import counts as C
from corpusdelta.operators import frequent as FQ
from corpusdelta.operators import keyness as K
from corpusdelta.operators import token_table as TT
from corpusdelta.operators import tokens as tok
from corpusdelta.plans import sqlbits as Q
from corpusdelta.plans.common import (annotated, lang_docs, quality_docs, rounded,
                                      source_docs, table)
from corpusdelta.session import text_partitions

PLANS: dict = {}


def plan(name, sql=None):
    def deco(fn):
        PLANS[name] = (fn, sql)
        return fn
    return deco


KCOLS = "target, lemma, pos, freq1, freq2"


def _quality_keyness(spark, sf, how="inner"):
    toks = annotated(quality_docs(spark, sf))
    return K.keyness_from_tokens(toks, "corpus", "q0", "q1", how=how)


def _quality_keyness_sql(how="inner", rounded_out=True):
    where = "WHERE freq1 > 0 AND freq2 > 0" if how == "inner" else ""
    m = Q.measures() if rounded_out else Q.measures_raw()
    return f"""WITH {Q.token_ctes('quality')},
agg AS (SELECT target, CAST(COALESCE(SUM(CASE WHEN corpus = 'q0' THEN 1 END), 0) AS BIGINT) AS freq1,
               CAST(COALESCE(SUM(CASE WHEN corpus = 'q1' THEN 1 END), 0) AS BIGINT) AS freq2
        FROM ann GROUP BY target),
tot AS (SELECT SUM(freq1) AS t1, SUM(freq2) AS t2 FROM agg),
k AS (SELECT target, {Q.split_lemma('target')} AS lemma, {Q.split_pos('target')} AS pos,
             freq1, freq2, {m} FROM agg, tot {where})"""


# ------------------------------------------------------------------ F9
@plan("segment_sentences", f"""WITH {Q.token_ctes('all')}
SELECT doc_id, sent_id, sentence FROM sents""")
def q_segment_sentences(spark, sf):
    docs = table(spark, sf, "documents")
    return tok.sentences(docs).select("doc_id", "sent_id", "sentence")


# ------------------------------------------------------------------ F10
@plan("tokenize", f"""WITH {Q.token_ctes('all')}
SELECT doc_id, sent_id, pos_in_sent, token FROM toks""")
def q_tokenize(spark, sf):
    return tok.tokenize(table(spark, sf, "documents"))


# ------------------------------------------------------------------ F11
@plan("annotate_tokens", f"""WITH {Q.token_ctes('all')}
SELECT DISTINCT token, upos, lemma, target FROM ann""")
def q_annotate_tokens(spark, sf):
    t = tok.annotate_tokens(tok.tokenize(table(spark, sf, "documents")))
    return t.select("token", "upos", "lemma", "target").distinct()


# ------------------------------------------------------------------ A1
@plan("unigram_counts", f"""WITH {Q.token_ctes('source')}
SELECT corpus, target, {Q.split_lemma('target')} AS lemma, {Q.split_pos('target')} AS pos,
       COUNT(*) AS freq FROM ann GROUP BY corpus, target""")
def q_unigram_counts(spark, sf):
    return C.unigram_counts(annotated(source_docs(spark, sf)), by="corpus")


# ------------------------------------------------------------------ A2
NGRAM_SQL = f"""WITH {Q.token_ctes('lang')},
sarr2 AS (SELECT corpus, doc_id, sent_id, list(target ORDER BY pos_in_sent) AS t
          FROM ann GROUP BY corpus, doc_id, sent_id),
g AS (SELECT corpus, unnest(list_transform(range(1, len(t) - 5 + 2),
             lambda i: array_to_string(t[i:i + 4], ' '))) AS target FROM sarr2 WHERE len(t) >= 5)
SELECT corpus, target, {Q.ngram_lemma('target')} AS lemma, {Q.ngram_pos('target')} AS pos,
       COUNT(*) AS freq FROM g GROUP BY corpus, target"""


@plan("ngram_counts", NGRAM_SQL)
def q_ngram_counts(spark, sf):
    return C.ngram_counts(annotated(lang_docs(spark, sf)), n=5, by="corpus")


@plan("frequent_ngrams", NGRAM_SQL + " HAVING COUNT(*) >= 3")
def q_frequent_ngrams(spark, sf):
    """A2 with P4: 5-grams that occur at least three times in their corpus."""
    return FQ.frequent_ngrams(annotated(lang_docs(spark, sf)), n=5, min_freq=3)


@plan("ngrams_from_token_table", NGRAM_SQL)
def q_ngrams_from_token_table(spark, sf):
    """A2 over a written token table: only the counts are exchanged."""
    docs = lang_docs(spark, sf)
    n = text_partitions(docs)
    name = TT.write_token_table(annotated(docs.repartition(n, "doc_id")), buckets=n, dealt=True)
    return C.ngram_counts(TT.read_token_table(spark, name), n=5, by="corpus")


# ------------------------------------------------------------------ A3
@plan("pos_ngram_counts", f"""WITH {Q.token_ctes('lang')},
sarr2 AS (SELECT corpus, doc_id, sent_id, list(target ORDER BY pos_in_sent) AS t
          FROM ann GROUP BY corpus, doc_id, sent_id),
g AS (SELECT corpus, unnest(list_transform(range(1, len(t) - 3 + 2),
             lambda i: array_to_string(t[i:i + 2], ' '))) AS target FROM sarr2 WHERE len(t) >= 3),
f AS (SELECT corpus, target, COUNT(*) AS freq FROM g GROUP BY corpus, target)
SELECT corpus, {Q.ngram_pos('target')} AS target, CAST(SUM(freq) AS BIGINT) AS freq
FROM f GROUP BY corpus, {Q.ngram_pos('target')}""")
def q_pos_ngram_counts(spark, sf):
    grams = C.ngram_counts(annotated(lang_docs(spark, sf)), n=3, by="corpus")
    return C.pos_ngram_counts(grams, by="corpus")


# ------------------------------------------------------------------ A4
@plan("corpus_size", f"""WITH {Q.token_ctes('source')}
SELECT corpus, COUNT(*) AS total FROM ann GROUP BY corpus""")
def q_corpus_size(spark, sf):
    return C.corpus_size(C.unigram_counts(annotated(source_docs(spark, sf))))


# ------------------------------------------------------------------ J1 + X1-X4
@plan("keyness_inner", _quality_keyness_sql("inner") + f"\nSELECT * FROM k")
def q_keyness_inner(spark, sf):
    return rounded(_quality_keyness(spark, sf, "inner"))


@plan("keyness_outer", _quality_keyness_sql("outer") + f"\nSELECT * FROM k")
def q_keyness_outer(spark, sf):
    return rounded(_quality_keyness(spark, sf, "outer"))


@plan("log_likelihood", _quality_keyness_sql("outer") + "\nSELECT target, ll FROM k")
def q_log_likelihood(spark, sf):
    return rounded(_quality_keyness(spark, sf, "outer").select("target", "ll"))


@plan("freq_per_million", _quality_keyness_sql("outer")
      + "\nSELECT target, freq_norm1, freq_norm2 FROM k")
def q_freq_per_million(spark, sf):
    return rounded(_quality_keyness(spark, sf, "outer").select("target", "freq_norm1", "freq_norm2"))


@plan("freq_ratio", _quality_keyness_sql("outer") + "\nSELECT target, ratio_t1, ratio_t2 FROM k")
def q_freq_ratio(spark, sf):
    return rounded(_quality_keyness(spark, sf, "outer").select("target", "ratio_t1", "ratio_t2"))


@plan("log_ratio", _quality_keyness_sql("outer") + "\nSELECT target, logratio_t1, logratio_t2 FROM k")
def q_log_ratio(spark, sf):
    return rounded(_quality_keyness(spark, sf, "outer").select("target", "logratio_t1", "logratio_t2"))


# ------------------------------------------------------------------ P1, P8-P10
@plan("content_words", _quality_keyness_sql("inner") + f"\nSELECT * FROM k WHERE {Q.content_filter()}")
def q_content_words(spark, sf):
    return rounded(K.content_words(_quality_keyness(spark, sf)))


@plan("ll_significant", _quality_keyness_sql("inner", False)
      + f"\nSELECT target, CAST(ll > {fixed.LL_CRITICAL} AS INTEGER) AS ll_signif FROM k")
def q_ll_significant(spark, sf):
    return K.ll_significant(_quality_keyness(spark, sf)).select("target", "ll_signif")


@plan("signed_ll", _quality_keyness_sql("inner", False)
      + "\nSELECT target, round(CASE WHEN ratio_t2 < 1 THEN -ll ELSE ll END, 6) AS signed_ll FROM k")
def q_signed_ll(spark, sf):
    return rounded(K.signed_ll(_quality_keyness(spark, sf)).select("target", "signed_ll"))


@plan("direction", _quality_keyness_sql("inner", False)
      + "\nSELECT target, CASE WHEN (CASE WHEN ratio_t2 < 1 THEN -ll ELSE ll END) > 0 "
        "THEN 'over in q1' ELSE 'over in q0' END AS direction FROM k")
def q_direction(spark, sf):
    d = K.direction(K.signed_ll(_quality_keyness(spark, sf)), base="q0", target="q1")
    return d.select("target", "direction")


# ------------------------------------------------------------------ W1 (flagship)
TOP_SHIFTS_SQL = _quality_keyness_sql("inner", False) + f""",
cw AS (SELECT *, CASE WHEN ratio_t2 > 1 THEN 1 WHEN ratio_t2 < 1 THEN 0 END AS rising
       FROM k WHERE {Q.content_filter()}),
r AS (SELECT *, row_number() OVER (PARTITION BY pos, rising ORDER BY round(ll, 6) DESC, target) AS rank
      FROM cw WHERE rising IS NOT NULL)
SELECT target, lemma, pos, freq1, freq2, round(freq_norm1, 6) AS freq_norm1,
       round(freq_norm2, 6) AS freq_norm2, round(ratio_t2, 6) AS ratio_t2,
       round(ratio_t1, 6) AS ratio_t1, round(logratio_t1, 6) AS logratio_t1,
       round(logratio_t2, 6) AS logratio_t2, round(ll, 6) AS ll, rank,
       round(CASE WHEN ratio_t2 < 1 THEN -ll ELSE ll END, 6) AS signed_ll
FROM r WHERE rank <= 10"""


@plan("top_shifts_per_pos", TOP_SHIFTS_SQL)
def q_top_shifts_per_pos(spark, sf):
    return rounded(K.top_shifts_per_pos(_quality_keyness(spark, sf), n=10))


# ------------------------------------------------------------------ A1 under Structured Streaming
@plan("unigram_counts_stream", f"""WITH {Q.token_ctes('source')}
SELECT corpus, target, COUNT(*) AS freq FROM ann GROUP BY corpus, target""")
def q_unigram_counts_stream(spark, sf):
    """A1 on a file stream: the documents file is the stream's input, the
    running counts live in the state store (checkpointed in the session's
    checkpoint folder) and each complete result is written as parquet by
    foreachBatch, then read back; nothing is held on the driver."""
    import uuid

    from corpusdelta.streaming.counts import stream_counts, stream_output_path
    name = f"unigram_stream_{uuid.uuid4().hex[:8]}"
    q = stream_counts(spark, f"{sf}/documents*.parquet", "doc_id bigint, text string, source string",
                      sink="parquet", name=name, by="source", basePath=sf)
    q.awaitTermination()
    out = spark.read.parquet(stream_output_path(spark, name))
    return out.select(F.col("source").alias("corpus"), "target", "freq")
