"""Registered lexical plans, second part: all pairs, n-gram keyness,
report joins and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusdelta.functions import fixed
from corpusdelta.functions import text as T
from corpusdelta.operators import counts as C
from corpusdelta.operators import keyness as K
from corpusdelta.operators import tokens as tok
from corpusdelta.plans import sqlbits as Q
from corpusdelta.plans.common import annotated, quality_docs, rounded, source_docs, table
from corpusdelta.plans.lexical import _quality_keyness, _quality_keyness_sql
from corpusdelta.session import cut

PLANS: dict = {}


def plan(name, sql=None):
    def deco(fn):
        PLANS[name] = (fn, sql)
        return fn
    return deco


KOUT = ("target, lemma, pos, freq1, freq2, round(freq_norm1, 6) AS freq_norm1, "
        "round(freq_norm2, 6) AS freq_norm2, round(ratio_t2, 6) AS ratio_t2, "
        "round(ratio_t1, 6) AS ratio_t1, round(logratio_t1, 6) AS logratio_t1, "
        "round(logratio_t2, 6) AS logratio_t2, round(ll, 6) AS ll")


# ------------------------------------------------------------------ J3
def _all_pairs(spark, sf):
    f = C.unigram_counts(annotated(source_docs(spark, sf)), by="corpus")
    return K.keyness_all_pairs(f, how="inner")


ALL_PAIRS_SQL = f"""WITH {Q.token_ctes('source')},
f AS (SELECT corpus, target, COUNT(*) AS freq FROM ann GROUP BY corpus, target),
tot AS (SELECT corpus, SUM(freq) AS total FROM f GROUP BY corpus),
k0 AS (SELECT a.corpus AS corpus1, b.corpus AS corpus2, a.target, a.freq AS freq1, b.freq AS freq2,
              ta.total AS t1, tb.total AS t2
       FROM f a JOIN f b ON a.target = b.target AND a.corpus < b.corpus
       JOIN tot ta ON ta.corpus = a.corpus JOIN tot tb ON tb.corpus = b.corpus),
kp AS (SELECT corpus1, corpus2, target, {Q.split_lemma('target')} AS lemma, {Q.split_pos('target')} AS pos,
              freq1, freq2, {Q.measures_raw()} FROM k0)"""


@plan("keyness_all_pairs", ALL_PAIRS_SQL + f"\nSELECT corpus1, corpus2, {KOUT} FROM kp")
def q_keyness_all_pairs(spark, sf):
    return rounded(_all_pairs(spark, sf))


# ------------------------------------------------------------------ A14-A16
@plan("pair_summary", ALL_PAIRS_SQL + f"""
SELECT corpus1, corpus2, COUNT(*) AS shared_content_words,
       COUNT(*) FILTER (WHERE ll > {fixed.LL_CRITICAL}) AS signif_ll,
       COUNT(*) FILTER (WHERE ll > {fixed.LL_CRITICAL} AND ratio_t2 < 1) AS over_in_1,
       COUNT(*) FILTER (WHERE ll > {fixed.LL_CRITICAL} AND ratio_t2 > 1) AS over_in_2,
       round(round(AVG(CASE WHEN ll > {fixed.LL_CRITICAL} THEN ll END), 1), 6) AS mean_abs_ll_signif,
       round(round(100.0 * COUNT(*) FILTER (WHERE ll > {fixed.LL_CRITICAL}) / greatest(COUNT(*), 1), 1), 6)
         AS pct_signif
FROM kp WHERE {Q.content_filter()} GROUP BY corpus1, corpus2""")
def q_pair_summary(spark, sf):
    return rounded(K.pair_summary(K.content_words(_all_pairs(spark, sf))))


@plan("lexical_distance", ALL_PAIRS_SQL + f""",
d AS (SELECT corpus1, corpus2, COALESCE(AVG(CASE WHEN ll > {fixed.LL_CRITICAL} THEN ll END), 0.0) AS distance
      FROM kp WHERE {Q.content_filter()} GROUP BY corpus1, corpus2)
SELECT corpus1 AS corpus_a, corpus2 AS corpus_b, round(distance, 6) AS distance FROM d
UNION ALL SELECT corpus2, corpus1, round(distance, 6) FROM d
UNION ALL SELECT DISTINCT c, c, 0.0 FROM (SELECT corpus1 AS c FROM d UNION SELECT corpus2 FROM d)""")
def q_lexical_distance(spark, sf):
    return rounded(K.lexical_distance(K.content_words(_all_pairs(spark, sf))))


@plan("significant_share", _quality_keyness_sql("inner", False) + f"""
SELECT COUNT(*) AS n_words, COUNT(*) FILTER (WHERE ll > {fixed.LL_CRITICAL}) AS n_signif,
       COUNT(*) FILTER (WHERE ll > {fixed.LL_CRITICAL} AND ratio_t2 > 1) AS n_rising,
       round(100.0 * COUNT(*) FILTER (WHERE ll > {fixed.LL_CRITICAL}) / COUNT(*), 6) AS pct_signif,
       round(100.0 * COUNT(*) FILTER (WHERE ll > {fixed.LL_CRITICAL} AND ratio_t2 > 1)
             / NULLIF(COUNT(*) FILTER (WHERE ll > {fixed.LL_CRITICAL}), 0), 6) AS pct_rising
FROM k WHERE {Q.content_filter()}""")
def q_significant_share(spark, sf):
    return rounded(K.significant_share(K.content_words(_quality_keyness(spark, sf))))


# ------------------------------------------------------------------ n-gram keyness
def _ngram_keyness(docs, n, base, target):
    grams, totals = C.ngram_counts_and_totals(annotated(docs), n=n, by="corpus", part=True)
    # cut: else what is asked of lemmas would be computed for every n-gram, and not for those of both corpora
    both = cut(K.keyness(grams, base, target, how="inner", totals=totals, keys=["target", "part"]))
    return both.select("target", T.ngram_lemma("target").alias("lemma"), T.ngram_pos("target").alias("pos"), "freq1", "freq2", *K.MEASURES)


def _quality_ngram_keyness(spark, sf, n=5):
    return _ngram_keyness(quality_docs(spark, sf), n, "q0", "q1")


def _ngram_keyness_sql(n=5):
    return f"""WITH {Q.token_ctes('quality')},
tot AS (SELECT COUNT(*) FILTER (WHERE corpus = 'q0') AS t1, COUNT(*) FILTER (WHERE corpus = 'q1') AS t2 FROM ann),
sarr2 AS (SELECT corpus, doc_id, sent_id, list(target ORDER BY pos_in_sent) AS t
          FROM ann GROUP BY corpus, doc_id, sent_id),
g AS (SELECT corpus, unnest(list_transform(range(1, len(t) - {n} + 2),
             lambda i: array_to_string(t[i:i + {n - 1}], ' '))) AS target FROM sarr2 WHERE len(t) >= {n}),
agg AS (SELECT target, CAST(COALESCE(SUM(CASE WHEN corpus = 'q0' THEN 1 END), 0) AS BIGINT) AS freq1,
               CAST(COALESCE(SUM(CASE WHEN corpus = 'q1' THEN 1 END), 0) AS BIGINT) AS freq2
        FROM g GROUP BY target),
k AS (SELECT target, {Q.ngram_lemma('target')} AS lemma, {Q.ngram_pos('target')} AS pos,
             freq1, freq2, {Q.measures_raw()} FROM agg, tot WHERE freq1 > 0 AND freq2 > 0)"""


@plan("keyness_ngrams", _ngram_keyness_sql(5) + f"\nSELECT {KOUT} FROM k")
def q_keyness_ngrams(spark, sf):
    return rounded(_quality_ngram_keyness(spark, sf, 5))


@plan("clean_ngrams", _ngram_keyness_sql(2) + f"""
SELECT {KOUT} FROM k WHERE list_bool_and(list_transform(string_split(lemma, ' '),
    lambda x: regexp_matches(x, '^\\p{{L}}+$') AND length(x) >= 2))""")
def q_clean_ngrams(spark, sf):
    return rounded(K.clean_ngrams(_quality_ngram_keyness(spark, sf, 2)))


@plan("min_freq_both", _ngram_keyness_sql(2) + f"\nSELECT {KOUT} FROM k WHERE freq1 >= 10 AND freq2 >= 10")
def q_min_freq_both(spark, sf):
    return rounded(K.min_freq_both(_quality_ngram_keyness(spark, sf, 2), 10))


def _clean_sql(lemma="lemma"):
    return (f"list_bool_and(list_transform(string_split({lemma}, ' '), "
            "lambda x: regexp_matches(x, '^\\p{L}+$') AND length(x) >= 2))")


def _top_ngrams_sql(k, n, cond):
    """The top list of a keyness CTE: clean n-grams, n of each direction."""
    return f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY rising ORDER BY round(ll, 6) DESC, target) AS BIGINT) AS rank
  FROM (SELECT *, CASE WHEN ratio_t2 > 1 THEN 1 WHEN ratio_t2 < 1 THEN 0 END AS rising FROM {k} WHERE {cond}) WHERE rising IS NOT NULL)
WHERE rank <= {n}"""


def _top_own(spark, sf, n):
    """T2 as reported: clean n-grams that both corpora hold ten times, 40 + 40."""
    return K.top_ngrams(K.clean_ngrams(K.min_freq_both(_quality_ngram_keyness(spark, sf, n), 10)), n=40)


OWN_TOP = _clean_sql() + " AND freq1 >= 10 AND freq2 >= 10"


@plan("top_ngrams", _ngram_keyness_sql(2) + f"\nSELECT {KOUT}, rising, rank FROM ({_top_ngrams_sql('k', 40, OWN_TOP)})")
def q_top_ngrams(spark, sf):
    return rounded(_top_own(spark, sf, 2))


# ------------------------------------------------------------------ T1
@plan("sort_desc", f"""WITH {Q.token_ctes('all')}
SELECT target, COUNT(*) AS freq FROM ann GROUP BY target""")
def q_sort_desc(spark, sf):
    toks = annotated(table(spark, sf, "documents").select("doc_id", "text", F.lit("all").alias("corpus")))
    return C.sort_desc(C.unigram_counts(toks, by=None).select("target", "freq"))


# ------------------------------------------------------------------ P2, W2
@plan("target_filter", _quality_keyness_sql("inner") + """
SELECT * FROM k WHERE pos IN ('NOUN', 'VERB') AND length(lemma) >= 4 AND regexp_matches(lemma, '^\\p{L}+$')""")
def q_target_filter(spark, sf):
    return rounded(K.target_filter(_quality_keyness(spark, sf), pos=["NOUN", "VERB"], min_chars=4))


@plan("select_cluster_targets", _quality_keyness_sql("inner", False) + f"""
, fall AS (SELECT * FROM k WHERE ratio_t2 < 1 ORDER BY round(ll, 6) DESC, target LIMIT 100),
rise AS (SELECT * FROM k WHERE ratio_t2 > 1 ORDER BY round(ll, 6) DESC, target LIMIT 100)
SELECT {KOUT}, 'falling' AS direction FROM fall UNION ALL SELECT {KOUT}, 'rising' FROM rise""")
def q_select_cluster_targets(spark, sf):
    return rounded(K.select_cluster_targets(_quality_keyness(spark, sf), n=100))


# ------------------------------------------------------------------ P20-P22
@plan("reorient_pair", _quality_keyness_sql("inner") + """
SELECT target, lemma, pos, freq2 AS freq1, freq1 AS freq2, freq_norm2 AS freq_norm1,
       freq_norm1 AS freq_norm2, ratio_t1 AS ratio_t2, ratio_t2 AS ratio_t1,
       logratio_t2 AS logratio_t1, logratio_t1 AS logratio_t2, ll FROM k""")
def q_reorient_pair(spark, sf):
    return rounded(K.reorient_pair(_quality_keyness(spark, sf)))


@plan("significance_stars", _quality_keyness_sql("inner", False) + f"""
SELECT target, CASE WHEN ll > {fixed.CHI2_1DF_CRIT['***']} THEN '***' WHEN ll > {fixed.CHI2_1DF_CRIT['**']} THEN '**'
                    WHEN ll > {fixed.CHI2_1DF_CRIT['*']} THEN '*' ELSE 'ns' END AS stars FROM k""")
def q_significance_stars(spark, sf):
    return _quality_keyness(spark, sf).select("target", K.ll_stars("ll").alias("stars"))


@plan("format_report", _quality_keyness_sql("inner", False) + """
SELECT target, printf('%.2f', ll) AS ll, printf('%.1f', freq_norm1) AS freq_norm1,
       printf('%.1f', freq_norm2) AS freq_norm2 FROM k""")
def q_format_report(spark, sf):
    k = _quality_keyness(spark, sf)
    return k.select("target", F.format_string("%.2f", "ll").alias("ll"),
                    F.format_string("%.1f", "freq_norm1").alias("freq_norm1"),
                    F.format_string("%.1f", "freq_norm2").alias("freq_norm2"))


# ------------------------------------------------------------------ J9-J11, J14
def _toxic_keyness(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    lab = table(spark, sf, "labels").select("doc_id", "toxic")
    d = docs.join(lab, "doc_id").select("doc_id", "text",
                                        F.concat(F.lit("x"), F.col("toxic")).alias("corpus"))
    return K.keyness_from_tokens(annotated(d), "corpus", "x0", "x1")


def _toxic_sql_ctes():
    src = _quality_keyness_sql("inner", False)
    src = src.replace("'q' || CAST(l.quality AS VARCHAR)", "'x' || CAST(l.toxic AS VARCHAR)")
    src = src.replace("'q0'", "'x0'").replace("'q1'", "'x1'")
    return src.replace("WITH docs AS", "docs AS", 1).replace("\nk AS (", "\nkb AS (", 1) \
        .replace("agg AS (", "aggb AS (").replace("FROM agg", "FROM aggb") \
        .replace("tot AS (", "totb AS (").replace("FROM aggb, tot", "FROM aggb, totb") \
        .replace("docs AS (", "docsb AS (").replace("FROM docs)", "FROM docsb)") \
        .replace("sarr AS", "sarrb AS").replace("FROM sarr)", "FROM sarrb)") \
        .replace("sents AS", "sentsb AS").replace("FROM sents)", "FROM sentsb)") \
        .replace("tarr AS", "tarrb AS").replace("FROM tarr)", "FROM tarrb)") \
        .replace("toks AS", "toksb AS").replace("FROM toks)", "FROM toksb)") \
        .replace("up AS", "upb AS").replace("FROM up)", "FROM upb)") \
        .replace("lm AS", "lmb AS").replace("FROM lm)", "FROM lmb)") \
        .replace("ann AS", "annb AS").replace("FROM ann GROUP", "FROM annb GROUP")


def _two_tops_sql():
    top = f"""SELECT *, CASE WHEN ratio_t2 > 1 THEN 1 WHEN ratio_t2 < 1 THEN 0 END AS rising,
       CASE WHEN ratio_t2 < 1 THEN -ll ELSE ll END AS signed_ll FROM @K@ WHERE {Q.content_filter()}"""
    rank = """SELECT *, row_number() OVER (PARTITION BY pos, rising ORDER BY round(ll, 6) DESC, target) AS rank
       FROM @C@ WHERE rising IS NOT NULL"""
    return (_quality_keyness_sql("inner", False) + ",\n" + _toxic_sql_ctes()
            + f",\ncwa AS ({top.replace('@K@', 'k')}),\ncwb AS ({top.replace('@K@', 'kb')}),"
            + f"\nta AS (SELECT * FROM ({rank.replace('@C@', 'cwa')}) WHERE rank <= 10),"
            + f"\ntb AS (SELECT * FROM ({rank.replace('@C@', 'cwb')}) WHERE rank <= 10)")


def _two_tops(spark, sf):
    a = K.top_shifts_per_pos(_quality_keyness(spark, sf), n=10)
    b = K.top_shifts_per_pos(_toxic_keyness(spark, sf), n=10)
    rise = F.when(F.col("ratio_t2") > 1, F.lit(1)).when(F.col("ratio_t2") < 1, F.lit(0))
    return a.withColumn("rising", rise), b.withColumn("rising", rise)


@plan("shift_agreement", _two_tops_sql() + """
SELECT ta.target, round(ta.signed_ll, 6) AS signed_ll, round(tb.signed_ll, 6) AS signed_ll_b,
       CASE WHEN tb.signed_ll IS NULL THEN NULL ELSE ta.signed_ll * tb.signed_ll > 0 END AS agree
FROM ta LEFT JOIN tb ON ta.target = tb.target""")
def q_shift_agreement(spark, sf):
    a, b = _two_tops(spark, sf)
    return rounded(K.shift_agreement(a, b).select("target", "signed_ll", "signed_ll_b", "agree"))


@plan("shift_overlap", _two_tops_sql() + """,
bc AS (SELECT target, rising, COUNT(*) AS n FROM tb GROUP BY target, rising)
SELECT ta.target, ta.rising, CASE WHEN bc.n IS NULL THEN '' WHEN bc.n = 1 THEN '*' ELSE 'err' END AS in_other
FROM ta LEFT JOIN bc ON ta.target = bc.target AND ta.rising = bc.rising""")
def q_shift_overlap(spark, sf):
    a, b = _two_tops(spark, sf)
    return K.shift_overlap(a, b).select("target", "rising", "in_other")


def _toxic_ngram_keyness(spark, sf, n):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    lab = table(spark, sf, "labels").select("doc_id", "toxic")
    d = docs.join(lab, "doc_id").select("doc_id", "text", F.concat(F.lit("x"), F.col("toxic")).alias("corpus"))
    return _ngram_keyness(d, n, "x0", "x1")


def _overlap_sql(n):
    other = (_ngram_keyness_sql(n).replace("'q' || CAST(l.quality AS VARCHAR)", "'x' || CAST(l.toxic AS VARCHAR)")
             .replace("'q0'", "'x0'").replace("'q1'", "'x1'"))
    return f"""WITH oa AS ({_ngram_keyness_sql(n)} SELECT * FROM k),
ob AS ({other} SELECT * FROM k),
ta AS ({_top_ngrams_sql('oa', 40, OWN_TOP)}),
tb AS ({_top_ngrams_sql('ob', 400, _clean_sql())})
SELECT ta.target, ta.rising, tb.target IS NOT NULL AS in_other FROM ta
LEFT JOIN tb ON ta.target = tb.target AND ta.rising = tb.rising"""


def _overlap_plan(name, n):
    @plan(name, _overlap_sql(n))
    def q(spark, sf):
        top = K.top_ngrams(K.clean_ngrams(_toxic_ngram_keyness(spark, sf, n)), n=400)
        return K.ngram_overlap_flag(_top_own(spark, sf, n), top).select("target", "rising", "in_other")


_overlap_plan("ngram_overlap_flag", 2)
_overlap_plan("ngram_overlap_flag_5", 5)


@plan("side_by_side_ranks", _quality_keyness_sql("inner", False) + ",\n" + _toxic_sql_ctes() + """,
ra AS (SELECT row_number() OVER (ORDER BY round(ll, 6) DESC, target) AS rank, target AS target_a,
              round(ll, 6) AS ll_a FROM k ORDER BY round(ll, 6) DESC, target LIMIT 25),
rb AS (SELECT row_number() OVER (ORDER BY round(ll, 6) DESC, target) AS rank, target AS target_b,
              round(ll, 6) AS ll_b FROM kb ORDER BY round(ll, 6) DESC, target LIMIT 25)
SELECT COALESCE(ra.rank, rb.rank) AS rank, target_a, ll_a, target_b, ll_b FROM ra FULL OUTER JOIN rb ON ra.rank = rb.rank""")
def q_side_by_side_ranks(spark, sf):
    r = K.side_by_side_ranks(_quality_keyness(spark, sf), _toxic_keyness(spark, sf), n=25)
    return rounded(r)


# ------------------------------------------------------------------ F1-F4
def _raw_tagged(spark, sf):
    """Mixed-case ``word:UPOS`` strings (tokens before lowercasing)."""
    s = tok.sentences(table(spark, sf, "documents"))
    raw = s.select(F.explode(F.regexp_extract_all("sentence", F.lit(fixed.TOKEN_PATTERN), 0)).alias("w"))
    return raw.select(T.tagged("w", T.upos(F.lower("w"))).alias("word")).distinct()


RAW_SQL = f"""WITH {Q.token_ctes('all')},
raw AS (SELECT DISTINCT w || ':' || ({Q.upos('lower(w)')}) AS word
        FROM (SELECT unnest(regexp_extract_all(sentence, '{fixed.TOKEN_PATTERN}')) AS w FROM sents))"""


@plan("lower_tagged", RAW_SQL + """
SELECT word, CASE WHEN contains(word, ':') THEN lower(regexp_extract(word, '^(.*):([^:]*)$', 1)) || ':' ||
       regexp_extract(word, '^(.*):([^:]*)$', 2) ELSE lower(word) END AS lowered FROM raw""")
def q_lower_tagged(spark, sf):
    return _raw_tagged(spark, sf).select("word", T.lower_tagged("word").alias("lowered"))


@plan("lower_all", RAW_SQL + "\nSELECT word, lower(word) AS lowered FROM raw")
def q_lower_all(spark, sf):
    return _raw_tagged(spark, sf).select("word", T.lower_all("word").alias("lowered"))


@plan("split_target", f"""WITH {Q.token_ctes('all')}
SELECT DISTINCT target, {Q.split_lemma('target')} AS lemma, {Q.split_pos('target')} AS pos FROM ann""")
def q_split_target(spark, sf):
    t = annotated(table(spark, sf, "documents").select("doc_id", "text", F.lit("all").alias("corpus")))
    return t.select("target").distinct().select(
        "target", T.split_lemma("target").alias("lemma"), T.split_pos("target").alias("pos"))


@plan("split_ngram_target", _ngram_keyness_sql(3) + "\nSELECT target, lemma, pos FROM k")
def q_split_ngram_target(spark, sf):
    return _quality_ngram_keyness(spark, sf, 3).select("target", "lemma", "pos")
