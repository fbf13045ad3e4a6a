"""Literal goldens (FIXTURES.md section C) and scalar functions."""

import math

import pytest
from pyspark.sql import functions as F

from corpusdelta.functions import stats as S
from corpusdelta.functions import text as T
from corpusdelta.operators import groups as G
from corpusdelta.operators import selection as SE


def test_ngram_split_golden(spark):
    df = spark.createDataFrame([("the:DET paper:NOUN",)], "target string")
    r = df.select(T.ngram_lemma("target").alias("l"), T.ngram_pos("target").alias("p")).first()
    assert (r.l, r.p) == ("the paper", "DET NOUN")


def test_colon_tokens_golden(spark):
    words = ["::PUNCT", "some:noise:NOUN", "Model:NOUN", "Model"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in df.select(T.lower_tagged("w")).collect()]
    assert got == ["::PUNCT", "some:noise:NOUN", "model:NOUN", "model"]
    parts = df.select(T.split_lemma("w").alias("l"), T.split_pos("w").alias("p")).collect()
    assert (parts[0].l, parts[0].p) == (":", "PUNCT")
    assert (parts[1].l, parts[1].p) == ("some:noise", "NOUN")
    assert (parts[3].l, parts[3].p) == ("", "Model")


def test_volume_golden(spark):
    ids = ["2024.acl-long.1", "W05-0301", "P00-1001"]
    df = spark.createDataFrame([(i,) for i in ids], "i string")
    assert [r[0] for r in df.select(T.volume_of_id("i")).collect()] == ["2024.acl-long", "W05-03", "P00-1"]


def _gaps(spark, vals, fn):
    df = spark.createDataFrame([("f", f"g{i}", float(v)) for i, v in enumerate(vals)],
                               "feature string, corpus string, mean double")
    return fn(df).first()


def test_gap_goldens(spark):
    r = _gaps(spark, [0, .03285, .86879, .10196], G.feature_gaps_mean)
    assert r.abs_gap == pytest.approx(.86879) and r.rel_gap == pytest.approx(3.46269, abs=5e-5)
    r = _gaps(spark, [.5, .25], lambda df: G.feature_gaps_mean(df, ["g0", "g1"]))
    assert (r.g0, r.g1, r.abs_gap) == (.5, .25, .25)
    r = _gaps(spark, [7.4, 62.7, 66.75, 62.65], G.feature_gaps_sum)
    assert r.abs_gap == pytest.approx(59.35) and r.rel_gap == pytest.approx(.80040, abs=5e-5)


def test_ratio_of_means_golden(spark):
    df = spark.createDataFrame([("g", 58.83, 155.01)], "g string, t_stopword double, t_word double")
    r = G.per_word_means(df, "g", cols=["t_stopword"]).first()
    assert r.t_stopword_pw == pytest.approx(.37952, abs=5e-6)


def test_odds_and_reliability_golden(spark):
    coef = -.374823604622499
    df = spark.createDataFrame([("t_stopword", 1.0, coef, 1.0, -0.4, -0.3, 0.0)],
                               "feature string, selection_freq double, avg_std_coef double, "
                               "sign_consistency double, ci_lower double, ci_upper double, p_approx double")
    r = SE.reliable_features(df).first()
    assert r.odds_ratio == pytest.approx(.68741, abs=5e-6)
    assert r.pct_change_odds == pytest.approx(-31.25895, abs=5e-5)
    assert r.reliability_score == pytest.approx(.81245, abs=5e-6)


def test_pseudo_r2_as_coded_golden():
    mcf = .0559923
    ll0_over_n = math.log(0.5)          # balanced classes
    assert mcf / (1 - ll0_over_n) == pytest.approx(.0330699, abs=5e-7)


def test_rating_label_goldens(spark):
    rows = [(1, 1, True), (1, 1, False), (2, 3, True), (None, 2, True), (1, 2, True), (3, 3, False)]
    df = spark.createDataFrame(rows, "a int, b int, h boolean")
    got = [r[0] for r in df.select(T.preference_label("a", "b", F.col("h"))).collect()]
    assert got == ["human strong", "model strong", "neutral", "neutral", "neutral", "human moderate"]
    sc = df.select(T.preference_score(T.preference_label("a", "b", F.col("h")))).collect()
    assert [r[0] for r in sc] == [2, -2, 0, 0, 0, 1]


def test_ll_by_hand(spark):
    df = spark.createDataFrame([(10, 10, 1000, 1000), (30, 10, 1000, 2000), (5, 0, 100, 100)],
                               "a long, b long, c long, d long")
    got = [r[0] for r in df.select(S.log_likelihood("a", "b", "c", "d")).collect()]
    assert got[0] == pytest.approx(0.0, abs=1e-12)
    a, b, c, d = 30, 10, 1000, 2000
    e1, e2 = c * (a + b) / (c + d), d * (a + b) / (c + d)
    assert got[1] == pytest.approx(2 * (a * math.log(a / e1) + b * math.log(b / e2)))
    e1 = 100 * 5 / 200
    assert got[2] == pytest.approx(2 * 5 * math.log(5 / e1))


def test_log_ratio_zero_and_null(spark):
    df = spark.createDataFrame([(0.0,), (None,), (4.0,)], "r double")
    got = [r[0] for r in df.select(S.log_ratio("r")).collect()]
    assert got[0] == float("-inf") and got[1] is None and got[2] == 2.0


def test_tokens_and_pos_rules(spark):
    df = spark.createDataFrame([(1, "The running dogs quickly jumped over 42 fences! Dr. Müller's café.")],
                               "doc_id long, text string")
    from corpusdelta.operators import tokens as tok
    t = tok.annotate_tokens(tok.tokenize(df)).orderBy("sent_id", "pos_in_sent").collect()
    got = [(r.token, r.upos, r.lemma) for r in t]
    assert ("the", "DET", "the") in got
    assert ("running", "VERB", "runn") in got
    assert ("dogs", "NOUN", "dog") in got
    assert ("quickly", "ADV", "quickly") in got
    assert ("42", "NUM", "42") in got
    assert ("!", "PUNCT", "!") in got
    assert ("müller", "NOUN", "müller") in got
    sents = {r.sent_id for r in t}
    assert sents == {0, 1, 2}


def test_ngrams_shorter_than_n(spark):
    df = spark.createDataFrame([(["a", "b"],), ([],), (["a", "b", "c", "d"],)], "t array<string>")
    got = [r[0] for r in df.select(T.ngrams("t", 3)).collect()]
    assert got == [[], [], ["a b c", "b c d"]]


def test_t_and_normal_p_values():
    assert S.t_two_sided_p(2.0, 10) == pytest.approx(0.07338803, abs=1e-6)
    assert S.t_two_sided_p(0.0, 5) == pytest.approx(1.0)
    assert S.normal_two_sided_p(1.959963985) == pytest.approx(0.05, abs=1e-8)
    assert S.chi2_sf(3.841458821, 1) == pytest.approx(0.05, abs=1e-7)
    assert S.chi2_sf(15.13, 1) == pytest.approx(1.0036e-4, rel=1e-3)   # the published cut-off is p ~ 1e-4


def test_ngram_parts_of_odd_targets(spark):
    from corpusdelta.functions import text as T
    targets = ["a:X b:Y", "::PUNCT b:c:Z", "plain a:X", "\u2028:PUNCT a:X", "a:X b:Y c:Z", "", None]
    df = spark.createDataFrame([(t,) for t in targets], "target string").withColumn("p", F.split("target", " "))
    got = df.select("target", T.parts_of_ngram("p", 2, T.split_lemma), T.parts_of_ngram("p", 2, T.split_pos),
                    T.ngram_lemma("target"), T.ngram_pos("target")).collect()
    want = {"a:X b:Y": ("a b", "X Y"), "::PUNCT b:c:Z": (": b:c", "PUNCT Z"), "plain a:X": (" a", "plain X"),
            "\u2028:PUNCT a:X": ("\u2028 a", "PUNCT X"), "a:X b:Y c:Z": ("a b c", "X Y Z"), "": ("", ""), None: (None, None)}
    for t, *parts in got:
        assert (parts[0], parts[1]) == (parts[2], parts[3]) == want[t], t
