"""Invariants of the lexical, vector, selection and rating operators."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusdelta.functions import stats as S
from corpusdelta.operators import batched_logit as BL
from corpusdelta.operators import counts as C
from corpusdelta.operators import keyness as K
from corpusdelta.operators import selection as SE
from corpusdelta.operators import survey as SV
from corpusdelta.operators import tokens as tok
from corpusdelta.operators import vectors as V
from corpusdelta.plans.common import annotated, source_docs, table
from tests.conftest import SF_SMALL


def test_unigram_total_equals_token_count(spark):
    t = annotated(source_docs(spark, SF_SMALL))
    f = C.unigram_counts(t)
    assert f.agg(F.sum("freq")).first()[0] == t.count()


def test_ngram_total(spark):
    t = annotated(source_docs(spark, SF_SMALL))
    lens = t.groupBy("doc_id", "sent_id").count().collect()
    for n in (2, 5):
        expect = sum(max(r["count"] - n + 1, 0) for r in lens)
        got = C.ngram_counts(t, n=n).agg(F.sum("freq")).first()[0]
        assert got == expect


def test_keyness_symmetry_and_sign(spark):
    t = annotated(source_docs(spark, SF_SMALL))
    f = C.unigram_counts(t)
    a = K.keyness(f, "src0", "src1", how="outer").select("target", "ll", "ratio_t2", "freq1", "freq2")
    b = K.keyness(f, "src1", "src0", how="outer").select("target", F.col("ll").alias("ll_b"),
                                                       F.col("ratio_t1").alias("r_b"))
    j = a.join(b, "target").collect()
    assert j and all(abs(r.ll - r.ll_b) < 1e-9 and r.ll >= -1e-12 for r in j)
    assert all((r.ratio_t2 is None and r.r_b is None) or abs(r.ratio_t2 - r.r_b) < 1e-9 for r in j)


def test_all_pairs_matches_pairwise(spark):
    t = annotated(source_docs(spark, SF_SMALL))
    f = C.unigram_counts(t)
    ap = K.keyness_all_pairs(f).filter((F.col("corpus1") == "src0") & (F.col("corpus2") == "src1"))
    one = K.keyness(f, "src0", "src1", how="inner")
    x = {r.target: (r.freq1, r.freq2, round(r.ll, 9)) for r in ap.collect()}
    y = {r.target: (r.freq1, r.freq2, round(r.ll, 9)) for r in one.collect()}
    assert x == y and len(x) > 0
    out = K.keyness_all_pairs(f, how="outer", pairs=[("src0", "src1")])
    z = {r.target: (r.freq1, r.freq2) for r in out.collect()}
    w = {r.target: (r.freq1, r.freq2) for r in K.keyness(f, "src0", "src1", how="outer").collect()}
    assert z == w


def test_sentence_windows_cover_all_sentences(spark):
    d = table(spark, SF_SMALL, "documents")
    w = tok.sentence_windows(d, size=5)
    n_sent = tok.sentences(d).count()
    got = w.select(F.sum(F.size(F.split("text", r"(?<=[.!?])\s+")))).first()[0]
    assert w.groupBy("doc_id").agg(F.max("win_no")).count() > 0
    assert got >= n_sent * 0.9          # joined windows re-split into about the same sentences


def test_dense_ids_consecutive(spark):
    d = table(spark, SF_SMALL, "documents").select("doc_id")
    ids = [r.ID for r in tok.dense_ids(d, ["doc_id"]).orderBy("doc_id").collect()]
    assert ids == list(range(len(ids)))


def _brute_topk(x, words, k):
    xn = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = xn @ xn.T
    np.fill_diagonal(s, -np.inf)
    out = {}
    for i, w in enumerate(words):
        order = sorted(range(len(words)), key=lambda j: (-s[i, j], words[j]))[:k]
        out[w] = [(words[j], s[i, j]) for j in order]
    return out


def test_block_topk_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 16))
    words = [f"w{i:03d}" for i in range(300)]
    df = spark.createDataFrame([(w, [float(v) for v in row]) for w, row in zip(words, x)], "word string, vec array<double>")
    got = V.top_k_neighbours(df, k=10, block_rows=64).collect()
    brute = _brute_topk(x, words, 10)
    by = {}
    for r in got:
        by.setdefault(r.word, []).append((r.rank, r.neighbour, r.sim))
    for w, lst in by.items():
        lst.sort()
        assert [n for _, n, _ in lst] == [n for n, _ in brute[w]]
        assert all(abs(s - bs) < 1e-9 for (_, _, s), (_, bs) in zip(lst, brute[w]))
    d = V.neighbour_density(df, k=10, block_rows=64).collect()
    r0 = [r for r in d if r.word == "w000"][0]
    sims = [s for _, s in brute["w000"]]
    assert r0.mean == pytest.approx(np.mean(sims)) and r0.std == pytest.approx(np.std(sims, ddof=1))


def test_procrustes_recovers_rotation(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 8))
    q, _ = np.linalg.qr(rng.normal(size=(8, 8)))
    y = x @ q.T
    a = spark.createDataFrame([(f"w{i}", [float(v) for v in r]) for i, r in enumerate(x)], "word string, vec array<double>")
    b = spark.createDataFrame([(f"w{i}", [float(v) for v in r]) for i, r in enumerate(y)], "word string, vec array<double>")
    al = V.procrustes_align(a, b)
    sims = [r.sim for r in V.aligned_self_similarity(a, al).collect()]
    assert min(sims) > 1 - 1e-9


def test_mann_whitney_u_and_p(spark):
    x, y = [0.9, 0.8, 0.7, 0.6], [0.5, 0.65, 0.4, 0.3, 0.2]
    df = spark.createDataFrame([(x, y)], "a array<double>, b array<double>")
    u1 = df.select(V.mann_whitney_u("a", "b")).first()[0]
    u2 = df.select(V.mann_whitney_u("b", "a")).first()[0]
    assert u1 + u2 == len(x) * len(y)
    assert u1 == 19.0
    # exact two-sided p for U = 19 of 20 with n1 = 4, n2 = 5: 2 * 2/126
    assert df.select(S.mann_whitney_p(F.lit(u1), "a", "b")).first()[0] == pytest.approx(2 * 2 / 126)


def test_mann_whitney_p_by_counting_and_by_the_normal(spark):
    import itertools
    rng = np.random.default_rng(4)
    rows = [(rng.permutation(20)[:m].astype(float).tolist(), rng.permutation(20)[:n].astype(float).tolist()) for m, n in [(1, 1), (2, 5), (3, 3), (4, 7), (6, 2)]]
    rows = [(x, [v + 0.5 for v in y]) for x, y in rows] + [([1.0, 1.0, 2.0], [1.0, 3.0]), (list(map(float, range(12))), [v + 0.3 for v in range(10)]), ([], [1.0]),
                                                           ([5.0] * 3, [5.0] * 3), ([float(v) for v in range(30, 50)], [float(v) for v in range(15)])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = df.select(*(S.mann_whitney_p(V.mann_whitney_u("a", "b"), "a", "b", m) for m in ("auto", "exact", "asymptotic"))).collect()
    turned = df.select(S.mann_whitney_p(V.mann_whitney_u("b", "a"), "b", "a")).collect()
    assert [p or -1 for p, _, _ in got] == pytest.approx([p or -1 for p, in turned], rel=1e-12)
    for (x, y), (auto, exact, normal) in zip(rows, got):
        if not x:
            assert auto is exact is normal is None
            continue
        u = sum((a > b) + 0.5 * (a == b) for a in x for b in y)
        m, n = len(x), len(y)
        ties = sum(c ** 3 - c for c in Counter(x + y).values())
        sd = math.sqrt(m * n / 12 * (m + n + 1 - ties / ((m + n) * (m + n - 1))))
        want = 1.0 if sd == 0 else min(1.0, math.erfc((abs(u - m * n / 2) - 0.5) / sd / math.sqrt(2)))
        assert normal == pytest.approx(want, rel=1e-11)
        if not ties and m + n <= 12:
            us = [sum(v - k for k, v in enumerate(c)) for c in itertools.combinations(range(m + n), m)]
            want = min(1.0, 2 * sum(v >= max(u, m * n - u) for v in us) / len(us))
            assert exact == pytest.approx(want, rel=1e-12)
        assert auto == (exact if min(m, n) <= 8 and not ties else normal)


def test_normal_tail_over_the_whole_range(spark):
    zs = [-8.0, -3.0, -0.7, 0.0, 1e-9, 0.5, 1.96, 2.999, 3.0, 3.001, 5.0, 8.0, 20.0, 37.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select(S.normal_sf_col("z")).collect()
    for z, (p,) in zip(zs, got):
        assert p == pytest.approx(math.erfc(z / math.sqrt(2)) / 2, rel=1e-11)


def test_batched_solver_matches_numpy(spark):
    rng = np.random.default_rng(11)
    n, d = 400, 4
    x = rng.normal(size=(n, d)) * [1, 2, 0.5, 3] + [0, 1, -1, 2]
    beta = np.array([1.0, -0.5, 0.0, 0.3])
    p = 1 / (1 + np.exp(-(x - x.mean(0)) / x.std(0) @ beta))
    y = (rng.uniform(size=n) < p).astype(float)
    rows = [(i, float(y[i]), 0, 0, *map(float, x[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "_id long, _y double, _outer int, _inner int, a double, b double, c double, e double")
    lam, alpha = 0.02, 0.8
    spec = BL.WeightSpec("folds", outer_out=[-1], inner_out=[-1], inner_only=[-1])
    fits = BL.fit_batched(df, ["a", "b", "c", "e"], spec, np.array([lam]), np.array([alpha]))
    coef, icpt = fits.coefs, fits.intercepts
    assert fits.converged.all()
    # reference: proximal gradient on the standardised problem
    z = (x - x.mean(0)) / x.std(0)
    zb = np.column_stack([np.ones(n), z])
    t = np.zeros(d + 1)
    step = 1.0 / (0.25 * np.linalg.eigvalsh(zb.T @ zb / n).max() + lam * (1 - alpha))
    for _ in range(20000):
        pr = 1 / (1 + np.exp(-zb @ t))
        g = zb.T @ (pr - y) / n
        g[1:] += lam * (1 - alpha) * t[1:]
        t = t - step * g
        t[1:] = np.sign(t[1:]) * np.maximum(np.abs(t[1:]) - step * lam * alpha, 0)
    assert np.allclose(coef[0], t[1:], atol=1e-5) and icpt[0] == pytest.approx(t[0], abs=1e-5)


def test_auc_exact(spark):
    rng = np.random.default_rng(5)
    s = rng.integers(0, 20, size=300).astype(float)
    y = (rng.uniform(size=300) < 0.3 + s / 40).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    got = SE.auc(df, "y", "s").first()[0]
    pos, neg = s[y == 1], s[y == 0]
    brute = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert got == pytest.approx(brute)


def test_wilcoxon_and_t(spark):
    scores = [2, 1, 1, -1, 0, 2, 1, -2, 1, 1]
    df = spark.createDataFrame([(i, "clarity", s) for i, s in enumerate(scores)], "id long, dimension string, score int")
    w = SV.signed_rank_summary(df).first()
    nz = [s for s in scores if s != 0]
    ranks = {1: (1 + 6) / 2, 2: (7 + 9) / 2}
    wp = sum(ranks[abs(s)] for s in nz if s > 0)
    wm = sum(ranks[abs(s)] for s in nz if s < 0)
    assert (w.w_plus, w.w_minus, w.w) == (wp, wm, min(wp, wm))
    t = SV.score_summary(df).first()
    assert t.t == pytest.approx(np.mean(scores) / (np.std(scores, ddof=1) / math.sqrt(len(scores))))
    res = SV.preference_tests(df).first()
    assert 0 < res.p_t < 1 and 0 < res.p_w <= 1


def test_preference_tests_with_millions_of_ties(spark):
    n = 2_200_000       # its cube exceeds a long
    df = spark.range(n).select(F.lit("d").alias("dimension"), F.when(F.col("id") % 5 < 3, 1).otherwise(-1).alias("score"))
    res = SV.preference_tests(df).first()
    assert (res.n, res.p_w) == (n, 0.0) and res.w == pytest.approx(n * 0.4 * (n + 1) / 2)
    even = SV.preference_tests(df.withColumn("score", F.when(F.rand(3) < 0.5, 1).otherwise(-1))).first()
    # for signs alone the tie-corrected z is that of the sign test, as is t for many rows
    assert even.p_w == pytest.approx(even.p_t, rel=1e-3)


def test_spearman_computes_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf
    df = spark.range(100).selectExpr("double(id) x", "double(id * id) y").mapInPandas(count, "x double, y double")
    assert V.spearman(df, "x", "y")["rho"] == pytest.approx(1) and seen.value == 100


def test_fold_stability(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "a", 0.0), (3, "a", 0.3), (1, "b", -1.0), (2, "b", 1.0),
                                (3, "b", -1.0)], "fold int, feature string, coef double")
    r = {x.feature: x for x in SE.fold_stability(df, n_folds=3).collect()}
    assert r["a"].selection_freq == pytest.approx(2 / 3) and r["a"].avg_std_coef == pytest.approx(0.4)
    assert r["b"].sign_consistency == pytest.approx(1 / 3)


def test_paired_logistic_zero_variance_equals_glm(spark):
    rng = np.random.default_rng(2)
    n = 600
    x = rng.normal(size=(n, 2))
    y = (rng.uniform(size=n) < 1 / (1 + np.exp(-(0.3 + x @ [1.0, -0.7])))).astype(float)
    df = spark.createDataFrame([(i // 2, float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(n)],
                               "pair long, y double, a double, b double")
    pl = {r.term: r for r in SE.paired_logistic(df, ["a", "b"], "y", "pair").collect()}
    glm = {r.term: r.estimate for r in SE.logistic_regression(df, ["a", "b"], "y").collect()}
    sd = pl["a"].sd_intercept
    # no pair effect in the data: the variance sits at (or near) the boundary and
    # the fixed effects agree with the GLM
    assert sd < 0.35
    for t in ("(Intercept)", "a", "b"):
        assert pl[t].estimate == pytest.approx(glm[t], abs=0.05)


def test_mattr_blocks_equal_direct(spark):
    from corpusdelta.operators import features as FT
    rng = np.random.default_rng(4)
    rows = []
    for d_id, n in [(1, 30), (2, 700), (3, 51)]:
        words = [f"w{int(x)}" for x in rng.integers(0, 40, size=n)]
        for i, w_ in enumerate(words):
            rows.append((d_id, i // 13, i % 13, w_))
    df = spark.createDataFrame(rows, "doc_id long, sent_id long, pos_in_sent long, lemma string")
    got = {r.doc_id: r.mattr for r in FT.mattr(df, window=50, block=64).collect()}
    for d_id in (1, 2, 3):
        seq = [r[3] for r in rows if r[0] == d_id]
        if len(seq) < 50:
            want = len(set(seq)) / len(seq)
        else:
            want = np.mean([len(set(seq[i:i + 50])) / 50 for i in range(len(seq) - 49)])
        assert got[d_id] == pytest.approx(want)


def test_rank_within_matches_row_number(spark):
    from corpusdelta.operators.tokens import rank_within
    df = spark.createDataFrame([(i % 3, (i * 7919) % 101) for i in range(300)], "g long, v long")
    got = sorted((r.g, r.v, r.rank) for r in rank_within(df, ["g"], ["v"]).collect())
    exp = []
    for g in range(3):
        vs = sorted(v for gg, v in [(i % 3, (i * 7919) % 101) for i in range(300)] if gg == g)
        exp += [(g, v, k + 1) for k, v in enumerate(vs)]
    assert got == sorted(exp)


def test_cumsum_within(spark):
    from corpusdelta.operators.tokens import cumsum_within
    rows = [(g, i, (i * 37) % 11) for g in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "g long, i long, v long")
    got = {(r.g, r.i): r.cum for r in cumsum_within(df, ["g"], ["i"], "v").collect()}
    for g in range(3):
        run = 0
        for i in range(40):
            assert got[(g, i)] == run
            run += (i * 37) % 11


def test_ngram_counts_and_totals_one_pass(spark):
    t = annotated(source_docs(spark, SF_SMALL))
    freqs, totals = C.ngram_counts_and_totals(t, n=3)
    want = {r.corpus: r["count"] for r in t.groupBy("corpus").count().collect()}
    assert totals == want
    a = {(r.corpus, r.target): r.freq for r in freqs.collect()}
    b = {(r.corpus, r.target): r.freq for r in C.ngram_counts(t, n=3).collect()}
    assert a == b


def test_hedges_count_phrases_of_any_length(spark):
    from corpusdelta.operators import features as FT
    st = spark.createDataFrame([(1, "to the best of our knowledge this may be".split()), (1, ["maybe"]), (2, ["no"]), (3, [])],
                               "doc_id long, tokens array<string>")
    phrases = spark.createDataFrame([("to the best of our knowledge",), ("maybe",), ("may be",), (None,)], "phrase string")
    assert {r.doc_id: r.n_hedges for r in FT.hedges(st, phrases).collect()} == {1: 3, 2: 0, 3: 0}
    assert {r.n_hedges for r in FT.hedges(st, phrases.limit(0)).collect()} == {0}


def test_median_is_the_mean_of_the_middle_values(spark):
    from corpusdelta.operators.groups import group_stats_long
    rows = [("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 10.0), ("b", 5.0), ("b", None), (None, 7.0), (None, 8.0), ("c", None)]
    got = {r.g: r.median for r in group_stats_long(spark.createDataFrame(rows, "g string, x double"), "g").collect()}
    assert got == {"a": 2.5, "b": 5.0, None: 7.5, "c": None}


@pytest.mark.parametrize("times", [1, 2, 3])
def test_global_hapax_for_any_number_of_times(spark, times):
    from corpusdelta.operators import features as FT
    docs = {1: "x x x y z q", 2: "y z", 3: "y w w", 4: "w"}
    t = spark.createDataFrame([(d, w) for d, ws in docs.items() for w in ws.split()], "doc_id long, lemma string")
    total = " ".join(docs.values()).split()
    want = {d: len({w for w in ws.split() if total.count(w) == times}) for d, ws in docs.items()}
    assert {r.doc_id: r[1] for r in FT.global_hapax(t, times=times).collect()} == want


@pytest.mark.parametrize("kind,values", [
    ("boolean", [True, False, None]), ("double", [1e20, 0.1, None]), ("string", ["a", "", None]), ("date", ["2024-01-01", "1999-12-31", None])])
def test_ranks_and_sums_of_groups_of_any_type(spark, kind, values):
    """Groups that span range partitions, in every type, null included."""
    from corpusdelta.operators.tokens import cumsum_within, rank_within
    rows = [(values[i % 3], i, i % 5) for i in range(900)]
    df = spark.createDataFrame(rows, f"g {'string' if kind == 'date' else kind}, i int, v int").selectExpr(f"CAST(g AS {kind}) AS g", "i", "v")
    got = {}
    for r in rank_within(df, ["g"], ["i"]).collect():
        got.setdefault(r.g, []).append((r.i, r["rank"]))
    assert len(got) == 3 and all([k for _, k in sorted(x)] == list(range(1, 301)) for x in got.values())
    sums = {}
    for r in cumsum_within(df, ["g"], ["i"], "v").collect():
        sums.setdefault(r.g, []).append((r.i, r.v, r.cum))
    for x in sums.values():
        run = 0
        for _, v, cum in sorted(x):
            assert cum == run
            run += v


def test_keyness_of_listed_pairs_equals_all_pairs(spark):
    f = C.unigram_counts(annotated(source_docs(spark, SF_SMALL)))
    for how in ("inner", "outer"):
        every = K.keyness_all_pairs(f, how=how)
        some = K.keyness_all_pairs(f, how=how, pairs=[("src0", "src1"), ("src3", "src7")])
        key = lambda r: (r.corpus1, r.corpus2, r.target, r.freq1, r.freq2, round(r.ll, 9))
        want = sorted(key(r) for r in every.where("(corpus1 = 'src0' AND corpus2 = 'src1') OR (corpus1 = 'src3' AND corpus2 = 'src7')").collect())
        assert want and sorted(map(key, some.collect())) == want


def test_keyness_totals_dict_equals_table(spark):
    t = annotated(source_docs(spark, SF_SMALL))
    f2 = C.ngram_counts(t, n=2)
    tot_df = C.corpus_size(C.unigram_counts(t))
    tot = {r.corpus: r.total for r in tot_df.collect()}
    a = {r.target: round(r.ll, 9) for r in K.keyness(f2, "src0", "src1", totals=tot_df).collect()}
    b = {r.target: round(r.ll, 9) for r in K.keyness(f2, "src0", "src1", totals=tot).collect()}
    assert a == b and len(a) > 0
