"""Registered vector plans.

Fixture (FIXTURES.md #15-16): ``embeddings`` is corpus/run 1 with words
``w<vec_id>``; run 2 is a fixed orthogonal map of it (coordinates shifted
by one, every second sign flipped); corpus 2 is a fixed perturbation
(``x + 0.05 * ((i + vec_id) % 5 - 2)``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusdelta.functions import fixed
from corpusdelta.operators import keyness as K
from corpusdelta.operators import tokens as tok
from corpusdelta.operators import vectors as V
from corpusdelta.plans import sqlbits as Q
from corpusdelta.plans.common import annotated, quality_docs, rounded, table
from corpusdelta.plans.lexical import _quality_keyness, _quality_keyness_sql
from corpusdelta.session import cut

PLANS: dict = {}
K_NN = 10
BLOCK_ROWS = 2048       # at most this many vectors per block; at least 4 blocks (operator default)


def plan(name, sql=None):
    def deco(fn):
        PLANS[name] = (fn, sql)
        return fn
    return deco


def run1(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"),
                    F.col("embedding").alias("vec"), (F.col("label") + 1).cast("long").alias("count"),
                    "vec_id")


def run2(spark, sf):
    r = run1(spark, sf)
    d = F.size("vec")
    rot = F.transform(F.sequence(F.lit(0), d - 1),
                      lambda i: F.element_at("vec", (i + 1) % d + 1) * (1 - 2 * (i % 2)))
    return r.withColumn("vec", rot)


def corpus2(spark, sf):
    r = run1(spark, sf)
    pert = F.transform("vec", lambda x, i: x.cast("double") + 0.05 * ((i + F.col("vec_id")) % 5 - 2))
    return r.withColumn("vec", pert)


NORM = "list_transform(@V@, lambda x: x / sqrt(list_sum(list_transform(@V@, lambda y: y * y))))"


def _norm(v):
    return NORM.replace("@V@", v)


V1 = f"v1 AS (SELECT 'w' || CAST(vec_id AS VARCHAR) AS word, vec_id, {_norm('CAST(embedding AS DOUBLE[])')} AS v, " \
     "CAST(embedding AS DOUBLE[]) AS raw FROM embeddings)"
V2 = ("v2 AS (SELECT word, vec_id, " + _norm("p") + " AS v FROM (SELECT 'w' || CAST(vec_id AS VARCHAR) AS word, vec_id, "
      "list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x + 0.05 * ((i - 1 + vec_id) % 5 - 2)) AS p FROM embeddings))")


def _density_sql(src, name):
    return (f"s_{name} AS (SELECT a.word, b.word AS nb, list_dot_product(a.v, b.v) AS sim FROM {src} a JOIN {src} b "
            f"ON a.word <> b.word),\n"
            f"r_{name} AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY sim DESC, nb) AS rk FROM s_{name}),\n"
            f"d_{name} AS (SELECT word, AVG(sim) AS mean, stddev_samp(sim) AS std FROM r_{name} WHERE rk <= {K_NN} "
            f"GROUP BY word)")


@plan("normalise_vectors", f"WITH {V1}\nSELECT word, list_transform(v, lambda x: round(x, 6)) AS v FROM v1")
def q_normalise_vectors(spark, sf):
    r = run1(spark, sf)
    return r.select("word", F.transform(V.normalise("vec"), lambda x: F.round(x, 6)).alias("v"))


@plan("top_k_neighbours", f"WITH {V1},\n{_density_sql('v1', 'a')}\n"
      "SELECT word, CAST(rk AS BIGINT) AS rank, nb AS neighbour, round(sim, 6) AS sim FROM r_a WHERE rk <= 10")
def q_top_k_neighbours(spark, sf):
    return rounded(V.top_k_neighbours(run1(spark, sf), k=K_NN, block_rows=BLOCK_ROWS))


@plan("top_k_neighbours_indexed", f"WITH {V1},\n{_density_sql('v1', 'a')}\n"
      "SELECT word, CAST(rk AS BIGINT) AS rank, nb AS neighbour, round(sim, 6) AS sim FROM r_a WHERE rk <= 10")
def q_top_k_neighbours_indexed(spark, sf):
    """T3 through the ball index, in small blocks."""
    return rounded(V.top_k_neighbours(run1(spark, sf), k=K_NN, block_rows=64, indexed=True))


@plan("neighbour_density", f"WITH {V1},\n{_density_sql('v1', 'a')}\n"
      "SELECT word, round(mean, 6) AS mean, round(std, 6) AS std FROM d_a")
def q_neighbour_density(spark, sf):
    return rounded(V.neighbour_density(run1(spark, sf), k=K_NN, block_rows=BLOCK_ROWS).drop("cosines"))


AVG_SQL = (f"WITH {V1},\n{V2},\n"
           "s AS (SELECT a.word, b.word AS nb, (list_dot_product(a.v, b.v) + list_dot_product(c.v, d.v)) / 2 AS sim "
           "FROM v1 a JOIN v1 b ON a.word <> b.word JOIN v2 c ON c.word = a.word JOIN v2 d ON d.word = b.word),\n"
           "r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY sim DESC, nb) AS rk FROM s)\n"
           "SELECT word, round(AVG(sim), 6) AS mean, round(stddev_samp(sim), 6) AS std FROM r WHERE rk <= 10 GROUP BY word")


@plan("avg_similarity", AVG_SQL)
def q_avg_similarity(spark, sf):
    both = run1(spark, sf).withColumn("run", F.lit(1)).unionByName(corpus2(spark, sf).withColumn("run", F.lit(2)))
    cat = V.concat_runs(both.select("word", "run", "vec"), [1, 2])
    d = V.neighbour_density(cat, k=K_NN, block_rows=BLOCK_ROWS, normalised=True)
    return rounded(d.drop("cosines"))


def _densities(spark, sf):
    d1 = V.neighbour_density(run1(spark, sf), k=K_NN, block_rows=BLOCK_ROWS)
    d2 = V.neighbour_density(corpus2(spark, sf), k=K_NN, block_rows=BLOCK_ROWS)
    return d1, d2


TWO_SQL = f"WITH {V1},\n{V2},\n{_density_sql('v1', 'a')},\n{_density_sql('v2', 'b')}"


@plan("join_density_runs", TWO_SQL + """
SELECT d_a.word, round(d_a.mean, 6) AS mean1, round(d_a.std, 6) AS std1, round(d_b.mean, 6) AS mean2, round(d_b.std, 6) AS std2
FROM d_a JOIN d_b ON d_a.word = d_b.word""")
def q_join_density_runs(spark, sf):
    d1, d2 = _densities(spark, sf)
    j = d1.select("word", F.col("mean").alias("mean1"), F.col("std").alias("std1")).join(
        d2.select("word", F.col("mean").alias("mean2"), F.col("std").alias("std2")), "word")
    return rounded(j)


@plan("density_shift", TWO_SQL + """
SELECT d_a.word, round(d_b.mean - d_a.mean, 6) AS delta_nn FROM d_a JOIN d_b ON d_a.word = d_b.word""")
def q_density_shift(spark, sf):
    d1, d2 = _densities(spark, sf)
    return rounded(V.density_shift(V.density_compare(d1, d2)).select("word", "delta_nn"))


MW_SQL = TWO_SQL + """,
ca AS (SELECT word, list(sim ORDER BY sim DESC) AS c FROM r_a WHERE rk <= 10 GROUP BY word),
cb AS (SELECT word, list(sim ORDER BY sim DESC) AS c FROM r_b WHERE rk <= 10 GROUP BY word)"""


@plan("mann_whitney", MW_SQL + """
SELECT ca.word, round(CAST(list_sum(list_transform(ca.c, lambda x: list_sum(list_transform(cb.c,
  lambda y: CASE WHEN x > y THEN 1.0 WHEN x = y THEN 0.5 ELSE 0.0 END)))) AS DOUBLE), 6) AS stat FROM ca JOIN cb ON ca.word = cb.word""")
def q_mann_whitney(spark, sf):
    d1, d2 = _densities(spark, sf)
    return rounded(V.density_compare(d1, d2).select("word", "stat"))


def _sf_sql(z):
    """Upper tail of the standard normal of ``z`` >= 0: series below 3, else the
    continued fraction."""
    density = f"(exp(-{z} * {z} / 2) / sqrt(2 * pi()))"
    series = (f"list_reduce(list_transform(range(0, 61), lambda k: {{'k': k::DOUBLE, 'term': {z}, 'sum': {z}}}), lambda s, t: "
              f"{{'k': t.k, 'term': s.term * {z} * {z} / (2 * t.k + 1), 'sum': s.sum + s.term * {z} * {z} / (2 * t.k + 1)}}).sum")
    fraction = f"list_reduce(list_concat([{z}], list_transform(range(0, 100), lambda i: (100 - i)::DOUBLE)), lambda acc, k: {z} + k / acc)"
    return f"CASE WHEN {z} < 3 THEN 0.5 - {density} * {series} ELSE {density} / {fraction} END"


@plan("density_compare", MW_SQL + f""",
st AS (SELECT ca.word, list_concat(ca.c, cb.c) AS v, len(ca.c) AS m, len(cb.c) AS n, CAST(list_sum(list_transform(ca.c,
  lambda x: list_sum(list_transform(cb.c, lambda y: CASE WHEN x > y THEN 1.0 WHEN x = y THEN 0.5 ELSE 0.0 END)))) AS DOUBLE) AS stat
  FROM ca JOIN cb ON ca.word = cb.word),
sd AS (SELECT *, sqrt(m * n / 12.0 * (m + n + 1 - list_sum(list_transform(list_distinct(v),
  lambda x: power(len(list_filter(v, lambda y: y = x)), 3) - len(list_filter(v, lambda y: y = x)))) / ((m + n) * (m + n - 1.0)))) AS sd FROM st),
z AS (SELECT *, (abs(stat - m * n / 2.0) - 0.5) / sd AS z0, abs((abs(stat - m * n / 2.0) - 0.5) / sd) AS z FROM sd)
SELECT z.word, round(d_a.mean, 6) AS mean1, round(d_a.std, 6) AS std1, round(d_b.mean, 6) AS mean2, round(d_b.std, 6) AS std2,
  round(stat, 6) AS stat, round(CASE WHEN sd = 0 OR z0 < 0 THEN 1.0 ELSE least(1.0, 2 * ({_sf_sql('z')})) END, 6) AS pval
FROM z JOIN d_a ON d_a.word = z.word JOIN d_b ON d_b.word = z.word""")
def q_density_compare(spark, sf):
    d1, d2 = _densities(spark, sf)
    return rounded(V.density_compare(d1, d2))


@plan("procrustes_align", f"WITH {V1}\nSELECT word, list_transform(raw, lambda x: round(x, 4) + 0.0) AS vec FROM v1")
def q_procrustes_align(spark, sf):
    al = V.procrustes_align(run1(spark, sf), run2(spark, sf))
    return al.select("word", F.transform("vec", lambda x: F.round(x, 4) + F.lit(0.0)).alias("vec"))


@plan("aligned_self_similarity", f"WITH {V1}\nSELECT word, CAST(1.0 AS DOUBLE) AS sim FROM v1")
def q_aligned_self_similarity(spark, sf):
    base = run1(spark, sf)
    al = V.procrustes_align(base, run2(spark, sf))
    return rounded(V.aligned_self_similarity(base, al), 5)


def _runs(spark, sf, n=3):
    """Stand-in of ``n`` training runs of two corpora: the embeddings, shifted by
    word, run and dimension; the second corpus lacks some words of each run."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding").withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(n))))
    word = F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word")

    def shifted(step, scale):
        return F.transform("embedding", lambda x, i: x.cast("double") + scale * ((i * step + F.col("vec_id") * F.col("run")) % 7 - 3)).alias("vec")
    base = e.select("run", word, shifted(1, 0.01))
    other = e.where((F.col("vec_id") + F.col("run")) % 11 != 0).select("run", word, shifted(3, 0.04))
    return base, other, list(range(1, n + 1))


@plan("aligned_similarity_runs")
def q_aligned_similarity_runs(spark, sf):
    """M5, M6 over three runs: the similarity of every word to itself after
    alignment, by run and on average."""
    base, other, runs = _runs(spark, sf)
    s = V.aligned_similarity_runs(base, other, runs)
    return s.select("word", F.transform("sims", lambda x: F.round(x, 6)).alias("sims"), F.round("avg", 6).alias("avg"))


@plan("shared_vocab", f"""{_quality_keyness_sql('inner', False)}
SELECT target AS word, freq1 AS c1, freq2 AS c2, freq1 + freq2 AS total FROM k""")
def q_shared_vocab(spark, sf):
    t = annotated(quality_docs(spark, sf))
    from corpusdelta.operators import counts as C
    f = cut(C.unigram_counts(t, by="corpus"))      # read for both sides, and again for the sort
    v1 = f.filter(F.col("corpus") == "q0").select(F.col("target").alias("word"), F.col("freq").alias("count"))
    v2 = f.filter(F.col("corpus") == "q1").select(F.col("target").alias("word"), F.col("freq").alias("count"))
    return V.shared_vocab(v1, v2)


# ------------------------------------------------------------------ J8, X5: keyness words get vectors
def _keyed_vectors(spark, sf):
    """Every keyness word takes an embedding (by its rank), shifted by the rank
    so that words that share one differ."""
    k = cut(K.content_words(_quality_keyness(spark, sf)))      # read by both densities and the join
    ids = tok.dense_ids(k.select("target"), ["target"], "rk")
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    j = (ids.withColumn("vec_id", F.col("rk") % e.count()).join(e, "vec_id")
         .withColumn("raw", F.transform("embedding", lambda x, i: x.cast("double") + 0.01 * ((i * 7 + F.col("rk")) % 11 - 5))))
    v1 = j.select(F.col("target").alias("word"), F.col("raw").alias("vec"))
    v2 = j.select(F.col("target").alias("word"),
                  F.transform("raw", lambda x, i: x + 0.05 * ((i + F.col("vec_id")) % 5 - 2)).alias("vec"))
    return k, v1, v2


KEYED_SQL = _quality_keyness_sql("inner", False) + f""",
cw AS (SELECT * FROM k WHERE {Q.content_filter()}),
ids AS (SELECT target, row_number() OVER (ORDER BY target) - 1 AS rk FROM cw),
ke AS (SELECT ids.target AS word, e.vec_id, list_transform(CAST(e.embedding AS DOUBLE[]), lambda x, i: x + 0.01 * (((i - 1) * 7 + rk) % 11 - 5)) AS raw
       FROM ids JOIN embeddings e ON e.vec_id = ids.rk % (SELECT COUNT(*) FROM embeddings)),
ka AS (SELECT word, {_norm('raw')} AS v FROM ke),
kb AS (SELECT word, {_norm('p')} AS v FROM (SELECT word, list_transform(raw, lambda x, i: x + 0.05 * ((i - 1 + vec_id) % 5 - 2)) AS p FROM ke)),
{_density_sql('ka', 'a')},
{_density_sql('kb', 'b')},
dc AS (SELECT d_a.word, d_a.mean AS mean1, d_a.std AS std1, d_b.mean AS mean2, d_b.std AS std2, d_b.mean - d_a.mean AS delta_nn
       FROM d_a JOIN d_b ON d_a.word = d_b.word)"""


def _keyed_density(spark, sf):
    k, v1, v2 = _keyed_vectors(spark, sf)
    d1 = V.neighbour_density(v1, k=K_NN, block_rows=BLOCK_ROWS)
    d2 = V.neighbour_density(v2, k=K_NN, block_rows=BLOCK_ROWS)
    dc = V.density_shift(V.density_compare(d1, d2))
    return k, dc


@plan("attach_density", KEYED_SQL + """
SELECT cw.target, round(cw.ll, 6) AS ll, round(dc.mean1, 6) AS mean1, round(dc.mean2, 6) AS mean2, round(dc.delta_nn, 6) AS delta_nn
FROM cw LEFT JOIN dc ON cw.target = dc.word""")
def q_attach_density(spark, sf):
    k, dc = _keyed_density(spark, sf)
    j = V.attach_density(k, dc.select("word", "mean1", "mean2", "delta_nn"))
    return rounded(j.select("target", "ll", "mean1", "mean2", "delta_nn"))


@plan("spearman", KEYED_SQL + f""",
sg AS (SELECT CASE WHEN cw.ratio_t2 < 1 THEN -cw.ll ELSE cw.ll END AS x, dc.delta_nn AS y FROM cw JOIN dc ON cw.target = dc.word
       WHERE cw.ll > {fixed.LL_CRITICAL}),
rk AS (SELECT (rank() OVER (ORDER BY x) + COUNT(*) OVER () + 1 - rank() OVER (ORDER BY x DESC)) / 2.0 AS ax,
              (rank() OVER (ORDER BY y) + COUNT(*) OVER () + 1 - rank() OVER (ORDER BY y DESC)) / 2.0 AS ay FROM sg)
SELECT round(corr(ax, ay), 6) AS rho,
       COUNT(*) AS n FROM rk""")
def q_spearman(spark, sf):
    k, dc = _keyed_density(spark, sf)
    j = K.signed_ll(V.attach_density(k, dc, how="inner")).filter(F.col("ll") > fixed.LL_CRITICAL)
    res = V.spearman(j, "signed_ll", "delta_nn")
    return spark.createDataFrame([(round(res["rho"], 6), int(res["n"]))], "rho double, n long")


# ------------------------------------------------------------------ M1 (rows only)
@plan("train_word2vec")
def q_train_word2vec(spark, sf):
    st = tok.sentence_tokens(table(spark, sf, "documents"))
    return V.train_word2vec(st, dims=100, window=5, min_count=100)
