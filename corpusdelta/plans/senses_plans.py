"""Registered plans for senses, topics, ratings and language id
(J15, F14, W9, M9-M11, W6, W7, A11, M12-M16, A12, M18, P24, F15, F16, A13,
W12, X7-X9, F12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusdelta.operators import keyness as K
from corpusdelta.operators import langid as LI
from corpusdelta.operators import postings as PO
from corpusdelta.operators import senses as SN
from corpusdelta.operators import survey as SV
from corpusdelta.operators import tokens as tok
from corpusdelta.operators import topics as TP
from corpusdelta.plans import sqlbits as Q
from corpusdelta.plans.corpus_plans import TIMED_SQL
from corpusdelta.plans.common import quality_docs, rounded, table
from corpusdelta.plans.lexical import _quality_keyness, _quality_keyness_sql
from corpusdelta.session import cut, new_folder

PLANS: dict = {}


def plan(name, sql=None):
    def deco(fn):
        PLANS[name] = (fn, sql)
        return fn
    return deco


SID = 1_000_000


# ------------------------------------------------------------------ J15, W9, F14, W7
def _sentences(spark, sf):
    d = quality_docs(spark, sf)
    st = tok.sentence_targets(d, keep=("corpus",))
    return st.select(F.when(F.col("corpus") == "q0", "t1").otherwise("t2").alias("time"),
                     (F.col("doc_id") * SID + F.col("sent_id")).alias("sent_id"),
                     F.col("targets").alias("lemmas"), "tokens")


def _targets(spark, sf):
    return K.select_cluster_targets(_quality_keyness(spark, sf), n=100).select("target")


TS_SQL = _quality_keyness_sql("inner", False) + f""",
tg AS (SELECT target FROM (SELECT target FROM k WHERE ratio_t2 < 1 ORDER BY round(ll, 6) DESC, target LIMIT 100)
       UNION ALL SELECT target FROM (SELECT target FROM k WHERE ratio_t2 > 1 ORDER BY round(ll, 6) DESC, target LIMIT 100)),
ts AS (SELECT DISTINCT ann.target, CASE WHEN corpus = 'q0' THEN 't1' ELSE 't2' END AS time, doc_id * {SID} + sent_id AS sent_id
       FROM ann WHERE ann.target IN (SELECT target FROM tg)),
smp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target, time ORDER BY md5('42:' || CAST(sent_id AS VARCHAR)), sent_id) AS rn
        FROM ts) WHERE rn <= 20),
sl AS (SELECT doc_id * {SID} + sent_id AS sent_id, list(target ORDER BY pos_in_sent) AS lemmas, list(token ORDER BY pos_in_sent) AS tokens
       FROM ann GROUP BY doc_id, sent_id)"""


@plan("target_sentences", TS_SQL + "\nSELECT target, time, sent_id FROM ts")
def q_target_sentences(spark, sf):
    return SN.target_sentences(_sentences(spark, sf), _targets(spark, sf))


@plan("target_sentences_indexed", TS_SQL + "\nSELECT target, time, sent_id FROM ts")
def q_target_sentences_indexed(spark, sf):
    """J15 from a written index of the sentences."""
    path = new_folder(spark, "postings")
    PO.write_postings(_sentences(spark, sf), path)
    return PO.lookup(spark, path, cut(_targets(spark, sf)))


@plan("sample_per_group", TS_SQL + "\nSELECT target, time, sent_id FROM smp")
def q_sample_per_group(spark, sf):
    return SN.sample_per_group(SN.target_sentences(_sentences(spark, sf), _targets(spark, sf)), ["target", "time"], 20)


@plan("surface_form_of_target", TS_SQL + """
SELECT ts.target, ts.sent_id, sl.tokens[list_position(sl.lemmas, ts.target)] AS surface FROM ts JOIN sl ON ts.sent_id = sl.sent_id""")
def q_surface_form_of_target(spark, sf):
    from corpusdelta.functions.text import surface_form
    from corpusdelta.session import cut
    sents = cut(_sentences(spark, sf))        # read twice: index lookup and the join back
    s = SN.target_sentences(sents, _targets(spark, sf)).join(sents.select("sent_id", "lemmas", "tokens"), "sent_id")
    return s.select("target", "sent_id", surface_form("lemmas", "tokens", F.col("target")).alias("surface"))


KWIC_SQL = """list_filter(range(1, len(tk) + 1), lambda i: lower(tk[i]) = kw)"""


@plan("kwic", TS_SQL + """,
kq AS (SELECT ts.target, ts.sent_id, sl.tokens AS tk, regexp_extract(ts.target, '^(.*):[^:]*$', 1) AS kw FROM ts JOIN sl ON ts.sent_id = sl.sent_id),
kh AS (SELECT *, list_filter(range(1, len(tk) + 1), lambda i: lower(tk[i]) = kw) AS h FROM kq)
SELECT target, sent_id, array_to_string(list_transform(range(1, len(h) + 2), lambda j:
  CASE WHEN j <= len(h) THEN
    array_to_string(tk[greatest(CASE WHEN j > 1 THEN h[j - 1] ELSE 0 END + 1, h[j] - 8):h[j] - 1], ' ') || ' & ' || tk[h[j]]
  ELSE array_to_string(tk[CASE WHEN len(h) > 0 THEN h[len(h)] ELSE 0 END + 1:CASE WHEN len(h) > 0 THEN h[len(h)] ELSE 0 END + 8], ' ')
  END), ' & ') AS kwic FROM kh""")
def q_kwic(spark, sf):
    from corpusdelta.session import cut
    sents = cut(_sentences(spark, sf))        # read twice: index lookup and the join back
    s = SN.target_sentences(sents, _targets(spark, sf)).join(sents.select("sent_id", "tokens"), "sent_id")
    kw = F.regexp_extract("target", "^(.*):[^:]*$", 1)
    return SN.kwic(s, kw).select("target", "sent_id", "kwic")


# ------------------------------------------------------------------ M9, M10 (rows only)
def _target_embeddings(spark, sf):
    from corpusdelta.operators import vectors as V
    from corpusdelta.session import cut
    s = cut(_sentences(spark, sf))            # read three times: vectors, index lookup, contexts
    vecs = V.train_word2vec(s.select(F.col("lemmas").alias("tokens")), dims=32, min_count=20)
    hits = SN.sample_per_group(SN.target_sentences(s, _targets(spark, sf)), ["target", "time"], 1000)
    return SN.target_embeddings(s.select("sent_id", F.col("lemmas").alias("tokens")), hits, vecs, window=5)


@plan("target_embeddings")
def q_target_embeddings(spark, sf):
    return _target_embeddings(spark, sf)


@plan("sense_clusters")
def q_sense_clusters(spark, sf):
    """The whole chain: index lookup, sample of 1000 per target and period,
    context vectors, k-means per target, distance and order in the cluster."""
    c = SN.cluster_target_senses(_target_embeddings(spark, sf), k=8, seed=42)
    return rounded(SN.centroid_order(c))


EMB_SQL = """emb AS (SELECT 't' || CAST(vec_id % 3 AS VARCHAR) AS target, vec_id AS sent_id, CAST(label AS BIGINT) AS clust,
  CASE WHEN vec_id % 2 = 0 THEN 't1' ELSE 't2' END AS time, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"""


def _emb(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.concat(F.lit("t"), (F.col("vec_id") % 3).cast("string")).alias("target"),
                    F.col("vec_id").alias("sent_id"), F.col("label").cast("long").alias("clust"),
                    F.when(F.col("vec_id") % 2 == 0, "t1").otherwise("t2").alias("time"),
                    F.col("embedding").alias("vec"))


@plan("cluster_target_senses")
def q_cluster_target_senses(spark, sf):
    e = SN.sample_per_group(_emb(spark, sf).drop("clust"), ["target", "time"], 1000)
    return rounded(SN.cluster_target_senses(e, k=8, seed=42))


CENT_SQL = f"""WITH {EMB_SQL},
ex AS (SELECT target, clust, unnest(vec) AS x, unnest(range(1, len(vec) + 1)) AS i FROM emb),
ce AS (SELECT target, clust, list(ax ORDER BY i) AS cen FROM (SELECT target, clust, i, AVG(x) AS ax FROM ex GROUP BY target, clust, i)
       GROUP BY target, clust),
cd AS (SELECT emb.target, emb.clust, emb.sent_id, emb.time,
       1 - list_dot_product(emb.vec, ce.cen) / (sqrt(list_dot_product(emb.vec, emb.vec)) * sqrt(list_dot_product(ce.cen, ce.cen))) AS dist
       FROM emb JOIN ce ON emb.target = ce.target AND emb.clust = ce.clust)"""


@plan("centroid_distance", CENT_SQL + "\nSELECT target, clust, sent_id, round(dist, 6) AS dist FROM cd")
def q_centroid_distance(spark, sf):
    return rounded(SN.centroid_distance(_emb(spark, sf)).select("target", "clust", "sent_id", "dist"))


@plan("centroid_order", CENT_SQL + """
SELECT target, clust, sent_id, row_number() OVER (PARTITION BY target, clust ORDER BY dist, sent_id) AS "order" FROM cd""")
def q_centroid_order(spark, sf):
    return SN.centroid_order(SN.centroid_distance(_emb(spark, sf))).select("target", "clust", "sent_id", "order")


@plan("cluster_period_table", f"""WITH {EMB_SQL},
p AS (SELECT target, clust, COUNT(*) FILTER (WHERE time = 't1') AS t1, COUNT(*) FILTER (WHERE time = 't2') AS t2 FROM emb GROUP BY target, clust)
SELECT target, clust, NULLIF(t1, 0) AS t1, NULLIF(t2, 0) AS t2, NULLIF(t1, 0) + NULLIF(t2, 0) AS total,
 round(NULLIF(t2, 0) / (NULLIF(t1, 0) + NULLIF(t2, 0)), 6) AS prop_t2 FROM p""")
def q_cluster_period_table(spark, sf):
    return rounded(SN.cluster_period_table(_emb(spark, sf)))


# ------------------------------------------------------------------ topics
def _topic_docs(spark, sf):
    from corpusdelta.plans.corpus_plans import _timed
    p = _timed(spark, sf).select("doc_id", "full_text", "time")
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    p = p.withColumn("vec_id", F.col("doc_id") % e.count())     # every document takes a label
    return p.join(e, "vec_id").select("doc_id", "time", F.col("full_text").alias("text"),
                                      F.col("label").cast("long").alias("topic"), "embedding")


@plan("reassign_outliers", """WITH ex AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(1, len(embedding) + 1)) AS i
  FROM embeddings WHERE vec_id % 10 <> 0),
ce AS (SELECT label, list(ax ORDER BY i) AS cen FROM (SELECT label, i, AVG(x) AS ax FROM ex GROUP BY label, i) GROUP BY label),
o AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 10 = 0),
dd AS (SELECT o.vec_id, ce.label, list_distance(o.v, ce.cen) AS d FROM o, ce)
SELECT vec_id, CAST(label AS BIGINT) AS topic FROM embeddings WHERE vec_id % 10 <> 0
UNION ALL SELECT vec_id, CAST(arg_min(label, d) AS BIGINT) FROM dd GROUP BY vec_id""")
def q_reassign_outliers(spark, sf):
    e = table(spark, sf, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 10 == 0, F.lit(-1)).otherwise(F.col("label")).cast("long").alias("topic"),
        F.col("embedding").alias("vec"))
    return TP.reassign_outliers(e).select("vec_id", "topic")


TERMS_SQL = f"""WITH {TIMED_SQL[len('WITH '):]},
td AS (SELECT t.doc_id, t.time, t.full_text AS text, CAST(e.label AS BIGINT) AS topic FROM timed t JOIN embeddings e ON e.vec_id = t.doc_id % (SELECT COUNT(*) FROM embeddings)),
tt AS (SELECT topic, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS term FROM td),
tf AS (SELECT topic, term, COUNT(*) AS tf FROM tt WHERE length(term) >= 3 GROUP BY topic, term),
ft AS (SELECT term, SUM(tf) AS f FROM tf GROUP BY term),
av AS (SELECT SUM(tf) / COUNT(DISTINCT topic) AS a FROM tf),
sc AS (SELECT tf.topic, tf.term, tf.tf * ln(1 + av.a / ft.f) AS score FROM tf JOIN ft ON tf.term = ft.term, av),
rk AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(score, 9) DESC, term) AS rank FROM sc)"""


def _terms(spark, sf):
    d = _topic_docs(spark, sf)
    t = d.select("topic", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)).alias("term"))
    return TP.topic_terms(t.filter(F.length("term") >= 3), n=10)


@plan("topic_terms", TERMS_SQL + "\nSELECT topic, term, round(score, 6) AS score, rank FROM rk WHERE rank <= 10")
def q_topic_terms(spark, sf):
    return rounded(_terms(spark, sf).select("topic", "term", "score", "rank"))


@plan("document_topics", TERMS_SQL + """,
nm AS (SELECT topic, CAST(topic AS VARCHAR) || '_' || array_to_string(list(term ORDER BY rank), '_') AS name FROM rk WHERE rank <= 3 GROUP BY topic),
ev AS (SELECT doc_id, topic, CAST(embedding AS DOUBLE[]) AS v FROM td JOIN embeddings e ON e.vec_id = td.doc_id % (SELECT COUNT(*) FROM embeddings)),
ex AS (SELECT topic, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM ev),
ce AS (SELECT topic, list(ax ORDER BY i) AS cen FROM (SELECT topic, i, AVG(x) AS ax FROM ex GROUP BY topic, i) GROUP BY topic),
pr AS (SELECT ev.doc_id, SUM(exp(-list_distance(ev.v, ce.cen))) FILTER (WHERE ev.topic = ce.topic) / SUM(exp(-list_distance(ev.v, ce.cen))) AS prob
       FROM ev, ce GROUP BY ev.doc_id)
SELECT td.doc_id, td.topic, round(pr.prob, 6) AS prob, nm.name FROM td JOIN pr USING (doc_id) LEFT JOIN nm ON td.topic = nm.topic""")
def q_document_topics(spark, sf):
    d = TP.topic_probability(_topic_docs(spark, sf), "embedding")
    return rounded(TP.document_topics(d.select("doc_id"), d.select("doc_id", "topic", "prob"), _terms(spark, sf))
                   .select("doc_id", "topic", "prob", "name"))


@plan("topic_period_table", TERMS_SQL + """,
nm AS (SELECT topic, CAST(topic AS VARCHAR) || '_' || array_to_string(list(term ORDER BY rank), '_') AS name FROM rk WHERE rank <= 3 GROUP BY topic),
dn AS (SELECT nm.name, td.time FROM td JOIN nm ON td.topic = nm.topic WHERE td.time IN ('t1', 't2')),
tot AS (SELECT COUNT(*) FILTER (WHERE time = 't1') AS n1, COUNT(*) FILTER (WHERE time = 't2') AS n2 FROM dn),
p AS (SELECT name, NULLIF(COUNT(*) FILTER (WHERE time = 't1'), 0) AS t1, NULLIF(COUNT(*) FILTER (WHERE time = 't2'), 0) AS t2 FROM dn GROUP BY name)
SELECT name, t1, t2, t1 + t2 AS total_t1t2, round(t1 / (t1 + t2) * 100, 6) AS perc_in_t1, round(t2 / (t1 + t2) * 100, 6) AS perc_in_t2,
 round(t1 / (t1 + t2) * 100 + t2 / (t1 + t2) * 100, 6) AS total_t1t2_norm,
 round((t1 / (t1 + t2) * 100) / (t1 / (t1 + t2) * 100 + t2 / (t1 + t2) * 100) * 100, 6) AS perc_in_t1_norm,
 round((t2 / (t1 + t2) * 100) / (t1 / (t1 + t2) * 100 + t2 / (t1 + t2) * 100) * 100, 6) AS perc_in_t2_norm,
 round((t1 / n1) / (t1 / n1 + t2 / n2) * 100, 6) AS share_t1_by_period FROM p, tot""")
def q_topic_period_table(spark, sf):
    d = _topic_docs(spark, sf).filter(F.col("time").isin("t1", "t2"))
    named = TP.document_topics(d.select("doc_id", "time"), d.select("doc_id", "topic"), _terms(spark, sf))
    return rounded(TP.topic_period_table(named))


#: Candidate terms of a topic from which MMR chooses: its documented pool.
MMR_CANDIDATES = 30


@plan("mmr_terms")
def q_mmr_terms(spark, sf):
    d = _topic_docs(spark, sf)
    t = d.select("topic", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)).alias("term"))
    top = TP.topic_terms(t.filter(F.length("term") >= 3), n=MMR_CANDIDATES)
    topics = sorted(r["topic"] for r in top.select("topic").distinct().collect())      # bounded: topics
    prof = top.groupBy("term").pivot("topic", topics).agg(F.first("score")).fillna(0.0)
    prof = prof.select("term", F.array(*[F.col(str(t)) for t in topics]).alias("vec"))
    cands = top.select("topic", "term", "score").join(prof, "term")
    return TP.mmr_terms(cands, n=10)


@plan("topic_model")
def q_topic_model(spark, sf):
    return TP.topic_model(table(spark, sf, "documents"), k=20, min_topic_size=100)


# ------------------------------------------------------------------ M18, P24 (rows only)
@plan("language_id")
def q_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    model, labels = LI.train_language_id(docs)
    pred = LI.predict_language(model, labels, docs)
    return pred.groupBy("lang").agg(F.count(F.lit(1)).alias("n"),
                                    F.avg((F.col("pred_lang") == F.col("lang")).cast("double")).alias("accuracy"))


@plan("english_sentences")
def q_english_sentences(spark, sf):
    docs = table(spark, sf, "documents")
    model, labels = LI.train_language_id(docs)
    s = tok.sentences(docs)
    return LI.english_sentences(model, labels, s).select("doc_id", "sent_id", "sentence")


# ------------------------------------------------------------------ ratings
RATE_SQL = """r0 AS (SELECT event_id AS id, CASE WHEN user_id % 2 = 0 THEN 'A=human' ELSE 'B=human' END AS which_text_is_human,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE 1 + (event_id * 3) % 4 END AS clarity_1, 1 + (user_id + event_id) % 4 AS clarity_2,
  1 + (event_id * 7 + user_id) % 4 AS authenticity_1, 1 + (event_id * 11) % 4 AS authenticity_2,
  1 + (user_id * 3) % 4 AS convincingness_1, 1 + (event_id * 13 + 1) % 4 AS convincingness_2,
  1 + CAST(floor(value) AS BIGINT) % 4 AS excitement_1, 1 + (event_id + 2) % 4 AS excitement_2 FROM events)"""


def ratings(spark, sf):
    e = table(spark, sf, "events")
    i, u = F.col("event_id"), F.col("user_id")
    return e.select(i.alias("id"), F.when(u % 2 == 0, "A=human").otherwise("B=human").alias("which_text_is_human"),
                    F.when(i % 17 == 0, F.lit(None)).otherwise(1 + (i * 3) % 4).alias("clarity_1"),
                    (1 + (u + i) % 4).alias("clarity_2"), (1 + (i * 7 + u) % 4).alias("authenticity_1"),
                    (1 + (i * 11) % 4).alias("authenticity_2"), (1 + (u * 3) % 4).alias("convincingness_1"),
                    (1 + (i * 13 + 1) % 4).alias("convincingness_2"),
                    (1 + F.floor("value").cast("long") % 4).alias("excitement_1"), (1 + (i + 2) % 4).alias("excitement_2"))


def _pref_sql(d):
    m = f"(({d}_1 + {d}_2) / 2.0)"
    a = "CASE WHEN which_text_is_human = 'A=human' THEN 'human' ELSE 'model' END"
    b = "CASE WHEN which_text_is_human = 'A=human' THEN 'model' ELSE 'human' END"
    return (f"CASE WHEN {m} IS NULL OR {m} <> floor({m}) THEN 'neutral' WHEN {m} = 1 THEN {a} || ' strong' "
            f"WHEN {m} = 2 THEN {a} || ' moderate' WHEN {m} = 3 THEN {b} || ' moderate' WHEN {m} = 4 THEN {b} || ' strong' "
            f"ELSE 'neutral' END")


SCORE_SQL = ("CASE @P@ WHEN 'human strong' THEN 2 WHEN 'human moderate' THEN 1 WHEN 'neutral' THEN 0 "
             "WHEN 'model moderate' THEN -1 WHEN 'model strong' THEN -2 END")
PREF_SQL = f"WITH {RATE_SQL},\npr AS (SELECT id, " + ", ".join(
    f"{_pref_sql(d)} AS {d}_preference" for d in SV.DIMENSIONS) + " FROM r0),\nps AS (SELECT id, " + ", ".join(
    f"{SCORE_SQL.replace('@P@', d + '_preference')} AS {d}_score" for d in SV.DIMENSIONS) + " FROM pr),\n" + \
    "lg AS (" + " UNION ALL ".join(f"SELECT id, '{d}' AS dimension, {d}_score AS score FROM ps" for d in SV.DIMENSIONS) + ")"


def _prefs(spark, sf):
    return SV.preferences(ratings(spark, sf))


@plan("preference_label", PREF_SQL + "\nSELECT id, " + ", ".join(f"{d}_preference" for d in SV.DIMENSIONS) + " FROM pr")
def q_preference_label(spark, sf):
    return _prefs(spark, sf).select("id", *[f"{d}_preference" for d in SV.DIMENSIONS])


@plan("preference_score", PREF_SQL + "\nSELECT id, " + ", ".join(f"{d}_score" for d in SV.DIMENSIONS) + " FROM ps")
def q_preference_score(spark, sf):
    return _prefs(spark, sf).select("id", *[f"{d}_score" for d in SV.DIMENSIONS])


@plan("rating_shares", PREF_SQL + """,
pl AS (""" + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d}_preference AS rating FROM pr" for d in SV.DIMENSIONS) + """),
c AS (SELECT dimension, rating, COUNT(*) AS n FROM pl GROUP BY dimension, rating),
t AS (SELECT dimension, SUM(n) AS tot FROM c GROUP BY dimension)
SELECT t.dimension, """ + ", ".join(
    f"round(COALESCE(MAX(CASE WHEN c.rating = '{r}' THEN c.n END), 0) * 100.0 / t.tot, 6) AS \"{r}\"" for r in SV.RATING_ORDER)
    + " FROM t LEFT JOIN c ON t.dimension = c.dimension GROUP BY t.dimension, t.tot")
def q_rating_shares(spark, sf):
    return rounded(SV.rating_shares(_prefs(spark, sf), "id"))


@plan("share_of_partition", PREF_SQL + """
SELECT dimension, score, COUNT(*) AS n, round(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (PARTITION BY dimension), 6) AS pct
FROM lg GROUP BY dimension, score""")
def q_share_of_partition(spark, sf):
    lg = SV.scores_long(_prefs(spark, sf), "id")
    c = lg.groupBy("dimension", "score").agg(F.count(F.lit(1)).alias("n"))
    return rounded(SV.share_of_partition(c, "n", ["dimension"]))


@plan("t_test_1samp", PREF_SQL + """
SELECT dimension, COUNT(*) AS n, round(AVG(score), 6) AS mean, round(stddev_samp(score), 6) AS sd,
 round(AVG(score) / (stddev_samp(score) / sqrt(COUNT(*))), 6) AS t FROM lg WHERE score IS NOT NULL GROUP BY dimension""")
def q_t_test_1samp(spark, sf):
    return rounded(SV.score_summary(SV.scores_long(_prefs(spark, sf), "id")).drop("cohens_d"))


@plan("cohens_d", PREF_SQL + """
SELECT dimension, round(AVG(score) / stddev_samp(score), 6) AS cohens_d FROM lg WHERE score IS NOT NULL GROUP BY dimension""")
def q_cohens_d(spark, sf):
    return rounded(SV.score_summary(SV.scores_long(_prefs(spark, sf), "id")).select("dimension", "cohens_d"))


@plan("wilcoxon_signed_rank", PREF_SQL + """,
nz AS (SELECT dimension, score, abs(score) AS a, rank() OVER (PARTITION BY dimension ORDER BY abs(score)) AS r0,
       COUNT(*) OVER (PARTITION BY dimension, abs(score)) AS c FROM lg WHERE score IS NOT NULL AND score <> 0),
rr AS (SELECT dimension, score, r0 + (c - 1) / 2.0 AS rk FROM nz)
SELECT dimension, round(least(SUM(CASE WHEN score > 0 THEN rk ELSE 0 END), SUM(CASE WHEN score < 0 THEN rk ELSE 0 END)), 6) AS w,
 COUNT(*) AS n_nonzero FROM rr GROUP BY dimension""")
def q_wilcoxon_signed_rank(spark, sf):
    w = SV.signed_rank_summary(SV.scores_long(_prefs(spark, sf), "id"))
    return rounded(w.select("dimension", F.col("w").cast("double"), F.col("n_nonzero").cast("long")))


@plan("preference_tests")
def q_preference_tests(spark, sf):
    return rounded(SV.preference_tests(SV.scores_long(_prefs(spark, sf), "id")))


# ------------------------------------------------------------------ F12
@plan("rebuild_lines", f"""WITH {Q.token_ctes('all')}
SELECT doc_id, sent_id, array_to_string(list(target ORDER BY pos_in_sent), ' ') AS line FROM ann GROUP BY doc_id, sent_id""")
def q_rebuild_lines(spark, sf):
    t = tok.annotate_tokens(tok.tokenize(table(spark, sf, "documents")))
    return tok.rebuild_lines(t)
