"""Registered corpus-assembly and I/O plans (S, P5-P7, P19, P23, J4-J7, U,
W3-W5, F5-F8, A10, A17, A21) with their SQL twins.

The paper table is derived from ``documents`` joined to ``orders`` by key
(FIXTURES.md #1): year = order year + 25 (so periods land in 2020-2026),
month = order month name, a paper id in one of three id styles, title = first
line, abstract = first sentence.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusdelta.functions import text as T
from corpusdelta.operators import corpus as CO
from corpusdelta.operators import tokens as tok
from corpusdelta.plans import sqlbits as Q
from corpusdelta.plans.common import rounded, table
from corpusdelta.session import ensure_checkpoint_dir, text_partitions
from corpusdelta.sources import readers as R
from corpusdelta.sources import writers as W

PLANS: dict = {}


def plan(name, sql=None):
    def deco(fn):
        PLANS[name] = (fn, sql)
        return fn
    return deco


def scratch(spark) -> str:
    """A fresh folder under the session's checkpoint directory (shared
    storage on a cluster) for write-then-read plans."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpusdelta-io/{uuid.uuid4().hex}"


# ------------------------------------------------------------------ paper table
ACL_ID_SQL = ("CASE WHEN doc_id % 10 = 3 THEN 'W' || lpad(CAST(doc_id % 90 + 10 AS VARCHAR), 2, '0') || '-' "
              "|| lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') "
              "WHEN doc_id % 10 = 7 THEN 'P' || lpad(CAST(doc_id % 90 + 10 AS VARCHAR), 2, '0') || '-' "
              "|| lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') "
              "ELSE year || '.v' || CAST(doc_id % 7 AS VARCHAR) || '-long.' || CAST(doc_id % 50 AS VARCHAR) END")
VOLUME_SQL = ("CASE WHEN regexp_matches(acl_id, '^[0-9]') THEN split_part(acl_id, '.', 1) || '.' || "
              "split_part(acl_id, '.', 2) WHEN starts_with(acl_id, 'W') THEN substr(acl_id, 1, 6) "
              "ELSE substr(acl_id, 1, 5) END")
PAPERS_SQL = f"""p0 AS (SELECT d.doc_id, d.text, d.lang, d.source, CAST(year(o.o_orderdate) + 25 AS VARCHAR) AS year,
       strftime(o.o_orderdate, '%B') AS month FROM documents d JOIN orders o ON o.o_orderkey = d.doc_id),
papers AS (SELECT doc_id, {ACL_ID_SQL} AS acl_id, year, month, lang, source,
       regexp_extract(text, '^([^\\n]*)', 1) AS title, list_extract({Q.sentence_array('text')}, 1) AS abstract,
       text AS full_text FROM p0),
pv AS (SELECT *, {VOLUME_SQL} AS acl_volume FROM papers),
vmap AS (SELECT DISTINCT acl_volume, 'venue' || CAST(length(acl_volume) % 4 AS VARCHAR) AS venue1,
       'venue' || CAST(ascii(right(acl_volume, 1)) % 3 + 4 AS VARCHAR) AS venue2,
       CASE WHEN starts_with(acl_volume, 'W') THEN 'workshop' END AS venue3 FROM pv)"""


def papers(spark, sf):
    d = table(spark, sf, "documents")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    p = d.join(o, d.doc_id == o.o_orderkey).select(
        "doc_id", "text", "lang", "source",
        (F.year("o_orderdate") + 25).cast("string").alias("year"),
        F.date_format("o_orderdate", "MMMM").alias("month"))
    idc = F.col("doc_id")
    yy = F.lpad((idc % 90 + 10).cast("string"), 2, "0")
    num = F.lpad((idc % 10000).cast("string"), 4, "0")
    acl = (F.when(idc % 10 == 3, F.concat(F.lit("W"), yy, F.lit("-"), num))
           .when(idc % 10 == 7, F.concat(F.lit("P"), yy, F.lit("-"), num))
           .otherwise(F.concat("year", F.lit(".v"), (idc % 7).cast("string"), F.lit("-long."),
                               (idc % 50).cast("string"))))
    return p.select("doc_id", acl.alias("acl_id"), "year", "month", "lang", "source",
                    F.regexp_extract("text", r"^([^\n]*)", 1).alias("title"),
                    F.element_at(T.sentence_array("text"), 1).alias("abstract"),
                    F.col("text").alias("full_text"))


def venue_map(pv):
    v = pv.select("acl_volume").distinct()
    return v.select("acl_volume",
                    F.concat(F.lit("venue"), (F.length("acl_volume") % 4).cast("string")).alias("venue1"),
                    F.concat(F.lit("venue"), (F.ascii(F.substring("acl_volume", -1, 1)) % 3 + 4)
                             .cast("string")).alias("venue2"),
                    F.when(F.col("acl_volume").startswith("W"), F.lit("workshop")).alias("venue3"))


def papers_v(spark, sf):
    return papers(spark, sf).withColumn("acl_volume", T.volume_of_id("acl_id"))


def _timed(spark, sf):
    pv = papers_v(spark, sf)
    j = CO.attach_venues(pv, venue_map(pv))
    return j.withColumn("time", CO.period_label())


TIMED_SQL = (f"WITH {PAPERS_SQL},\ntimed AS (SELECT pv.*, venue1, venue2, venue3, CASE WHEN year IN ('2024') THEN 't2' "
             "WHEN year = '2023' AND month IN ('July', 'August', 'September', 'October', 'November', 'December', "
             "'septempber', '20 August') THEN 't2' WHEN year IN ('2020', '2021', '2022') THEN 't1' ELSE 't0' END "
             "AS time FROM pv LEFT JOIN vmap ON pv.acl_volume = vmap.acl_volume)")


@plan("volume_of_id", f"WITH {PAPERS_SQL}\nSELECT doc_id, acl_id, acl_volume FROM pv")
def q_volume_of_id(spark, sf):
    return papers_v(spark, sf).select("doc_id", "acl_id", "acl_volume")


@plan("period_label", TIMED_SQL + "\nSELECT doc_id, acl_id, year, month, time FROM timed")
def q_period_label(spark, sf):
    return _timed(spark, sf).select("doc_id", "acl_id", "year", "month", "time")


@plan("value_counts", TIMED_SQL + "\nSELECT time, COUNT(*) AS count FROM timed GROUP BY time")
def q_value_counts(spark, sf):
    return CO.value_counts(_timed(spark, sf), "time")


@plan("attach_venues", TIMED_SQL + "\nSELECT doc_id, acl_volume, venue1, venue2, venue3 FROM timed")
def q_attach_venues(spark, sf):
    return _timed(spark, sf).select("doc_id", "acl_volume", "venue1", "venue2", "venue3")


SHARED_SQL = TIMED_SQL + """,
lv AS (SELECT DISTINCT time, venue FROM (SELECT time, unnest([venue1, venue2, venue3]) AS venue FROM timed) WHERE venue IS NOT NULL),
shared AS (SELECT venue FROM lv WHERE time = 't1' INTERSECT SELECT venue FROM lv WHERE time = 't2')"""


@plan("shared_venues", SHARED_SQL + "\nSELECT venue FROM shared")
def q_shared_venues(spark, sf):
    return CO.shared_venues(_timed(spark, sf))


def _samples(spark, sf):
    t = _timed(spark, sf)
    s = CO.member_any_of(t.filter(F.col("time") != "t0"), CO.shared_venues(t))
    return CO.drop_frontmatter(s)


@plan("member_any_of", SHARED_SQL + """
SELECT doc_id, acl_id, time FROM timed WHERE time <> 't0' AND (venue1 IN (SELECT venue FROM shared)
  OR venue2 IN (SELECT venue FROM shared) OR venue3 IN (SELECT venue FROM shared))""")
def q_member_any_of(spark, sf):
    t = _timed(spark, sf)
    return CO.member_any_of(t.filter(F.col("time") != "t0"), CO.shared_venues(t)).select("doc_id", "acl_id", "time")


@plan("drop_frontmatter", SHARED_SQL + """
SELECT doc_id, acl_id, time FROM timed WHERE time <> 't0' AND (venue1 IN (SELECT venue FROM shared)
  OR venue2 IN (SELECT venue FROM shared) OR venue3 IN (SELECT venue FROM shared)) AND NOT ends_with(acl_id, '.0')""")
def q_drop_frontmatter(spark, sf):
    return _samples(spark, sf).select("doc_id", "acl_id", "time")


@plan("dedup_first", f"WITH {PAPERS_SQL}\nSELECT acl_id, min(doc_id) AS doc_id, arg_min(year, doc_id) AS year "
      "FROM papers GROUP BY acl_id")
def q_dedup_first(spark, sf):
    p = papers(spark, sf).select("acl_id", "doc_id", "year")
    return CO.dedup_first(p, "acl_id", "doc_id")


@plan("title_abstract", f"WITH {PAPERS_SQL}\nSELECT doc_id, title || '. ' || abstract AS title_abstract FROM papers "
      "WHERE title || '. ' || abstract IS NOT NULL")
def q_title_abstract(spark, sf):
    p = papers(spark, sf)
    return p.select("doc_id", T.title_abstract("title", "abstract").alias("title_abstract")) \
        .filter(F.col("title_abstract").isNotNull())


@plan("sample_k_files", f"WITH {PAPERS_SQL}\nSELECT doc_id, acl_id FROM papers ORDER BY acl_id, doc_id LIMIT 25")
def q_sample_k_files(spark, sf):
    return CO.sample_k(papers(spark, sf).select("doc_id", "acl_id"), 25, ["acl_id", "doc_id"])


# ------------------------------------------------------------------ J5, P19
BIB_SQL = f"""WITH {PAPERS_SQL},
lt AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE title END AS title, year FROM papers),
rt AS (SELECT page_id AS doc_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1),
       '\\s+', ' ', 'g')) AS title, url FROM pages)"""


def _meta(spark, sf):
    p = papers(spark, sf)
    lt = p.select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.lit("")).otherwise(F.col("title")).alias("title"),
                  "year")
    pg = table(spark, sf, "pages")
    rt = pg.select(F.col("page_id").alias("doc_id"),
                   F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1),
                                           r"\s+", " ")).alias("title"), "url")
    return CO.attach_metadata(lt, rt, "doc_id")


@plan("attach_metadata", BIB_SQL + """
SELECT lt.doc_id, lt.title AS title_x, lt.year, rt.title AS title_y, rt.url FROM lt LEFT JOIN rt ON lt.doc_id = rt.doc_id""")
def q_attach_metadata(spark, sf):
    return _meta(spark, sf).select("doc_id", "title_x", "year", "title_y", "url")


@plan("title_fallback", BIB_SQL + """
SELECT lt.doc_id, CASE WHEN lt.title IS NOT NULL AND lt.title <> '' THEN lt.title ELSE rt.title END AS title
FROM lt LEFT JOIN rt ON lt.doc_id = rt.doc_id""")
def q_title_fallback(spark, sf):
    return CO.title_fallback(_meta(spark, sf)).select("doc_id", "title")


# ------------------------------------------------------------------ J6, J7, U1-U7
@plan("split_by_ids", """SELECT doc_id, lang, source FROM documents
WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def q_split_by_ids(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    ids = table(spark, sf, "labels").filter(F.col("quality") == 1)
    return CO.split_by_ids(d, ids, "doc_id")


@plan("missing_ids", """SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def q_missing_ids(spark, sf):
    return CO.missing_ids(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@plan("set_difference", """SELECT DISTINCT page_id AS doc_id FROM pages EXCEPT SELECT doc_id FROM labels""")
def q_set_difference(spark, sf):
    pg = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"))
    return pg.subtract(table(spark, sf, "labels").select("doc_id"))


@plan("empty_ids", """SELECT conv_id, turn FROM conversations WHERE NULLIF(text, '') IS NULL""")
def q_empty_ids(spark, sf):
    c = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(F.col("text") != "", F.col("text")).alias("text"))
    return c.filter(F.col("text").isNull()).select("conv_id", "turn")


@plan("union_all", """SELECT doc_id, text, 'doc' AS kind FROM documents
UNION ALL SELECT item_id, text, 'benchmark' FROM benchmark""")
def q_union_all(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", F.lit("doc").alias("kind"))
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text",
                                             F.lit("benchmark").alias("kind"))
    return CO.union_all(d, b)


@plan("melt", """SELECT doc_id, variable, value FROM (SELECT doc_id, CAST(quality AS BIGINT) AS quality,
  CAST(toxic AS BIGINT) AS toxic FROM labels) UNPIVOT (value FOR variable IN (quality, toxic))""")
def q_melt(spark, sf):
    l = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("long"), F.col("toxic").cast("long"))
    return CO.melt(l, ["doc_id"], ["quality", "toxic"])


@plan("pivot", """SELECT d.lang, COUNT(*) FILTER (WHERE l.quality = 0) AS "0", COUNT(*) FILTER (WHERE l.quality = 1) AS "1"
FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang""")
def q_pivot(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    p = CO.pivot(d, ["lang"], "quality", [0, 1], F.count(F.lit(1)))
    return p.select("lang", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("0", "1")])


@plan("distinct_rows", "SELECT DISTINCT lang, source FROM documents")
def q_distinct_rows(spark, sf):
    return CO.distinct_rows(table(spark, sf, "documents").select("lang", "source"))


# ------------------------------------------------------------------ W3, W4
WIN_SQL = f"""w0 AS (SELECT doc_id, source, {Q.sentence_array('text')} AS s FROM documents),
w1 AS (SELECT doc_id, source, s, unnest(range(0, len(s), 5)) AS st FROM w0 WHERE len(s) > 0),
wins AS (SELECT doc_id, source, CAST(st // 5 AS INTEGER) AS win_no, array_to_string(s[st + 1:st + 5], ' ') AS text FROM w1)"""


@plan("sentence_windows", f"WITH {WIN_SQL}\nSELECT doc_id, source, win_no, text FROM wins")
def q_sentence_windows(spark, sf):
    return tok.sentence_windows(table(spark, sf, "documents"), size=5, keep=("source",))


@plan("dense_ids", f"WITH {WIN_SQL}\nSELECT doc_id, win_no, row_number() OVER (ORDER BY doc_id, win_no) - 1 AS ID FROM wins")
def q_dense_ids(spark, sf):
    w = tok.sentence_windows(table(spark, sf, "documents"), size=5).select("doc_id", "win_no")
    return tok.dense_ids(w, ["doc_id", "win_no"], "ID")


# ------------------------------------------------------------------ A17, A21, F6
@plan("doc_length_stats", """SELECT lang, COUNT(*) AS n_docs, round(AVG(CAST(len(regexp_extract_all(text, '\\S+')) AS DOUBLE)), 6)
AS mean_tokens FROM documents GROUP BY lang""")
def q_doc_length_stats(spark, sf):
    return rounded(CO.doc_length_stats(table(spark, sf, "documents"), by=["lang"]))


@plan("id_from_url", """SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://[^/]+/([^/?#]+)', 1) AS acl_id FROM pages""")
def q_id_from_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.id_from_url("url").alias("acl_id"))


@plan("count_distinct_ids", """SELECT COUNT(*) AS n, COUNT(DISTINCT regexp_extract(url, '^[a-zA-Z]+://[^/]+/([^/?#]+)', 1)) AS n_unique,
COUNT(*) = COUNT(DISTINCT regexp_extract(url, '^[a-zA-Z]+://[^/]+/([^/?#]+)', 1)) AS "unique" FROM pages""")
def q_count_distinct_ids(spark, sf):
    p = table(spark, sf, "pages").select(T.id_from_url("url").alias("acl_id"))
    return CO.count_distinct_ids(p, "acl_id")


# ------------------------------------------------------------------ S1-S17 (write, then read back)
@plan("read_table", "SELECT doc_id, lang, source, n_chars FROM documents")
def q_read_table(spark, sf):
    base = scratch(spark)
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    W.write_table(d, f"{base}/docs.csv", fmt="csv")
    back = R.read_table(spark, f"{base}/docs.csv", inferSchema=False)
    return back.select(F.col("doc_id").cast("long"), "lang", "source", F.col("n_chars").cast("long"))


@plan("read_nonempty_text", "SELECT conv_id, turn FROM conversations WHERE text IS NOT NULL AND text <> ''")
def q_read_nonempty_text(spark, sf):
    return R.nonempty_text(table(spark, sf, "conversations")).select("conv_id", "turn")


LINES_SQL = f"""WITH {Q.token_ctes('all')},
lines AS (SELECT doc_id, sent_id, list(target ORDER BY pos_in_sent) AS lemmas, list(token ORDER BY pos_in_sent) AS tokens
          FROM ann GROUP BY doc_id, sent_id)"""


def _line_files(spark, sf):
    """Lemma lines and token lines of the sentences in the order of the documents.
    Only the texts are put in order; the lines are made where the texts lie, for
    each file anew, so no tokens are exchanged or kept."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    docs = docs.repartitionByRange(text_partitions(docs), "doc_id")
    lemmas = tok.sentence_targets(docs, dealt=True)
    tokens = tok.rebuild_lines(tok.tokenize(docs, dealt=True), value_col="token")
    return [d.sortWithinPartitions("doc_id", "sent_id") for d in (lemmas, tokens)]


def _write_lines(spark, sf, base):
    lemmas, tokens = _line_files(spark, sf)
    W.write_lines(lemmas, f"{base}/lemmas.txt.gz", "targets", compression="gzip")
    W.write_table(tokens.select(F.col("line").alias("value")), f"{base}/tokens.txt.gz", "text", "gzip")


@plan("read_sentence_lines", LINES_SQL + "\nSELECT array_to_string(lemmas, ' ') AS line, CAST(len(lemmas) AS INTEGER) AS n FROM lines")
def q_read_sentence_lines(spark, sf):
    base = scratch(spark)
    _write_lines(spark, sf, base)
    back = R.read_sentence_lines(spark, f"{base}/lemmas.txt.gz")
    return back.select(F.array_join("tokens", " ").alias("line"), F.size("tokens").alias("n"))


@plan("zip_lemma_token_lines", LINES_SQL + """
SELECT 't1' AS time, array_to_string(lemmas, ' ') AS lemmas, array_to_string(tokens, ' ') AS tokens FROM lines""")
def q_zip_lemma_token_lines(spark, sf):
    base = scratch(spark)
    _write_lines(spark, sf, base)
    z = R.zip_lemma_token_lines(spark, f"{base}/lemmas.txt.gz", f"{base}/tokens.txt.gz", "t1")
    return z.select("time", F.array_join("lemmas", " ").alias("lemmas"), F.array_join("tokens", " ").alias("tokens"))


@plan("read_freq_tsv", f"""WITH {Q.token_ctes('lang')},
sarr2 AS (SELECT corpus, doc_id, sent_id, list(target ORDER BY pos_in_sent) AS t FROM ann GROUP BY corpus, doc_id, sent_id),
g AS (SELECT unnest(list_transform(range(1, len(t) - 2 + 2), lambda i: array_to_string(t[i:i + 1], ' '))) AS target
      FROM sarr2 WHERE len(t) >= 2)
SELECT target, COUNT(*) AS freq FROM g GROUP BY target""")
def q_read_freq_tsv(spark, sf):
    from corpusdelta.operators import counts as C
    from corpusdelta.plans.common import annotated, lang_docs
    base = scratch(spark)
    f = C.ngram_counts(annotated(lang_docs(spark, sf)), n=2, by=None)
    W.write_freq_tsv(C.sort_desc(f), f"{base}/all_2grams_freqs.tsv", n=2)
    return R.read_freq_tsv(spark, f"{base}/all_2grams_freqs.tsv", n=2)


CONV_SQL = """cs AS (SELECT conv_id, list(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') ORDER BY turn) AS sentences
        FROM conversations GROUP BY conv_id)"""


@plan("jsonl_sentences_to_text", f"""WITH {CONV_SQL}
SELECT 'conv' || CAST(conv_id AS VARCHAR) AS doc_key, array_to_string(flatten(sentences), ' ') AS text FROM cs
WHERE array_to_string(flatten(sentences), ' ') <> ''""")
def q_jsonl_sentences_to_text(spark, sf):
    base = scratch(spark)
    c = table(spark, sf, "conversations")
    js = (c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", R.split_line("text").alias("w"))))
                                   .alias("_s"))
          .select(F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("doc_key"),
                  F.col("_s.w").alias("sentences")))
    js.write.mode("overwrite").json(f"{base}/model_texts")
    return R.jsonl_sentences_to_text(spark, f"{base}/model_texts")


@plan("jsonl_strip_prefix", """SELECT role AS size, regexp_replace('coref: wb | _ ' || text, '^\\s*coref:\\s*wb\\s*\\|\\s*_\\s*', '') AS text
FROM conversations""")
def q_jsonl_strip_prefix(spark, sf):
    base = scratch(spark)
    c = table(spark, sf, "conversations")
    (c.filter(F.col("role").isin("user", "assistant", "system"))
     .select(F.concat(F.lit("coref: wb | _ "), "text").alias("input"), F.format_string("inputs_%s.jsonl", "role").alias("file"))
     .write.partitionBy("file").json(f"{base}/in"))
    paths = [f"{base}/in/file=inputs_{role}.jsonl" for role in ("user", "assistant", "system", "missing")]
    return R.jsonl_strip_prefix(spark, paths, tag_pattern=r"inputs_([a-z]+)\.jsonl")


@plan("xml_volume_venues", f"WITH {PAPERS_SQL}\nSELECT acl_volume, venue1, venue2, venue3 FROM vmap")
def q_xml_volume_venues(spark, sf):
    vm = venue_map(papers_v(spark, sf))
    coll = F.substring_index("acl_volume", "-", 1)
    vol = F.substring_index("acl_volume", "-", -1)
    vol = F.when(F.col("acl_volume").startswith("W"), F.regexp_replace(vol, "^0", "")).otherwise(vol)
    venues = F.concat_ws("", *[F.when(F.col(c).isNotNull(), F.format_string("<venue>%s</venue>", F.col(c)))
                               for c in ("venue1", "venue2", "venue3")])
    xml = (vm.select(coll.alias("cid"), F.format_string('<volume id="%s">%s</volume>', vol, venues).alias("v"))
           .groupBy("cid").agg(F.array_join(F.array_sort(F.collect_list("v")), "").alias("vs"))
           .select(F.format_string('<collection id="%s">%s</collection>', "cid", "vs").alias("xml")))
    return R.xml_volume_venues(xml).select("acl_volume", "venue1", "venue2", "venue3")


HTML_SQL = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(@X@, '(?s)<!--.*?-->', ' ', 'g'),
 '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g')"""


def _html_sql(x):
    c = HTML_SQL.replace("@X@", x)
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        c = f"replace({c}, '{ent}', '{ch}')"
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


@plan("markup_to_document", f"""SELECT page_id AS id,
{_html_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
{_html_sql("regexp_extract(html, '(?is)<abstract[^>]*>(.*?)</abstract>', 1)")} AS abstract,
{_html_sql("regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1)")} AS full_text FROM pages""")
def q_markup_to_document(spark, sf):
    return R.markup_to_document(table(spark, sf, "pages"), "page_id")


@plan("bibtex_to_table", """SELECT 'inproceedings' AS entry_type, 'p' || CAST(page_id AS VARCHAR) AS key,
 '{Page {no.}} ' || CAST(page_id AS VARCHAR) AS title, 'A {B}, C' AS author, '2024' AS year, url,
 regexp_extract(url, '^[a-zA-Z]+://[^/]+/([^/?#]+)', 1) AS acl_id FROM pages""")
def q_bibtex_to_table(spark, sf):
    base = scratch(spark)
    pg = table(spark, sf, "pages")
    rec = pg.select(F.format_string("@inproceedings{p%d,\n  title={{Page {no.}} %d},\n  author = \"A {B}, C\",\n  year=2024,\n  url=\"%s\"",
                                    "page_id", "page_id", "url").alias("value"))
    rec.write.mode("overwrite").option("lineSep", "\n}\n").text(f"{base}/anthology.bib")
    return R.bibtex_to_table(R.bibtex_records(spark, f"{base}/anthology.bib")).drop("fields")


@plan("union_tag_by_file", """SELECT lang AS name, doc_id, n_chars FROM documents""")
def q_union_tag_by_file(spark, sf):
    base = scratch(spark)
    d = table(spark, sf, "documents").select("doc_id", "n_chars", F.format_string("%s__lftk.parquet", "lang").alias("file"))
    d.write.partitionBy("file").parquet(f"{base}/in")
    out = R.union_tag_by_file(spark, [f"{base}/in"], r"/file=([^/_]+)__lftk\.parquet/", tag="name")
    return out.select("name", "doc_id", "n_chars")


@plan("stem_of_path", """SELECT lang || '_t' || CAST(doc_id % 2 + 1 AS VARCHAR) AS stem, 't' || CAST(doc_id % 2 + 1 AS VARCHAR) AS period,
 doc_id FROM documents""")
def q_stem_of_path(spark, sf):
    base = scratch(spark)
    d = table(spark, sf, "documents").select(
        "doc_id", F.concat("lang", F.lit("_t"), (F.col("doc_id") % 2 + 1).cast("string"), F.lit(".tei.parquet")).alias("file"))
    d.write.partitionBy("file").parquet(f"{base}/in")
    df = spark.read.parquet(f"{base}/in")
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/file=([^/]+\.parquet)/[^/]*$", 1)
    stem = T.stem_of_path(folder)
    return df.select(stem.alias("stem"), T.period_of_stem(stem).alias("period"), "doc_id")


@plan("union_common_columns", """SELECT doc_id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark""")
def q_union_common_columns(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(1).alias("x"), "text")
    return R.union_common_columns([d, b])


@plan("read_run_reports", """SELECT CAST(event_id % 5 AS BIGINT) AS fold, round(AVG(value), 6) AS auc, COUNT(*) AS n
FROM events GROUP BY event_id % 5""")
def q_read_run_reports(spark, sf):
    base = scratch(spark)
    e = table(spark, sf, "events")
    r = e.groupBy((F.col("event_id") % 5).alias("fold")).agg(F.avg("value").alias("auc"),
                                                              F.count(F.lit(1)).alias("n"))
    r.write.mode("overwrite").json(f"{base}/results")
    back = R.read_run_reports(spark, f"{base}/results")
    return rounded(back.select(F.col("fold").cast("long"), "auc", F.col("n").cast("long")))


@plan("write_partitioned", TIMED_SQL + "\nSELECT time, COUNT(*) AS count FROM timed GROUP BY time")
def q_write_partitioned(spark, sf):
    base = scratch(spark)
    t = _timed(spark, sf).select("doc_id", "acl_id", "time")
    W.write_partitioned(t, f"{base}/samples", ["time"])
    W.write_if_absent(t.limit(0), f"{base}/samples")           # exists: skipped
    W.write_append(t.filter(F.col("time") == "t1"), f"{base}/extra")
    W.write_table(t, f"{base}/plain.parquet", compression="gzip")
    return spark.read.parquet(f"{base}/samples").groupBy("time").count()


@plan("write_table", "SELECT lang, 2 * COUNT(*) AS count FROM documents GROUP BY lang")
def q_write_table(spark, sf):
    base = scratch(spark)
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    W.write_table(d, f"{base}/docs.parquet", compression="gzip")
    W.write_table(d, f"{base}/docs_tsv", fmt="tsv")
    back = spark.read.options(sep="\t", header=False).schema("doc_id long, lang string, n_chars long").csv(f"{base}/docs_tsv")
    return spark.read.parquet(f"{base}/docs.parquet").unionByName(back).groupBy("lang").count()


@plan("write_if_absent", "SELECT doc_id, lang FROM documents")
def q_write_if_absent(spark, sf):
    base = scratch(spark)
    d = table(spark, sf, "documents").select("doc_id", "lang")
    W.write_if_absent(d, f"{base}/out")
    W.write_if_absent(d.limit(0), f"{base}/out")          # exists: skipped, rows kept
    try:
        W.write_or_fail(d, f"{base}/out")
        raise AssertionError("write_or_fail did not fail on an existing output")
    except Exception as e:  # noqa: BLE001
        if isinstance(e, AssertionError):
            raise
    return spark.read.parquet(f"{base}/out")


@plan("write_append", "SELECT doc_id, lang FROM documents")
def q_write_append(spark, sf):
    base = scratch(spark)
    d = table(spark, sf, "documents").select("doc_id", "lang")
    W.write_append(d.filter(F.col("lang") == "en"), f"{base}/targets")
    W.write_append(d.filter(F.col("lang") != "en"), f"{base}/targets")
    return spark.read.parquet(f"{base}/targets")


XML_BODY_SQL = """SELECT page_id AS id, 'Page ' || CAST(page_id AS VARCHAR) AS title, 'Short view' AS abstract, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1),
  '[<>&]', '', 'g') || ' ' || regexp_replace(url, '[<>&]', '', 'g'), '\\s+', ' ', 'g')) AS full_text FROM pages"""


@plan("xml_body_text", XML_BODY_SQL)
def q_xml_body_text(spark, sf):
    """S9, XML path: well-formed TEI built from each page: a header with title
    and abstract, title and url as body divs, and typed divs in body and back
    matter that must be skipped."""
    pg = table(spark, sf, "pages")
    title = F.regexp_replace(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), "[<>&]", "")
    url = F.regexp_replace("url", "[<>&]", "")
    xml = F.format_string("<TEI xmlns=\"http://www.tei-c.org/ns/1.0\"><teiHeader><title>Page %d</title><abstract><div><p>Short</p> <p>view</p></div></abstract>"
                          "</teiHeader><text><body><div>%s</div><div type=\"ack\">skip me</div><div><p>%s</p></div></body>"
                          "<back><div><p>no body</p></div><div type=\"references\">nor this</div></back></text></TEI>", "page_id", title, url)
    return R.tei_to_document(pg.select("page_id", xml.alias("xml")), "page_id")


@plan("write_or_fail", "SELECT doc_id, source FROM documents")
def q_write_or_fail(spark, sf):
    """S15, fail mode: the first write succeeds, a second write to the same
    path raises; the rows of the first write are returned."""
    base = scratch(spark)
    d = table(spark, sf, "documents").select("doc_id", "source")
    W.write_or_fail(d, f"{base}/out")
    failed = False
    try:
        W.write_or_fail(d, f"{base}/out")
    except Exception:  # noqa: BLE001
        failed = True
    if not failed:
        raise AssertionError("write_or_fail did not fail on an existing output")
    return spark.read.parquet(f"{base}/out")
