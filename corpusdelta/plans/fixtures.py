"""Reference-shaped inputs derived from the driver tables by rule
(FIXTURES.md): annotation columns a parser would supply, word-norm
lexicons, hedge phrases. Each rule has a SQL twin built from the same
lists, so the DuckDB oracle sees the same inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusdelta.functions import fixed
from corpusdelta.operators import tokens as tok
from corpusdelta.plans import sqlbits
from corpusdelta.plans.common import table

# fixed values: rules standing in for a parser's morphology (SQL shared by
# Spark SQL and DuckDB)
MORPH_RULES = {
    "VerbForm": "CASE WHEN upos = 'VERB' THEN CASE WHEN right(token, 2) = 'ed' OR right(token, 3) = 'ing' "
                "THEN 'Part' WHEN length(token) % 2 = 0 THEN 'Inf' ELSE 'Fin' END END",
    "Mood": "CASE WHEN upos = 'VERB' AND NOT (right(token, 2) = 'ed' OR right(token, 3) = 'ing') "
            "AND length(token) % 2 = 1 THEN 'Ind' END",
    "Number": "CASE WHEN upos IN ('NOUN', 'DET', 'PROPN') THEN CASE WHEN right(token, 1) = 's' THEN 'Plur' "
              "ELSE 'Sing' END WHEN upos = 'NUM' THEN CASE WHEN token = '1' THEN 'Sing' ELSE 'Plur' END "
              "WHEN upos = 'VERB' AND right(token, 1) = 's' THEN 'Sing' END",
    "PronType": "CASE WHEN upos = 'PRON' THEN CASE length(token) % 5 WHEN 0 THEN 'Art' WHEN 1 THEN 'Dem' "
                "WHEN 2 THEN 'Ind' WHEN 3 THEN 'Rel' ELSE 'Prs' END END",
    "Reflex": "CASE WHEN upos = 'PRON' AND token IN ('sich', 'se') THEN 'Yes' END",
    "Gender": "CASE WHEN upos = 'PRON' THEN CASE length(token) % 3 WHEN 0 THEN 'Fem' WHEN 1 THEN 'Masc' "
              "ELSE 'Neut' END END",
    "Degree": "CASE WHEN upos IN ('ADJ', 'ADV') THEN CASE WHEN right(token, 2) = 'er' THEN 'Cmp' "
              "WHEN right(token, 3) = 'est' THEN 'Sup' ELSE 'Pos' END END",
    "Definite": "CASE WHEN upos = 'DET' THEN CASE WHEN token IN ('the', 'le', 'la', 'les', 'der', 'die', "
                "'das', 'den', 'dem', 'el', 'los', 'las') THEN 'Def' ELSE 'Ind' END END",
    "PunctType": "CASE WHEN upos = 'PUNCT' THEN CASE WHEN token IN ('(', ')', '[', ']', '{', '}') THEN 'Brck' "
                 "WHEN token = ',' THEN 'Comm' WHEN token = '-' THEN 'Dash' WHEN token IN ('.', '!', '?') "
                 "THEN 'Peri' WHEN token = chr(34) OR token = chr(39) THEN 'Quot' END END",
    "ConjType": "CASE WHEN upos = 'CCONJ' AND token IN ('and', 'und', 'et', 'y') THEN 'Cmp' END",
}
OTHER_ENTITIES = [c for c in fixed.ENTITY_CLASSES if c not in fixed.ENTITY_PATTERNS]


def _lit_array(words):
    return F.array(*[F.lit(w) for w in words])


def supplied_morph() -> "F.Column":
    """``morph`` (map) by rule, from ``token`` and ``upos``."""
    return F.create_map(*[x for k, v in MORPH_RULES.items() for x in (F.lit(k), F.expr(v))])


def supplied_annotations(tokens: DataFrame) -> DataFrame:
    """Add ``morph`` (map), ``dep``, ``head`` and ``ent`` by rule."""
    morph = supplied_morph()
    labels = _lit_array(fixed.DEPENDENCY_LABELS)
    idx = (F.length("token") + F.col("pos_in_sent")) % len(fixed.DEPENDENCY_LABELS) + 1
    dep = (F.when(F.col("pos_in_sent") == 0, "ROOT").when(F.col("upos") == "PUNCT", "punct")
           .when(F.col("upos") == "DET", "det").when(F.col("upos") == "ADP", "prep")
           .otherwise(F.element_at(labels, idx.cast("int"))))
    head = F.when(F.col("pos_in_sent") == 0, F.lit(0)).otherwise(F.floor(F.col("pos_in_sent") / 2)).cast("int")
    ents = _lit_array(OTHER_ENTITIES)
    eidx = (F.length("token") + F.col("sent_id")) % len(OTHER_ENTITIES) + 1
    ent = F.when((F.col("upos") == "NOUN") & (F.length("token") % 7 == 0),
                 F.element_at(ents, eidx.cast("int")))
    return tokens.select("*", morph.alias("morph"), dep.alias("dep"), head.alias("head"),
                         ent.alias("ent"))


def dep_sql() -> str:
    labels = ", ".join(f"'{l}'" for l in fixed.DEPENDENCY_LABELS)
    return (f"CASE WHEN pos_in_sent = 0 THEN 'ROOT' WHEN upos = 'PUNCT' THEN 'punct' WHEN upos = 'DET' "
            f"THEN 'det' WHEN upos = 'ADP' THEN 'prep' ELSE list_extract([{labels}], "
            f"CAST((length(token) + pos_in_sent) % {len(fixed.DEPENDENCY_LABELS)} + 1 AS INTEGER)) END")


def ent_sql() -> str:
    ents = ", ".join(f"'{e}'" for e in OTHER_ENTITIES)
    return (f"CASE WHEN upos = 'NOUN' AND length(token) % 7 = 0 THEN list_extract([{ents}], "
            f"CAST((length(token) + sent_id) % {len(OTHER_ENTITIES)} + 1 AS INTEGER)) END")


# fixed values: word-norm lexicon layout -- norm name, index k; score rule
# ((length(word) * (k + 3) + k) % 10) / 2.0 on the words of benchmark.text
NORMS = ([f"{s}_sensorimotor" for s in fixed.SENSORIMOTOR]
         + ["aoa", "concreteness", "prevalence", "arousal", "valence"]
         + [f"intensity_{e}" for e in fixed.EMOTIONS])
HIGH = 3.5
LOW = 1.5
SPECS_SENSORIMOTOR = [(f"n_high_{s}_sensorimotor", f"{s}_sensorimotor", "above", HIGH)
                      for s in fixed.SENSORIMOTOR]
SPECS_NORMS = [("avg_aoa", "aoa", "avg", None), ("avg_concreteness", "concreteness", "avg", None),
               ("n_high_concreteness", "concreteness", "above", HIGH),
               ("avg_prevalence", "prevalence", "avg", None),
               ("n_high_arousal", "arousal", "above", HIGH)]
SPECS_SENTIMENT = ([("n_negative_sentiment", "valence", "below", LOW),
                    ("n_positive_sentiment", "valence", "above", HIGH)]
                   + [(f"n_high_intensity_{e}", f"intensity_{e}", "above", HIGH)
                      for e in fixed.EMOTIONS])


def benchmark_words(spark, sf) -> DataFrame:
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return (tok.tokenize(b).filter(F.col("token").rlike(r"\p{L}"))
            .select(F.col("token").alias("word")).distinct())


def lexicon(spark, sf) -> DataFrame:
    """Long lexicon ``(word, norm, score)`` from benchmark words."""
    w = benchmark_words(spark, sf)
    norms = F.array(*[F.struct(F.lit(n).alias("norm"), F.lit(k).alias("k")) for k, n in enumerate(NORMS)])
    x = w.select("word", F.explode(norms).alias("n"))
    return x.select("word", F.col("n.norm").alias("norm"),
                    (((F.length("word") * (F.col("n.k") + 3) + F.col("n.k")) % 10) / 2.0).alias("score"))


def lexicon_sql() -> str:
    vals = ", ".join(f"('{n}', {k})" for k, n in enumerate(NORMS))
    return (f"bw AS (SELECT DISTINCT token AS word FROM (SELECT unnest(regexp_extract_all(lower(s), "
            f"'{fixed.TOKEN_PATTERN}')) AS token FROM (SELECT unnest({_bsent()}) AS s FROM benchmark)) "
            f"WHERE regexp_matches(token, '\\p{{L}}')),\n"
            f"nl AS (SELECT * FROM (VALUES {vals}) v(norm, k)),\n"
            f"lex AS (SELECT word, norm, ((length(word) * (k + 3) + k) % 10) / 2.0 AS score FROM bw, nl)")


def _bsent() -> str:
    return sqlbits.sentence_array("text")


def hedge_phrases(spark, sf) -> DataFrame:
    """Hedge list: benchmark bigrams whose first word starts with ``th``
    and benchmark words of nine or more letters."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    st = tok.sentence_tokens(b)
    from corpusdelta.functions import text as T
    bi = st.select(F.explode(T.ngrams("tokens", 2, " ")).alias("phrase")).filter(F.col("phrase").startswith("th"))
    uni = st.select(F.explode("tokens").alias("phrase")).filter(
        F.col("phrase").rlike(r"^\p{L}+$") & (F.length("phrase") >= 9))
    return bi.unionByName(uni).distinct()


def hedge_sql() -> str:
    return (f"bs AS (SELECT {sqlbits.token_array('s')} AS tk "
            f"FROM (SELECT unnest({_bsent()}) AS s FROM benchmark)),\n"
            "hp AS (SELECT DISTINCT phrase FROM (SELECT unnest(list_transform(range(1, len(tk)), "
            "lambda i: tk[i] || ' ' || tk[i + 1])) AS phrase FROM bs WHERE len(tk) >= 2) "
            "WHERE starts_with(phrase, 'th') UNION SELECT DISTINCT phrase FROM (SELECT unnest(tk) AS phrase "
            "FROM bs) WHERE regexp_matches(phrase, '^\\p{L}+$') AND length(phrase) >= 9)")
