"""SQL fragments for the DuckDB twins, generated from the same fixed values
as the Spark expressions (corpusdelta.functions.fixed)."""

from __future__ import annotations

from corpusdelta.functions import fixed

NL = "chr(10)"


def _inlist(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def sentence_array(text: str = "text") -> str:
    return (f"list_filter(regexp_split_to_array(regexp_replace({text}, '([.!?])\\s+', "
            f"'\\1' || {NL}, 'g'), '\\n+'), lambda x: regexp_matches(x, '\\S'))")


def token_array(sentence: str = "sentence") -> str:
    return f"regexp_extract_all(lower({sentence}), '{fixed.TOKEN_PATTERN}')"


def upos(t: str = "token") -> str:
    parts = [f"WHEN regexp_matches({t}, '^[0-9]+$') THEN 'NUM'",
             f"WHEN {t} IN ({_inlist(list(fixed.SYMBOL_CHARS))}) THEN 'SYM'",
             f"WHEN NOT regexp_matches({t}, '[\\p{{L}}0-9]') THEN 'PUNCT'"]
    for tag, words in fixed.CLOSED_CLASS.items():
        parts.append(f"WHEN {t} IN ({_inlist(words)}) THEN '{tag}'")
    n = fixed.SUFFIX_MIN_LEN
    parts += [f"WHEN length({t}) >= {n} AND regexp_matches({t}, '{fixed.ADV_SUFFIX}') THEN 'ADV'",
              f"WHEN length({t}) >= {n} AND regexp_matches({t}, '{fixed.VERB_SUFFIX}') THEN 'VERB'",
              f"WHEN length({t}) >= {n} AND regexp_matches({t}, '{fixed.ADJ_SUFFIX}') THEN 'ADJ'"]
    return "CASE " + " ".join(parts) + " ELSE 'NOUN' END"


def lemma(t: str = "token", p: str = "upos") -> str:
    return (f"CASE WHEN {p} = 'NOUN' AND length({t}) >= 4 AND regexp_matches({t}, '[^s]s$') "
            f"THEN substr({t}, 1, length({t}) - 1) "
            f"WHEN {p} = 'VERB' AND regexp_matches({t}, 'ing$') AND length({t}) - 3 >= 3 "
            f"THEN substr({t}, 1, length({t}) - 3) "
            f"WHEN {p} = 'VERB' AND regexp_matches({t}, 'ed$') AND length({t}) - 2 >= 3 "
            f"THEN substr({t}, 1, length({t}) - 2) ELSE {t} END")


def split_lemma(x: str) -> str:
    return f"regexp_extract({x}, '^(.*):[^:]*$', 1)"


def split_pos(x: str) -> str:
    return f"regexp_extract({x}, '([^:]*)$', 1)"


def ngram_lemma(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: {split_lemma('w')}), ' ')"


def ngram_pos(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: {split_pos('w')}), ' ')"


def docs_cte(src: str) -> str:
    """CTE ``docs(doc_id, text, corpus)`` for a corpus definition."""
    if src == "quality":
        return ("docs AS (SELECT d.doc_id, d.text, 'q' || CAST(l.quality AS VARCHAR) AS corpus "
                "FROM documents d JOIN labels l ON d.doc_id = l.doc_id)")
    if src == "source":
        return "docs AS (SELECT doc_id, text, source AS corpus FROM documents)"
    if src == "lang":
        return "docs AS (SELECT doc_id, text, lang AS corpus FROM documents)"
    if src == "all":
        return "docs AS (SELECT doc_id, text, 'all' AS corpus FROM documents)"
    raise ValueError(src)


def token_ctes(src: str) -> str:
    """CTEs docs -> sents -> toks -> ann(corpus, doc_id, sent_id,
    pos_in_sent, token, upos, lemma, target)."""
    return ",\n".join([
        docs_cte(src),
        f"sarr AS (SELECT doc_id, corpus, {sentence_array('text')} AS arr FROM docs)",
        "sents AS (SELECT doc_id, corpus, CAST(unnest(range(0, len(arr))) AS INTEGER) AS sent_id, "
        "unnest(arr) AS sentence FROM sarr)",
        f"tarr AS (SELECT doc_id, corpus, sent_id, {token_array('sentence')} AS tk FROM sents)",
        "toks AS (SELECT doc_id, corpus, sent_id, CAST(unnest(range(0, len(tk))) AS INTEGER) "
        "AS pos_in_sent, unnest(tk) AS token FROM tarr)",
        f"up AS (SELECT *, {upos('token')} AS upos FROM toks)",
        f"lm AS (SELECT *, {lemma('token', 'upos')} AS lemma FROM up)",
        "ann AS (SELECT *, lemma || ':' || upos AS target FROM lm)",
    ])


def measures(f1="freq1", f2="freq2", t1="t1", t2="t2") -> str:
    """X1-X4 select list (rounded to 6 digits) given counts and totals."""
    fn1 = f"(CAST({f1} AS DOUBLE) / {t1} * 1e6)"
    fn2 = f"(CAST({f2} AS DOUBLE) / {t2} * 1e6)"
    r2 = f"(CASE WHEN {fn1} = 0 THEN NULL ELSE {fn2} / {fn1} END)"
    r1 = f"(CASE WHEN {fn2} = 0 THEN NULL ELSE {fn1} / {fn2} END)"
    a, b = f"CAST({f2} AS DOUBLE)", f"CAST({f1} AS DOUBLE)"
    c, d = f"CAST({t2} AS DOUBLE)", f"CAST({t1} AS DOUBLE)"
    e1, e2 = f"({c} * ({a} + {b}) / ({c} + {d}))", f"({d} * ({a} + {b}) / ({c} + {d}))"
    ll = (f"2.0 * ((CASE WHEN {a} > 0 THEN {a} * ln({a} / {e1}) ELSE 0.0 END) + "
          f"(CASE WHEN {b} > 0 THEN {b} * ln({b} / {e2}) ELSE 0.0 END))")

    def lr(r):
        return f"(CASE WHEN {r} = 0 THEN CAST('-inf' AS DOUBLE) ELSE log2({r}) END)"
    return ", ".join([f"round({fn1}, 6) AS freq_norm1", f"round({fn2}, 6) AS freq_norm2",
                      f"round({r2}, 6) AS ratio_t2", f"round({r1}, 6) AS ratio_t1",
                      f"round({lr(r1)}, 6) AS logratio_t1", f"round({lr(r2)}, 6) AS logratio_t2",
                      f"round({ll}, 6) AS ll"])


def measures_raw(f1="freq1", f2="freq2", t1="t1", t2="t2") -> str:
    """Unrounded measures (for later filters and rankings)."""
    return measures(f1, f2, t1, t2).replace("round(", "(").replace(", 6) AS", ") AS")


def content_filter(pos_col="pos", lemma_col="lemma") -> str:
    return (f"{pos_col} IN ({_inlist(fixed.CONTENT_POS)}) AND regexp_matches({lemma_col}, '^\\p{{L}}+$') "
            f"AND length({lemma_col}) >= {fixed.MIN_CHARS}")
