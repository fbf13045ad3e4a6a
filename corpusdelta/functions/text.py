"""Text column expressions: sentences, tokens, rule-based POS and lemma, and
the small string functions of the inventory (F1-F16).

All of these are built-in Spark expressions, so they stay inside whole-stage
code generation (or, for the array lambdas, inside the JVM).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusdelta.functions import fixed


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- F9 / F10
def sentence_array(text) -> Column:
    """text -> array of sentences (newline after ``[.!?]`` + blanks,
    split on newlines, blank pieces dropped). NULL text gives NULL."""
    marked = F.regexp_replace(_c(text), fixed.SENTENCE_BREAK, "$1\n")
    return F.filter(F.split(marked, fixed.SENTENCE_SPLIT), lambda s: s.rlike(r"\S"))


def token_array(sentence) -> Column:
    """sentence -> lowercase tokens (letter runs, digit runs, single
    other characters)."""
    return F.regexp_extract_all(F.lower(_c(sentence)), F.lit(fixed.TOKEN_PATTERN), 0)


# ---------------------------------------------------------------- F11
def _ends(t: Column, suffixes) -> Column:
    """Any of the suffixes (byte comparisons; cheaper than a regex scan)."""
    e = None
    for s in suffixes:
        c = t.endswith(s)
        e = c if e is None else e | c
    return e


def upos(token) -> Column:
    """Coarse universal POS by deterministic rules; first match wins.
    (Conditions are short-circuit ANDs: a token that begins with a-z, as most do,
    meets no regex, and one look-up tells if any closed class holds it.)"""
    t = _c(token)
    other = (t < "a") | (t >= "{")                   # does not begin with a-z
    long_enough = F.length(t) >= fixed.SUFFIX_MIN_LEN
    tags = None
    for tag, words in fixed.CLOSED_CLASS.items():
        tags = (F if tags is None else tags).when(t.isin(*words), tag)
    return (F.when(other & (t >= "0") & (t < ":") & t.rlike("^[0-9]+$"), "NUM")
            .when(other & t.isin(*list(fixed.SYMBOL_CHARS)), "SYM")
            .when(other & ~t.rlike(r"[\p{L}0-9]"), "PUNCT")
            .when(t.isin(*fixed.STOPWORDS), tags)
            .when(long_enough & _ends(t, fixed.ADV_SUFFIXES), "ADV")
            .when(long_enough & _ends(t, fixed.VERB_SUFFIXES), "VERB")
            .when(long_enough & _ends(t, fixed.ADJ_SUFFIXES), "ADJ")
            .otherwise("NOUN"))


def lemma(token, pos) -> Column:
    """Rule lemma: NOUN (len >= 4) loses one final ``s`` unless ``ss``;
    VERB loses ``ing``/``ed`` when at least 3 characters remain."""
    t, p = _c(token), _c(pos)
    n = F.length(t)
    return (F.when((p == "NOUN") & (n >= 4) & t.endswith("s") & ~t.endswith("ss"), t.substr(F.lit(1), n - 1))
            .when((p == "VERB") & t.endswith("ing") & (n - 3 >= 3), t.substr(F.lit(1), n - 3))
            .when((p == "VERB") & t.endswith("ed") & (n - 2 >= 3), t.substr(F.lit(1), n - 2))
            .otherwise(t))


def tagged(lem, pos) -> Column:
    """``lemma:UPOS`` target string."""
    return F.concat(_c(lem), F.lit(":"), _c(pos))


def target_of(token) -> Column:
    """Token -> ``lemma:UPOS`` in one expression (usable inside lambdas)."""
    p = upos(token)
    return tagged(lemma(token, p), p)


# ---------------------------------------------------------------- F1 - F4
def lower_tagged(word) -> Column:
    """lowercase everything but the last ``:``-part (the tag); words
    without a colon are lowercased whole."""
    w = _c(word)
    return F.when(w.contains(":"),
                  F.concat(F.lower(F.regexp_extract(w, "^(.*):([^:]*)$", 1)), F.lit(":"),
                           F.regexp_extract(w, "^(.*):([^:]*)$", 2))).otherwise(F.lower(w))


def lower_all(word) -> Column:
    """ignore-tag mode."""
    return F.lower(_c(word))


def split_lemma(word) -> Column:
    """F3 lemma part: text before the last colon, '' when there is none."""
    w = _c(word)
    return w.substr(F.lit(1), F.length(w) - F.length(split_pos(w)) - 1)


def split_pos(word) -> Column:
    """F3 POS part: text after the last colon, the whole word without one."""
    return F.substring_index(_c(word), ":", -1)


def ngram_lemma(target) -> Column:
    """space-joined lemma parts of a space-joined n-gram target."""
    return F.array_join(F.transform(F.split(_c(target), " "), split_lemma), " ")


def ngram_pos(target) -> Column:
    """space-joined POS parts of a space-joined n-gram target."""
    return F.array_join(F.transform(F.split(_c(target), " "), split_pos), " ")


def parts_of_ngram(parts, n: int, part) -> Column:
    """F4 from a column of the split target: ``part`` (``split_lemma`` or
    ``split_pos``) of each, space-joined. The usual ``n`` parts are expressions of
    their own, which are compiled, as a lambda is not; other numbers take the lambda."""
    p = _c(parts)
    return F.when(F.size(p) == n, F.concat_ws(" ", *[part(F.get(p, F.lit(i))) for i in range(n)])).otherwise(
        F.array_join(F.transform(p, part), " "))


def ngrams(arr, n: int, sep: str = " ") -> Column:
    """A2 core: contiguous n-grams of an array inside one row; arrays shorter
    than n give an empty array (``sequence(1, 0)`` would count down)."""
    a = _c(arr)
    if n == 1:
        return a
    return F.when(F.size(a) >= n,
                  F.transform(F.sequence(F.lit(1), F.size(a) - n + 1),
                              lambda i: F.array_join(F.slice(a, i, n), sep))
                  ).otherwise(F.array().cast("array<string>"))


# ---------------------------------------------------------------- F5 - F8
def volume_of_id(paper_id) -> Column:
    """``a.b.n`` -> ``a.b`` (new style ids start with a digit);
    ``W..`` ids -> first 6 characters; other old ids -> first 5."""
    i = _c(paper_id)
    return (F.when(i.rlike("^[0-9]"), F.substring_index(i, ".", 2))
            .when(i.startswith("W"), i.substr(1, 6))
            .otherwise(i.substr(1, 5)))


def id_from_url(url) -> Column:
    """first path segment after the host."""
    return F.regexp_extract(_c(url), r"^[a-zA-Z]+://[^/]+/([^/?#]+)", 1)


def stem_of_path(path) -> Column:
    """file stem with ``.tei`` removed."""
    base = F.regexp_extract(_c(path), r"([^/]+)$", 1)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    return F.regexp_replace(stem, r"\.tei$", "")


def period_of_stem(stem) -> Column:
    """the period is the last ``_``-separated part of the stem."""
    return F.substring_index(_c(stem), "_", -1)


def title_abstract(title, abstract) -> Column:
    """F8: ``title + '. ' + abstract``; NULL if either is NULL."""
    return F.concat(_c(title), F.lit(". "), _c(abstract))


# ---------------------------------------------------------------- F13
def odds_ratio(coef) -> Column:
    return F.exp(_c(coef))


def odds_pct_change(coef) -> Column:
    return (F.exp(_c(coef)) - 1) * 100


# ---------------------------------------------------------------- F14
def surface_form(lemmas, tokens, target_lemma) -> Column:
    """first token aligned with ``target_lemma`` (``:SPACE`` skipped);
    NULL when the arrays differ in length or nothing matches."""
    z = F.arrays_zip(_c(lemmas).alias("l"), _c(tokens).alias("t"))
    hits = F.filter(z, lambda x: (x["l"] == _c(target_lemma)) & ~x["l"].endswith(":SPACE"))
    return F.when(F.size(_c(lemmas)) == F.size(_c(tokens)), F.element_at(hits, 1)["t"])


# ---------------------------------------------------------------- F15 / F16
def preference_label(rating_a, rating_b, human_is_a) -> Column:
    """mean of two 1-4 ratings -> who is preferred and how strongly.
    1 = strong for text A, 2 = moderate A, 3 = moderate B, 4 = strong B;
    non-integer means and missing ratings are neutral."""
    m = (_c(rating_a) + _c(rating_b)) / 2
    a_side = F.when(human_is_a, F.lit("human")).otherwise(F.lit("model"))
    b_side = F.when(human_is_a, F.lit("model")).otherwise(F.lit("human"))
    return (F.when(m.isNull() | (m != F.floor(m)), F.lit("neutral"))
            .when(m == 1, F.concat(a_side, F.lit(" strong")))
            .when(m == 2, F.concat(a_side, F.lit(" moderate")))
            .when(m == 3, F.concat(b_side, F.lit(" moderate")))
            .when(m == 4, F.concat(b_side, F.lit(" strong")))
            .otherwise(F.lit("neutral")))


# fixed values: preference label -> score
PREFERENCE_SCORE = {"human strong": 2, "human moderate": 1, "neutral": 0,
                    "model moderate": -1, "model strong": -2}


def preference_score(label) -> Column:
    """F16: label -> -2..2."""
    expr = None
    for k, v in PREFERENCE_SCORE.items():
        expr = (F.when(_c(label) == k, F.lit(v)) if expr is None
                else expr.when(_c(label) == k, F.lit(v)))
    return expr
