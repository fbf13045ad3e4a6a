"""URL filter: host rules and gradient-boosted trees (operator 6).

A rule names a host and a path prefix and fits the host, its subdomains and the
paths that begin so; the longest fitting rule decides. Other URLs are judged by
gradient-boosted trees (MLlib) on lexical features: length, host and path
length, depth, host labels, share of digits, entropy of the characters, hyphens,
parameters, a fragment, a file ending, and for the host's last and two last
labels how often they occur and how often a rule blocks them.

The trees learn from the URLs that a rule labels, each distinct URL once, at
most ``FIT_ROWS`` of them expected (those whose hash falls below the share that
gives so many). Suffix statistics count all distinct URLs.

Defined cases: a null URL or one without ``://`` has an empty host and path;
these are judged by the trees like others; without rules that label both ways
the trees are replaced by the one label seen, else by ``allow``; repeated rows
and null page ids are kept row by row; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusdelta.session import cut

FIT_ROWS, TREES, DEPTH, SEED = 50_000, 20, 4, 3
#: Weight of the mean label in the statistics of a suffix.
SMOOTH = 5.0
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "hyphens", "parameters",
            "fragment", "ending", "last_seen", "last_blocked", "two_seen", "two_blocked")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return tuple(F.when(at > 0, x).otherwise("") for x in (F.translate(host, _UPPER, _LOWER), path))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. ``rules``
    holds (verdict, host and path prefix)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, prefix = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + prefix)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, word).otherwise(verdict)
    return rule, verdict


def _lexical(df: DataFrame) -> DataFrame:
    u, h, p = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    n = F.length(u).cast("double")

    def count(pattern, of=u):
        return (F.length(of) - F.length(F.regexp_replace(of, pattern, ""))).cast("double")

    entropy = F.aggregate(
        F.array_distinct(F.split(u, "")), F.lit(0.0),
        lambda acc, c: acc - F.when(c == "", 0.0).otherwise(
            ((n - F.length(F.replace(u, c, F.lit("")))) / n) * F.log2((n - F.length(F.replace(u, c, F.lit("")))) / n)))
    labels = F.split(h, r"\.")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return df.withColumns({
        "last": F.element_at(labels, -1),
        "two": F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2)),
        "length": n, "host_length": F.length(h).cast("double"), "path_length": F.length(p).cast("double"),
        "depth": count("/", p), "labels": F.size(labels).cast("double"),
        "digit_ratio": F.when(n > 0, count("[0-9]") / n).otherwise(0.0), "entropy": F.when(n > 0, entropy).otherwise(0.0),
        "hyphens": count("[-_]"), "parameters": F.when(query == "", 0.0).otherwise(count("&", query) + 1),
        "fragment": F.instr(u, "#").cast("boolean").cast("double"), "ending": p.rlike(r"\.[A-Za-z0-9]+$").cast("double")})


def _suffixes(distinct: DataFrame, mean: float) -> dict[str, DataFrame]:
    """Counts and smoothed share of blocked of each suffix."""
    out = {}
    for name in ("last", "two"):
        out[name] = distinct.groupBy(name).agg(
            F.log1p(F.count("*").cast("double")).alias(f"{name}_seen"),
            ((F.sum(F.coalesce("label", F.lit(0.0))) + SMOOTH * mean) / (F.count("label") + SMOOTH)).alias(f"{name}_blocked"))
    return out


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: the id column, ``host``, ``path``, ``rule``,
    ``verdict`` and ``block_score`` (null where a rule decides)."""
    base = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    base = base.withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "by_rule": verdict})
    label = F.when(F.col("by_rule") == "block", 1.0).when(F.col("by_rule") == "allow", 0.0)
    distinct = cut(_lexical(base.select("url", "host", "path", label.alias("label")).dropDuplicates(["url"])))
    n, ones = distinct.agg(F.count("label"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < ones < n:
        score = F.lit(1.0 if n and ones == n else 0.0)
        judged = base.withColumn("score", score)
    else:
        suffixes = {k: cut(v) for k, v in _suffixes(distinct, ones / n).items()}

        def featured(df):
            for name, stats in suffixes.items():
                df = df.join(stats, name, "left")
            return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df)

        share = min(1.0, FIT_ROWS / n)
        chosen = distinct.where(F.col("label").isNotNull() & (F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < int(share * (1 << 30))))
        train = cut(featured(chosen).select("features", "label"))
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED).fit(train)
        judged = model.transform(featured(_lexical(base))).withColumn("score", vector_to_array("probability")[1])
    score = F.when(F.col("by_rule").isNull(), F.col("score"))
    return judged.select(
        F.col("id").alias(id_col), "host", "path", "rule",
        F.coalesce("by_rule", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"),
        score.alias("block_score"))
