"""Corpus assembly: periods, venues, id splits, set and reshape operations
(P5-P7, P19, P23, J4-J7, U1-U7, W5, A10, A17, A21).

All of these are plain DataFrame operations; the planner picks the join
strategy of lookup tables (volume -> venue maps, id lists) from their size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: period rules (years and months are strings)
T1_YEARS = ["2020", "2021", "2022"]
T2_LATE_YEAR = "2023"
T2_MONTHS = ["July", "August", "September", "October", "November", "December",
             "septempber", "20 August"]
T2_YEARS = ["2024"]


def period_label(year="year", month="month", t1_years=T1_YEARS, late_year=T2_LATE_YEAR,
                 late_months=T2_MONTHS, t2_years=T2_YEARS) -> Column:
    """P5: ``t1`` for t1 years; ``t2`` for listed months of the late year or
    any t2 year; ``t0`` otherwise. Boundaries are parameters."""
    y = F.col(year) if isinstance(year, str) else year
    m = F.col(month) if isinstance(month, str) else month
    return (F.when(y.isin(*t2_years), "t2")
            .when((y == late_year) & m.isin(*late_months), "t2")
            .when(y.isin(*t1_years), "t1").otherwise("t0"))


def member_any_of(df: DataFrame, values: DataFrame,
                  cols: Sequence[str] = ("venue1", "venue2", "venue3")) -> DataFrame:
    """Rows where any of ``cols`` is in the first column of ``values``.

    The distinct values are joined once per column and never multiply a row;
    the planner picks each join's strategy from the size of ``values``, so
    nothing is collected however many there are."""
    known = values.select(F.col(values.columns[0]).alias("_v")).where("_v IS NOT NULL").distinct()
    out, found = df, F.lit(False)
    for i, c in enumerate(cols):
        out = out.join(known.withColumnRenamed("_v", f"_v{i}"), F.col(c) == F.col(f"_v{i}"), "left")
        found = found | F.col(f"_v{i}").isNotNull()
    return out.where(found).select(*df.columns)


def drop_frontmatter(df: DataFrame, id_col: str = "acl_id") -> DataFrame:
    """Drop ids ending in ``.0``."""
    return df.filter(~F.col(id_col).endswith(".0"))


def title_fallback(df: DataFrame, left: str = "title_x", right: str = "title_y",
                   out: str = "title") -> DataFrame:
    """Empty (or NULL, see the ledger) title <- bibliography title."""
    l = F.col(left)
    return df.withColumn(out, F.when(l.isNotNull() & (l != ""), l).otherwise(F.col(right)))


def sample_k(df: DataFrame, k: int, order: Sequence[str]) -> DataFrame:
    """The first k rows in a declared order (top-k, not a scan cap)."""
    return df.orderBy(*order).limit(k)


def attach_venues(papers: DataFrame, venues: DataFrame, key: str = "acl_volume") -> DataFrame:
    """Left join volume -> venues (the map is size-checked for broadcast)."""
    return papers.join(venues, key, "left")


def attach_metadata(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on ``key``; clashing column names get ``_x``/``_y``."""
    clash = [c for c in left.columns if c in right.columns and c != key]
    l = left.select(*[F.col(c).alias(f"{c}_x") if c in clash else F.col(c) for c in left.columns])
    r = right.select(*[F.col(c).alias(f"{c}_y") if c in clash else F.col(c) for c in right.columns])
    return l.join(r, key, "left")


def split_by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose id is in ``ids`` (semi-join)."""
    return df.join(ids.select(key), key, "left_semi")


def missing_ids(catalogue: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    """Ids in the catalogue and not in the corpus, distinct, sorted."""
    return (catalogue.select(key).join(corpus.select(key), key, "left_anti")
            .distinct().orderBy(key))


def empty_ids(df: DataFrame, key: str, text: str) -> DataFrame:
    """U4: ids whose text is NULL (an empty string is not missing here)."""
    return df.filter(F.col(text).isNull()).select(key)


def union_all(*dfs: DataFrame) -> DataFrame:
    """Row concatenation by column name."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def shared_venues(df: DataFrame, period: str = "time", a: str = "t1", b: str = "t2",
                  cols: Sequence[str] = ("venue1", "venue2", "venue3"),
                  forbidden: str | None = "ws") -> DataFrame:
    """Venues present in both periods (NULL venues dropped). Raises if
    the catch-all venue ``forbidden`` is shared."""
    long = (df.select(period, F.explode(F.array(*cols)).alias("venue"))
            .filter(F.col("venue").isNotNull()).distinct())
    va = long.filter(F.col(period) == a).select("venue")
    vb = long.filter(F.col(period) == b).select("venue")
    shared = va.intersect(vb)
    if forbidden is not None and shared.filter(F.col("venue") == forbidden).limit(1).count():
        raise ValueError(f"catch-all venue {forbidden!r} is shared")
    return shared


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str],
         var: str = "variable", val: str = "value") -> DataFrame:
    """Wide -> long."""
    return df.unpivot(list(ids), list(values), var, val)


def pivot(df: DataFrame, index: Sequence[str], col: str, values: Sequence, agg: Column) -> DataFrame:
    """Long -> wide with explicit column values (no discovery pass)."""
    return df.groupBy(*index).pivot(col, list(values)).agg(agg)


def distinct_rows(df: DataFrame) -> DataFrame:
    """U7."""
    return df.distinct()


def dedup_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """Keep the first row per id under an explicit order (``min_by`` on a
    struct; partial aggregation, no window over the whole table)."""
    others = [c for c in df.columns if c != key]
    s = F.struct(*[F.col(c) for c in others])
    return (df.groupBy(key).agg(F.min_by(s, F.col(order)).alias("_r"))
            .select(key, *[F.col(f"_r.{c}").alias(c) for c in others]))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """A10."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def doc_length_stats(df: DataFrame, text: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """Documents and mean whitespace tokens per set."""
    n = F.size(F.regexp_extract_all(F.col(text), F.lit(r"\S+"), 0))
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(n.cast("double")).alias("mean_tokens"))


def count_distinct_ids(df: DataFrame, key: str) -> DataFrame:
    """Uniqueness check ``count(distinct id) == count``."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("n_unique")) \
        .withColumn("unique", F.col("n") == F.col("n_unique"))
