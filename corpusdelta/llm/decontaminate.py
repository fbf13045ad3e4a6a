"""Benchmark decontamination by spaced seeds (operator 2). DataFrame functions
only.

Words are the lower-cased runs of letters and digits. A document is
contaminated by a benchmark item if ``width`` words in a row of both differ in
at most ``max_subs`` places (an item of fewer words is compared whole, with
proportionally fewer substitutions). ``max_subs + 1`` fixed masks each keep
every ``(max_subs + 1)``-th position of such a window and ignore the others, so
at least one mask sees no substitution. The masked windows of documents and of
the benchmark are hashed and joined; around each hit all ``width`` positions
are compared.

Scale: a document's windows are made by generators inside one task and probe
the benchmark's seeds, which are broadcast only if they measure at most
``broadcast_bytes``; a larger benchmark is joined by shuffling windows. Equal
windows of several items are one seed row. Nothing is collected.

Defined cases: null texts have no words; items or documents without words
match nothing; repeated documents of one id count as one document; a null id
is a document like others; empty tables give empty results; further columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusdelta.session import cut

BROADCAST_BYTES = 64 << 20


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words of a text."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _masks(width: int, subs: int) -> list[list[int]]:
    """Positions that each mask keeps."""
    return [list(range(first, width, subs + 1)) for first in range(min(subs + 1, width))]


def _seeds(items: DataFrame, width: int, subs: int) -> DataFrame:
    """(mask, key, window, items): the masked hashes of the distinct windows."""
    windows = (items.select("item", F.explode(F.expr(
        f"transform(sequence(0, size(h) - {width}), i -> slice(h, i + 1, {width}))")).alias("window"))
        .groupBy("window").agg(F.collect_set("item").alias("items")))
    keys = F.array(*[F.xxhash64(*[F.get("window", F.lit(k)) for k in kept]) for kept in _masks(width, subs)])
    return windows.select("window", "items", F.posexplode(keys).alias("mask", "key"))


def _hits(docs: DataFrame, seeds: DataFrame, width: int, subs: int, broadcast: bool) -> DataFrame:
    """(doc, at, items) of the windows that are within ``subs`` substitutions."""
    masks = _masks(width, subs)
    at = docs.where(F.size("h") >= width).select(
        "doc", "h", F.explode(F.sequence(F.lit(0), F.size("h") - width)).alias("at"))
    if not broadcast:  # shuffle the window alone, not the document
        at = at.select("doc", "at", F.slice("h", F.col("at") + 1, width).alias("h"), F.lit(0).alias("base"))
    else:
        at = at.withColumn("base", F.col("at"))
    keys = F.array(*[F.xxhash64(*[F.get("h", F.col("base") + k) for k in kept]) for kept in masks])
    probes = at.select("doc", "h", "at", "base", F.posexplode(keys).alias("mask", "key"))
    found = probes.join(F.broadcast(seeds) if broadcast else seeds, ["mask", "key"])
    same = [F.get("h", F.col("base") + k) == F.get("window", F.lit(k)) for k in range(width)]
    differ = sum((F.when(s, 0).otherwise(1) for s in same), F.lit(0))
    first = F.lit(len(masks))  # the first mask that sees no substitution reports the window
    for m in reversed(range(len(masks))):
        whole = same[masks[m][0]]
        for k in masks[m][1:]:
            whole = whole & same[k]
        first = F.when(whole, m).otherwise(first)
    return found.where((differ <= subs) & (F.col("mask") == first)).select("doc", "at", "items")


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 12, max_subs: int = 2,
                 id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per contaminated document and item: the two id columns,
    ``n_windows`` (places of the document where a window matches),
    ``first_word`` and ``last_word`` (positions of the words that the windows
    span, from 0)."""
    items = cut(benchmark.select(F.col(f"`{item_col}`").alias("item"), word_hashes(F.col(f"`{item_text_col}`")).alias("h"))
                .where(F.size("h") > 0))
    d = docs.select(F.col(f"`{id_col}`").alias("doc"), word_hashes(F.col(f"`{text_col}`")).alias("h"))
    widths = sorted(r[0] for r in items.select(F.least(F.size("h"), F.lit(width))).distinct().collect())  # at most width values
    out = docs.sparkSession.createDataFrame([], f"doc {docs.schema[id_col].dataType.simpleString()}, "
                                                f"item {benchmark.schema[item_col].dataType.simpleString()}, at int, width int")
    for w in widths:
        subs = max_subs * w // width
        own = items.where(F.size("h") == w) if w < width else items.where(F.size("h") >= w)
        seeds = cut(_seeds(own, w, subs))
        size = seeds.agg(F.sum(F.lit(64) + 8 * F.size("window") + 8 * F.size("items"))).first()[0] or 0
        hits = _hits(d, seeds, w, subs, size <= broadcast_bytes)
        out = out.union(hits.select("doc", F.explode("items").alias("item"), "at", F.lit(w).alias("width")))
    return (out.groupBy("doc", "item", "at").agg(F.max("width").alias("width"))
            .groupBy("doc", "item").agg(F.count("*").alias("n_windows"), F.min("at").alias("first_word"),
                                        F.max(F.col("at") + F.col("width") - 1).alias("last_word"))
            .select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "n_windows", "first_word", "last_word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose id is not contaminated."""
    bad = contaminated(docs, benchmark, id_col=id_col, **options).select(F.col(id_col).alias("_bad")).distinct()
    return docs.join(bad, F.col(f"`{id_col}`").eqNullSafe(F.col("_bad")), "left_anti")


def sql(width: int = 12, max_subs: int = 2) -> str:
    """DuckDB twin of ``contaminated`` for items of at least ``width`` words."""
    step = max_subs + 1
    words = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, {words} AS w FROM benchmark),
dw AS (SELECT doc_id, p, w[p + 1 : p + {width}] AS win FROM (SELECT doc_id, w, unnest(range(0, len(w) - {width - 1})) AS p FROM d)),
bw AS (SELECT DISTINCT item_id, win FROM (SELECT item_id, w[p + 1 : p + {width}] AS win
       FROM (SELECT item_id, w, unnest(range(0, len(w) - {width - 1})) AS p FROM b))),
m AS (SELECT unnest(range(0, {step})) AS c),
dk AS (SELECT doc_id, p, win, c, list_transform(range(c, {width}, {step}), lambda k: win[k + 1]) AS key FROM dw, m),
bk AS (SELECT item_id, win, c, list_transform(range(c, {width}, {step}), lambda k: win[k + 1]) AS key FROM bw, m),
hit AS (SELECT DISTINCT doc_id, item_id, p FROM dk JOIN bk USING (c, key)
        WHERE list_sum(list_transform(range(0, {width}), lambda k: CASE WHEN dk.win[k + 1] = bk.win[k + 1] THEN 0 ELSE 1 END)) <= {max_subs})
SELECT doc_id, item_id, count(*) AS n_windows, min(p)::INT AS first_word, (max(p) + {width - 1})::INT AS last_word
FROM hit GROUP BY doc_id, item_id"""
