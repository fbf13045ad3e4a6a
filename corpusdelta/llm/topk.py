"""Exact top-k inner products by block pruning (operator 10).

Vectors become integers, ``floor(scale * x)``. Blocks are ranges of ``BLOCK``
ids; a block's forward index is its ids and its matrix, and for each term
(component) it has the greatest and the least value. The sum over the terms of
a query's weight times the fitting extreme bounds every score in the block.

Round one orders the blocks of each portion of the index by that bound, per
query, and scores the best through its forward index, which gives a k-th score
that the query can't fall below. Round two scores every other block whose bound
reaches that score; the rest can't hold a result. Both rounds treat groups of
``QUERIES`` queries against blocks, as equi-joins on portion and block numbers
with bounded rows on both sides; no task needs all vectors or all queries, and
only scores that can still count leave a task.

Defined cases: rows with a null id, a null vector, or a null or non-finite
component take no part; a repeated id counts once, with its least vector in
array order; a missing component of a shorter vector is zero; ties go to the
smaller id; fewer candidates than k are all returned; no queries or an empty
table give an empty result; further columns are ignored. Scores beyond 64 bits
raise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusdelta.session import cut

#: Ids of a block, queries of a group, blocks of a portion of the index.
BLOCK, QUERIES, PORTION = 512, 256, 1024


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): one row for each id that takes part."""
    x = F.col(f"`{vector_col}`")
    ok = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return (vectors.where(F.col(f"`{id_col}`").isNotNull() & x.isNotNull() & ok)
            .select(F.col(f"`{id_col}`").cast("bigint").alias("id"),
                    F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))
            .groupBy("id").agg(F.min("v").alias("v")))


def _matrix(flat: list, rows: int) -> np.ndarray:
    return np.array(flat, np.int64).reshape(rows, -1)


def _products(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact integer products (by floats where they are exact)."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(m).max(initial=0)) * q.shape[1]
    if most >= 1 << 63:
        raise OverflowError("scores beyond 64 bits")
    if most < 1 << 53:
        return (q.astype(np.float64) @ m.T.astype(np.float64)).astype(np.int64)
    return q @ m.T


def _packed(rows: DataFrame, key, name: str, dim: int) -> DataFrame:
    """(name, ids, flat): the vectors of each key in the order of their ids."""
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("bigint"), F.lit(dim) - F.size("v")))
    some = (rows.select(key.alias(name), F.struct("id", padded.alias("v")).alias("r"))
            .groupBy(name).agg(F.sort_array(F.collect_list("r")).alias("r")))  # BLOCK or QUERIES rows at most
    return some.select(name, F.col("r.id").alias("ids"), F.flatten("r.v").alias("flat"))


def _wanted(groups: DataFrame, portions: DataFrame, n: int, seeds: bool) -> DataFrame:
    """(block, portion-wise) -> rows (block, group, places): the queries of a
    group that score a block, in round one (seeds) or two."""
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                q = _matrix(r["flat"], len(r["ids"]))
                high, low = (_matrix(r[c], len(r["blocks"])) for c in ("high", "low"))
                # summed term maxima
                bound = _products(np.maximum(q, 0), high) + _products(np.minimum(q, 0), low)
                best = np.zeros(bound.shape, bool)
                best[np.arange(len(q)), bound.argmax(axis=1)] = True
                if not seeds:
                    kth = np.array([np.iinfo(np.int64).min if x is None else x for x in r["kth"]], np.int64)
                    best = ~best & (bound >= kth[:, None])
                at = [(k, np.flatnonzero(best[:, k]).tolist()) for k in np.flatnonzero(best.any(axis=0)).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["blocks"][k] for k, _ in at], pa.int64()), pa.array([r["grp"]] * len(at), pa.int64()),
                     pa.array([p for _, p in at], pa.list_(pa.int32()))], names=["block", "grp", "places"])

    each = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("portion"))
    return each.join(portions, "portion").mapInArrow(run, "block long, grp long, places array<int>")


def _scored(wanted: DataFrame, groups: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): of each block the k best that can count."""
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                at = np.array(r["places"])
                qids, ids = np.array(r["q_ids"], np.int64)[at], np.array(r["ids"], np.int64)
                kth = np.array([np.iinfo(np.int64).min if x is None else x for x in r["kth"]], np.int64)[at]
                s = _products(_matrix(r["q_flat"], len(r["q_ids"]))[at], _matrix(r["flat"], len(ids)))
                valid = qids[:, None] != ids[None]
                # ids ascend, so a stable sort leaves ties to the smaller id
                top = np.argsort(np.where(valid, -s, np.iinfo(np.int64).max), axis=1, kind="stable")[:, :k]
                keep = np.take_along_axis(valid & (s >= kth[:, None]), top, axis=1)
                rows = np.broadcast_to(np.arange(len(at))[:, None], top.shape)[keep]
                cols = top[keep]
                yield pa.RecordBatch.from_arrays([pa.array(qids[rows]), pa.array(ids[cols]), pa.array(s[rows, cols])],
                                                 names=["query_id", "vec_id", "score"])

    q = groups.select("grp", F.col("ids").alias("q_ids"), F.col("flat").alias("q_flat"), "kth")
    return (wanted.join(q, "grp").join(index.select("block", "ids", "flat"), "block")
            .select("places", "q_ids", "q_flat", "kth", "ids", "flat")
            .mapInArrow(run, "query_id long, vec_id long, score long"))


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """Rows whose id is divisible by ``every`` query all others: ``query_id``,
    ``rank`` (from 1), ``vec_id``, ``score``."""
    rows = cut(integers(vectors, id_col, vector_col, scale))
    dim = max(rows.agg(F.max(F.size("v"))).first()[0] or 0, 1)
    index = cut(_packed(rows, F.floor(F.col("id") / BLOCK), "block", dim))

    def extremes(batches):
        for b in batches:
            ms = [_matrix(flat, len(ids)) for ids, flat in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([m.max(axis=0).tolist() for m in ms], pa.list_(pa.int64())),
                 pa.array([m.min(axis=0).tolist() for m in ms], pa.list_(pa.int64()))], names=["block", "high", "low"])

    n = (index.count() + PORTION - 1) // PORTION
    if n == 0:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    portions = cut(index.mapInArrow(extremes, "block long, high array<bigint>, low array<bigint>")
                   .groupBy(F.pmod(F.xxhash64("block"), F.lit(n)).cast("int").alias("portion"))
                   .agg(F.sort_array(F.collect_list(F.struct("block", "high", "low"))).alias("r"))  # about PORTION rows
                   .select("portion", F.col("r.block").alias("blocks"), F.flatten("r.high").alias("high"),
                           F.flatten("r.low").alias("low")))
    queries = rows.where(F.col("id") % every == 0)
    group = F.floor(F.col("id") / (every * QUERIES))
    bare = cut(_packed(queries, group, "grp", dim)).withColumn("kth", F.transform("ids", lambda _: F.lit(None).cast("bigint")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = cut(_scored(_wanted(bare, portions, n, True), bare, index, k))
    kth = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    known = (bare.select("grp", F.posexplode("ids").alias("at", "query_id")).join(kth, "query_id", "left")
             .groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("at", "kth"))).alias("r"))
             .select("grp", F.col("r.kth").alias("kth")))
    groups = cut(bare.drop("kth").join(known, "grp"))
    rest = _scored(_wanted(groups, portions, n, False), groups, index, k)
    return (first.union(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def sql(k: int = 10, every: int = 100, scale: int = 1024) -> str:
    """DuckDB twin for tables of distinct ids."""
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.e, d.e)::BIGINT AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % {every} = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
