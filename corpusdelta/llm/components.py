"""Connected components of an edge table, as DataFrame jobs.

Alternating large-star and small-star steps: each node's larger (then smaller)
neighbours are linked to the least node around it, until the edges stop
changing. It takes a logarithmic number of rounds; no edge leaves the cluster.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusdelta.session import cut

#: Edges that one task holds at a time while it thins them out.
EDGES_HELD = 500_000


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges with the least node that it is connected to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        if np.array_equal(root, before):
            return nodes, nodes[root]


def thin(edges: DataFrame) -> DataFrame:
    """Replace the edges (a, b) of each task by a forest that connects the
    same nodes, so that dense groups leave a task as stars."""
    def run(batches):
        held, size = [], 0

        def flush():
            table = pa.Table.from_batches(held)
            nodes, roots = _roots(table["a"].to_numpy(), table["b"].to_numpy())
            own = nodes != roots
            return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(roots[own])], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= EDGES_HELD:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """edges (a, b) of non-null long nodes -> (node, root): every node that has
    an edge, with the least node of its component. Self-loops and repeated
    edges are ignored; no edges give no rows."""
    now = cut(thin(edges.where("a <> b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(max_rounds):
        # (a, b) has b < a; a node without a smaller neighbour is its own least
        least = now.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        large = now.join(least, F.col("b") == F.col("u"), "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(least.select("a", "m")).distinct())
        now = cut(small)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
