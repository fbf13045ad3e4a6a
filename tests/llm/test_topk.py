"""Top-k against all products."""

import math
import random

import pytest

from corpusdelta.llm import topk


def slow(rows, k, every):
    vs = {}
    for i, e in rows:
        if i is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        v = [math.floor(1024 * x) for x in e]
        vs[i] = min(vs.get(i, v), v)
    out = []
    for q in vs:
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(vs[q], vs[d])), d) for d in vs if d != q)[:k]
            out += [(q, r + 1, d, -x) for r, (x, d) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("block,portion,queries", [(512, 1024, 256), (4, 3, 2)])
def test_equals_all_products(spark, monkeypatch, block, portion, queries):
    for n, v in (("BLOCK", block), ("PORTION", portion), ("QUERIES", queries)):
        monkeypatch.setattr(topk, n, v)
    rng = random.Random(6)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, rng.uniform(-1, 1)]) for _ in range(6)]) for i in range(-40, 80)]
    rows += [(i + 1000, [0.5] * 6) for i in range(30)]  # ties
    rows += [(2000, None), (2010, [1.0, None]), (2020, [float("nan")]), (2030, [float("inf")]), (None, [9.0] * 6), (50, rows[5][1]),
             (2040, [1.0, 2.0]), (2050, [])]
    df = spark.createDataFrame([(i, e, "x", 1) for i, e in rows], "vec_id long, embedding array<float>, label string, rank int")
    f32 = [(r.vec_id, r.embedding) for r in df.collect()]
    got = sorted(map(tuple, topk.top_k(df, k=7, every=10).collect()))
    assert got == slow(f32, 7, 10)


def test_few_rows_and_empty_table(spark):
    df = spark.createDataFrame([(0, [1.0]), (7, [2.0])], "vec_id long, embedding array<double>")
    assert list(map(tuple, topk.top_k(df).collect())) == [(0, 1, 7, 2048 * 1024)]
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.where("vec_id = 7")).count() == 0
