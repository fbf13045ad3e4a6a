"""SimHash links against a comparison of all pairs."""

import itertools
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from corpusdelta.llm import simhash
from corpusdelta.llm.components import connected_components


def slow_fingerprint(text, width):
    import re
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def slow_components(fps, max_bits):
    parent = {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(sorted(fps), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= max_bits:
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return {i: find(i) for i in fps}


def _texts(n, seed=3):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(20, 80))) for _ in range(n // 3)]
    out = [None, "", " \t\n", "Two Words", "two\x0bwords", "x"]
    while len(out) < n:
        t = rng.choice(base).split()
        if rng.random() < 0.7:
            t[rng.randrange(len(t))] = rng.choice(words)
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("max_bits,light", [(4, 24), (4, 2), (3, 24), (6, 3)])
def test_components_equal_all_pairs(spark, monkeypatch, max_bits, light):
    monkeypatch.setattr(simhash, "LIGHT", light)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    texts = _texts(240)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {r.doc_id: r for r in simhash.near_duplicates(df, max_bits=max_bits).collect()}
    fps = {i: slow_fingerprint(t, 4) for i, t in enumerate(texts)}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == slow_components(fps, max_bits)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (9, "A B C D E"), (None, "zzz yyy")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [
        ("5", "5"), ("5", "5"), ("9", "5"), ("None", "5"), ("None", "None")]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(50)}}
    assert connected_components(df.where(F.lit(False))).count() == 0


def test_variants_are_not_broadcast_though_spark_sizes_them_low(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LIGHT", 2)
    rng = random.Random(8)
    near = [rng.getrandbits(20) for _ in range(8)]
    fps = {*near, *(f ^ 1 << 40 for f in near), *(f ^ 3 for f in near)}
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = simhash.links(nodes)
    assert found.count() > 8
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "ShuffledHashJoin" in plan and "BroadcastExchange" not in plan
