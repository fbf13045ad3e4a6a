"""Spaced-seed hits against a comparison of every window with every window."""

import random
import re

import pytest

from corpusdelta.llm import decontaminate as dc


def slow(docs, items, width, max_subs):
    def words(t):
        return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]

    out = {}
    for d, t in docs:
        w = words(t)
        for i, s in items:
            v = words(s)
            n = min(width, len(v))
            if not n:
                continue
            subs = max_subs * n // width
            at = [p for p in range(len(w) - n + 1)
                  if any(sum(a != b for a, b in zip(w[p:p + n], v[q:q + n])) <= subs for q in range(len(v) - n + 1))]
            if at:
                out[d, i] = (len(at), at[0], at[-1] + n - 1)
    return out


def _data(seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 7, 12, 15, 30])))) for i in range(20)]
    items += [(20, None), (21, ""), (22, items[4][1]), (23, "same " * 14)]
    docs = [(0, None), (1, ""), (2, "w1 w2"), (3, "same " * 40)]
    for d in range(4, 60):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            s = rng.choice(items)[1] or ""
            s = [rng.choice(vocab) if rng.random() < 0.1 else x.upper() for x in s.split()]
            at = rng.randint(0, len(w))
            w[at:at] = s
        docs.append((d, ", ".join(w)))
    return docs, items


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_equals_all_windows(spark, limit):
    docs, items = _data()
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, item_id int, h string")
    b = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc string")
    got = {(r.doc_id, r.item_id): (r.n_windows, r.first_word, r.last_word)
           for r in dc.contaminated(d, b, broadcast_bytes=limit).collect()}
    want = slow(docs, items, 12, 2)
    assert got == want and len(want) > 20
    kept = {r.doc_id for r in dc.decontaminate(d, b).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in want}
    assert dc.decontaminate(d, b).columns == d.columns


def test_null_ids_repeated_rows_and_empty_tables(spark):
    text = " ".join(f"k{i}" for i in range(20))
    d = spark.createDataFrame([(None, text), (1, text), (1, text), (2, "clean")], "doc_id long, text string")
    b = spark.createDataFrame([(9, text)], "item_id long, text string")
    got = sorted((str(r.doc_id), r.n_windows) for r in dc.contaminated(d, b).collect())
    assert got == [("1", 9), ("None", 9)]
    assert [r.doc_id for r in dc.decontaminate(d, b).collect()] == [2]
    assert dc.contaminated(d, b.limit(0)).count() == 0
    assert dc.contaminated(d.limit(0), b).count() == 0
    assert dc.decontaminate(d, b.limit(0)).count() == 4


def test_main_path_is_native(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join("abcdefghijklmnop"))], "item_id long, text string")
    plan = dc.contaminated(d, b)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "BroadcastHashJoin" in plan
