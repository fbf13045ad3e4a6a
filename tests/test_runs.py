"""Long n-grams dealt as runs: the rows of n-grams counted one by one."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusdelta.operators import counts as C
from corpusdelta.operators import runs as R


def sentences(odd=True, seed=4):
    rng = random.Random(seed)
    pool = ["the:DET", "of:ADP", "é:NOUN", "responsibility:NOUN", ":PUNCT", "", "a:X", *[f"w{i}:NOUN" for i in range(60)]]
    strange = ["New York:PROPN", None, " ", "a:X a:X"]
    out = []
    for d in range(120):
        for s in range(3):
            words = [rng.choice(pool[:7] if rng.random() < 0.6 else pool) for _ in range(rng.randrange(30))]
            if odd and rng.random() < 0.3:
                for _ in range(3):
                    words[rng.randrange(len(words) + 1):0] = [rng.choice(strange)]
            out.append((("a", "b", None)[d % 3], d, s, words))
    out.append(("a", 1000, 0, ["x:X"] * 500))
    return out


def table(spark, found):
    rows = [(c, d, s, i, w) for c, d, s, words in found for i, w in enumerate(words)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "corpus string, doc_id long, sent_id int, pos_in_sent int, target string")


def slow(found, n):
    counts = Counter()
    for c, _, _, words in found:
        for i in range(len(words) - n + 1):
            if words[i + n - 1] is not None:
                counts[c, " ".join(w for w in words[i:i + n] if w is not None)] += 1
    return counts


@pytest.mark.parametrize("n,held", [(5, 1 << 20), (4, 40), (7, 300)])
def test_rows_equal_ngrams_counted_one_by_one(spark, monkeypatch, n, held):
    monkeypatch.setattr(R, "HELD", held)
    found = sentences()
    t = table(spark, found)
    got = C.ngram_counts(t, n=n).collect()
    want = slow(found, n)
    assert len(got) == len(want) and {(r.corpus, r.target): r.freq for r in got} == want
    freqs, totals = C.ngram_counts_and_totals(t, n=n)
    assert {(r.corpus, r.target): r.freq for r in freqs.collect()} == want
    assert totals == dict(Counter(c for c, _, _, words in found for _ in words))
    every = C.ngram_counts(t, n=n, by=None).agg(F.count("*"), F.sum("freq")).first()
    assert tuple(every) == (len({g for _, g in want}), sum(want.values()))


def test_runs_send_less_than_the_ngrams(spark):
    found = sentences(odd=False)
    sent = R.ngram_runs(table(spark, found), 5, ["corpus"]).agg(F.sum(F.length("_text"))).first()[0]
    assert 0 < sent < 0.75 * sum(len(g) for _, g in slow(found, 5))


def test_parts_are_dealt_evenly_and_equal_ngrams_meet(spark):
    runs = R.ngram_runs(table(spark, sentences()), 5, ["corpus"])
    freqs = R.count_runs(runs, 5, ["corpus"], 8, deal=[])
    assert freqs.groupBy("target").agg(F.count_distinct("_part").alias("n")).where("n > 1").count() == 0
    plan = freqs.groupBy("target", "_part").agg(F.sum("freq"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(_part") == 1 == plan.count("Exchange hashpartitioning(") - plan.count("Exchange hashpartitioning(doc_id")


def test_empty_table(spark):
    t = table(spark, sentences()).limit(0)
    assert C.ngram_counts(t, n=5).count() == 0 and C.ngram_counts_and_totals(t, n=5)[1] == {}


@pytest.mark.parametrize("name", ["keyness_ngrams", "ngram_overlap_flag_5"])
def test_keyness_keeps_runs_and_the_shared_ngrams_only(spark, monkeypatch, name):
    import __spark_entry__ as E
    from corpusdelta import session
    from corpusdelta.plans import lexical2
    from tests.conftest import SF_SMALL
    rows, plain = [], session.cut
    for module in (session, lexical2):
        monkeypatch.setattr(module, "cut", lambda df: rows.append(plain(df)) or rows[-1])
    out = E.queries()[name](spark, SF_SMALL)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "_text" not in plan       # lemmas are asked of what both corpora hold
    assert len(rows) == (1 if name == "keyness_ngrams" else 2)
    assert all(r.where("freq1 = 0 OR freq2 = 0").count() == 0 and "lemma" not in r.columns for r in rows)
