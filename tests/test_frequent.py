"""n-grams of a minimum frequency: the rows of the full count, from less."""

import random

import pytest
from pyspark.sql import functions as F

from corpusdelta.operators import counts as C
from corpusdelta.operators import frequent as FQ


def tokens(spark, seed=2):
    rng = random.Random(seed)
    rows, phrase = [], ["in", "the", "end", "of", "all", "things"]
    for d in range(300):
        words = []
        for _ in range(5):
            words += [f"w{rng.randrange(2000)}" for _ in range(rng.randrange(6))] + phrase[:rng.randrange(7)]
        for s in range(0, len(words), 17):
            rows += [(("a", "b", None)[d % 3], d, s // 17, i, w, f"{w}:X") for i, w in enumerate(words[s:s + 17])]
    return spark.createDataFrame(rows, "corpus string, doc_id long, sent_id int, pos_in_sent int, lemma string, target string")


@pytest.mark.parametrize("n,min_freq,bits", [(1, 5, 1 << 16), (2, 3, 1 << 16), (5, 3, 1 << 16), (5, 3, 64), (3, 1, 1 << 12)])
def test_rows_equal_the_full_count(spark, n, min_freq, bits):
    t = tokens(spark)
    want = C.ngram_counts(t, n=n).where(F.col("freq") >= min_freq)
    got = FQ.frequent_ngrams(t, n, min_freq, bits=bits)
    assert got.columns == want.columns
    if n == 1:
        want = C.unigram_counts(t).where(F.col("freq") >= min_freq)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(got) == key(want) and got.count() > 5


def test_rare_ngrams_are_not_shuffled_as_text(spark):
    t = tokens(spark)
    found = FQ.candidate_ngrams(FQ.sentence_hashes(t, "corpus"), 5, 3, bits=1 << 20)
    shipped = found.agg(F.count("*"), F.sum("c")).first()
    every = C.ngram_counts(t, n=5).agg(F.count("*"), F.sum("freq")).first()
    frequent = C.ngram_counts(t, n=5).where("freq >= 3").agg(F.sum("freq")).first()[0]
    assert frequent <= shipped[1] < 0.2 * every[1] and shipped[0] < 0.2 * every[0]


def test_empty_table(spark):
    assert FQ.frequent_ngrams(tokens(spark).limit(0), 5, 2).count() == 0


def test_sentences_are_kept_compressed_without_hashes(spark, monkeypatch):
    from corpusdelta import session
    kept, plain = [], session.written
    monkeypatch.setattr(FQ, "written", lambda df: kept.append(plain(df)) or kept[-1])
    t = tokens(spark)
    got = FQ.frequent_ngrams(t, 5, 3)
    want = C.ngram_counts(t, n=5).where("freq >= 3")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert [k.columns for k in kept] == [["corpus", "targets"]] and all(".zstd." in f for f in kept[0].inputFiles())
