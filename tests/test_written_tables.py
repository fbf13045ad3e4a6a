"""The token table and the postings: written once, read without the corpus."""

import glob
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusdelta.operators import counts as C
from corpusdelta.operators import features as FT
from corpusdelta.operators import postings as PO
from corpusdelta.operators import senses as SN
from corpusdelta.operators import token_table as TT
from corpusdelta.plans.common import annotated, lang_docs
from tests.conftest import SF_SMALL


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_two_reports_read_one_token_table_without_an_exchange_by_document(spark):
    tokens = annotated(lang_docs(spark, SF_SMALL))
    name = TT.write_token_table(tokens)
    kept = TT.read_token_table(spark, name)
    assert sorted(kept.columns) == sorted(tokens.columns) and kept.count() == tokens.count()
    features = FT.doc_features(kept, families=["surface", "diversity"])
    assert "Exchange" not in plan_of(features)
    grams = C.ngram_counts(kept, n=3)
    assert re.findall(r"Exchange hashpartitioning\((\w+)#", plan_of(grams)) == ["corpus"]
    key = lambda df: sorted(map(str, df.collect()))
    assert key(features) == key(FT.doc_features(tokens, families=["surface", "diversity"]))
    assert key(grams) == key(C.ngram_counts(tokens, n=3))


def test_documents_dealt_before_give_the_same_table_without_exchanging_tokens(spark):
    from corpusdelta.session import target_partitions
    docs = lang_docs(spark, SF_SMALL)
    tokens = annotated(docs.repartition(target_partitions(spark), "doc_id"))
    assert plan_of(tokens).count("Exchange") == 1           # the texts; spread adds none
    name = TT.write_token_table(tokens, dealt=True)
    kept = TT.read_token_table(spark, name)
    files = kept.select(F.input_file_name()).distinct().count()
    assert files <= target_partitions(spark)                # one file for each bucket
    key = lambda df: sorted(map(str, df.collect()))
    assert key(C.ngram_counts(kept, n=3)) == key(C.ngram_counts(annotated(docs), n=3))


def sentences(spark):
    rng = random.Random(3)
    rows = [(f"t{i % 2}", i * 977, [f"w{int(40 * rng.random() ** 2)}" for _ in range(8)] + ["the", "the"]) for i in range(900)]
    rows += [("t1", -5, []), ("t1", 7, None)]
    return spark.createDataFrame(rows, "time string, sent_id long, lemmas array<string>")


@pytest.mark.parametrize("many", [10_000, 1])
def test_lookup_gives_the_sentences_of_the_targets(spark, tmp_path, monkeypatch, many):
    monkeypatch.setattr(PO, "TARGETS", many)
    monkeypatch.setattr(PO, "BLOCK", 50)
    s = sentences(spark)
    PO.write_postings(s, f"{tmp_path}/index")
    targets = spark.createDataFrame([("the",), ("w3",), ("w3",), ("absent",), (None,)], "target string")
    got = PO.lookup(spark, f"{tmp_path}/index", targets)
    want = SN.target_sentences(s, targets)
    assert got.columns == want.columns
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(got) == key(want) and got.count() > 900
    assert PO.lookup(spark, f"{tmp_path}/index", targets.limit(0)).count() == 0
    if many > 1:
        one = PO.lookup(spark, f"{tmp_path}/index", targets.where("target = 'w3'"))
        p = plan_of(one)
        assert p.count("Generate") == 1 and "explode(ids" in p and re.search(r"PartitionFilters: \[[^\]]*_bucket", p)
        files = {r[0] for r in one.select(F.input_file_name()).distinct().collect()}
        assert len({re.search(r"_bucket=\d+", f)[0] for f in files}) == 1


def test_a_hot_lemma_has_many_bounded_rows_in_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(PO, "BLOCK", 20)
    PO.write_postings(sentences(spark), f"{tmp_path}/index")
    hot = spark.read.parquet(f"{tmp_path}/index").where("lemma = 'the'")
    assert hot.count() > 30 and hot.agg(F.max(F.size("ids"))).first()[0] < 60
    assert hot.select(F.input_file_name()).distinct().count() > 1
    assert len(glob.glob(f"{tmp_path}/index/_bucket=*")) > 10


def test_postings_make_the_sentences_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    s = spark.range(300).selectExpr("id AS sent_id", "'t1' AS time", "array('a', concat('w', id % 7)) AS lemmas")
    PO.write_postings(s.mapInArrow(counted, s.schema), f"{tmp_path}/index")
    assert made.value == 300


def test_a_large_corpus_gets_more_and_compressed_buckets(spark, monkeypatch):
    from corpusdelta import session
    monkeypatch.setattr(session, "TASK_BYTES", 20_000)
    docs = lang_docs(spark, SF_SMALL)
    n = session.text_partitions(docs)
    assert n > session.target_partitions(spark)
    assert annotated(docs).rdd.getNumPartitions() == n        # spread deals texts to as many
    kept = TT.read_token_table(spark, TT.write_token_table(annotated(docs.repartition(n, "doc_id")), buckets=n, dealt=True))
    files = [r[0] for r in kept.select(F.input_file_name()).distinct().collect()]
    assert 8 < len(files) <= n and all(f.endswith(".zstd.parquet") for f in files)
    joined = docs.join(docs.select("doc_id"), "doc_id")         # the planner's size of a join is a product
    assert session.text_partitions(joined) <= 2 * n
    assert session.planned_bytes(spark.createDataFrame([(1,)], "a long").rdd.toDF()) is None
