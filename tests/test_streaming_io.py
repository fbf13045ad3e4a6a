"""Streaming counts equal batch counts; write-then-read plans."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from corpusdelta.operators import counts as C
from corpusdelta.plans.common import annotated, lang_docs
from corpusdelta.streaming import stream_counts
from tests.conftest import SF_SMALL


def test_stream_counts_equal_batch(spark, tmp_path):
    src = str(tmp_path / "incoming")
    docs = lang_docs(spark, SF_SMALL)
    docs.filter(F.col("doc_id") < 100).write.parquet(src + "/b1")
    docs.filter(F.col("doc_id") >= 100).write.parquet(src + "/b2")
    q = stream_counts(spark, src + "/*", "doc_id long, text string, corpus string", name="sc_test")
    q.awaitTermination(300)
    got = {(r.corpus, r.target): r.freq for r in spark.sql("SELECT * FROM sc_test").collect()}
    want = {(r.corpus, r.target): r.freq for r in C.unigram_counts(annotated(docs)).collect()}
    assert got == want


def test_write_plans_roundtrip(spark):
    q = E.queries()
    n = spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    assert q["write_if_absent"](spark, SF_SMALL).count() == n
    assert q["write_append"](spark, SF_SMALL).count() == n
    assert sum(r["count"] for r in q["write_table"](spark, SF_SMALL).collect()) == 2 * n
