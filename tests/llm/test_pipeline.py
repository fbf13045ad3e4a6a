"""The pipeline: planted cases go, clean documents stay."""

import corpus_pipeline as cp
import __spark_entry__ as E
from corpusdelta.llm import queries

SF = "/root/testdata/sf0.01"


def test_registered():
    names = E.queries()
    assert [n for n in names if n.startswith("op")] == list(queries.QUERIES) and len(queries.QUERIES) == 13 and "pipeline" in names
    assert set(queries.ORACLE_SQL) <= set(names)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    after = [docs]
    for name, stage in cp.STAGES:
        after.append(cp.written(spark, stage(spark, after[-1], SF)))
    ids = [{r.doc_id for r in a.select("doc_id").collect()} for a in after]
    assert all(a.columns == docs.columns for a in after[:-1])
    assert len(ids[1] & bad) < 0.05 * len(bad) and len(good - ids[1]) < 0.02 * len(good)
    texts = {r.doc_id: r.text for r in after[1].collect()}
    first = {}
    for i in sorted(texts):
        first.setdefault(texts[i].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), i)
    assert ids[2] <= set(first.values()) and len(ids[2]) > 0.8 * len(first)
    leaked = {i for i in ids[2] if any(b in texts[i] for b in bench)}
    assert leaked and not leaked & ids[3] and len(ids[2] - leaked - ids[3]) <= 0.01 * len(ids[2])
    assert ids[4] == ids[3] == ids[5]
    assert sorted(cp.run(spark, SF).collect()) == sorted(after[5].collect())
