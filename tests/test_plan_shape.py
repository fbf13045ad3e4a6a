"""Plan-shape guards for the scale properties claimed in the README."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL


def _plan(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_family_reuses_doc_partitioning(spark):
    p = _plan(spark, "surface_counts")
    # only the spread of the narrow scan; both aggregations reuse it
    assert p.count("Exchange") <= 1


@pytest.mark.parametrize("name", ["keyness_inner", "keyness_all_pairs", "pair_summary", "ngram_counts",
                                  "unigram_counts", "global_hapax", "lexicon_lookup"])
def test_no_cross_join_no_row_udf(spark, name):
    p = _plan(spark, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in p, (name, bad)


def test_top_k_neighbours_partial_limit(spark):
    p = _plan(spark, "top_k_neighbours")
    assert "WindowGroupLimit" in p and "CartesianProduct" not in p


def test_shared_vocab_counts_once(spark):
    p = _plan(spark, "shared_vocab")       # both sides and the sort read the counts that were made
    assert "FileScan" not in p and "Scan parquet" not in p


def test_mattr_makes_the_tokens_once(spark):
    p = _plan(spark, "mattr")       # no second scan, no exchange of tokens, no set for each window
    assert p.count("FileScan") == 1 and p.count("Exchange") <= 1 and "collect_set" not in p


def test_morph_counts_is_compiled(spark):
    import re
    spark.conf.set("spark.sql.adaptive.enabled", "false")       # an adaptive plan shows its code only when it ran
    try:
        df = E.queries()["morph_counts"](spark, SF_SMALL)
        df._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    code = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    # methods of over 8,000 bytes are not compiled by the JVM
    assert max(map(int, re.findall(r"maxMethodCodeSize:\s*(\d+)", code))) < 8000
