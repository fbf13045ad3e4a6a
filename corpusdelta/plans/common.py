"""Shared helpers for the registered plans: table access, output rounding
and the corpora derived from the driver tables (FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusdelta.operators import tokens as tok

DIGITS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every floating column (the oracle rounds the same way)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def quality_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two corpora: labelled documents of quality 0 (base, ``q0``) and of
    quality 1 (target, ``q1``)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return (docs.join(lab, "doc_id")
            .select("doc_id", "text", F.concat(F.lit("q"), F.col("quality")).alias("corpus")))


def source_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty corpora, one per ``source``."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.col("source").alias("corpus"))


def lang_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four corpora, one per language."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.col("lang").alias("corpus"))


def annotated(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, corpus) -> annotated tokens with the corpus."""
    return tok.annotate_tokens(tok.tokenize(docs, keep=("corpus",)))
