"""A training-data pipeline over ``documents``: each stage is written as
Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusdelta.llm import bpe, decontaminate, pii, quality, simhash
from corpusdelta.llm.queries import PSEUDONYM_KEY
from corpusdelta.llm.shared import scratch_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the least id."""
    return simhash.keep_one(docs, shingle=4, max_bits=4)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data get pseudonyms of their format."""
    return pii.pseudonymise(docs, PSEUDONYM_KEY)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode what is left, and decode the ids again."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_filter),
    ("PII", pseudonyms),
    ("byte-level BPE", tokens),
]
#: Model scores and hashes are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result is kept in the shared checkpoint folder
    as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def written(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` as Parquet in a new folder of the shared checkpoint folder."""
    path = scratch_path(spark, "pipeline")
    docs.write.parquet(path)
    return spark.read.parquet(path)
