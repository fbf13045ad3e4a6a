"""The registered query of every operator, over its whole table, with
production parameters; and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusdelta.llm import bpe, conversations, decontaminate, lm, pieces, pii, quality, resample, secret_scan, simhash, token_files, topk, urls

#: Key of the registered pseudonym query; a deployment passes its own.
PSEUDONYM_KEY = "corpusdelta"

#: Rules of the registered URL query: verdict, host and path prefix.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document with the 50k byte-level vocabulary."""
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the place."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms for its personal data."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PSEUDONYM_KEY, count_col="n_replaced")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; fold 1 of 3 is held out."""
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, max_bits=4)


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return urls.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secret_scan.digests(secret_scan.scan(_table(spark, sf_dir, "documents")))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document; fold 2 of 7 is held out."""
    return lm.score_held_out(_table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document's token ids, read the files, digest the ids."""
    return token_files.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best partners of every hundredth vector."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage every conversation, and report on its cheapest repair."""
    return conversations.damaged_and_repaired(_table(spark, sf_dir, "conversations"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document with the 32k piece model."""
    return pieces.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn towards the benchmark's words."""
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_decontaminate": op2_decontaminate,
    "op3_pii": op3_pii,
    "op4_quality": op4_quality,
    "op5_simhash": op5_simhash,
    "op6_urls": op6_urls,
    "op7_secrets": op7_secrets,
    "op8_lm": op8_lm,
    "op9_token_files": op9_token_files,
    "op10_topk": op10_topk,
    "op11_conversations": op11_conversations,
    "op12_pieces": op12_pieces,
    "op13_resample": op13_resample,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": decontaminate.sql(),
    "op10_topk": topk.sql(),
}
