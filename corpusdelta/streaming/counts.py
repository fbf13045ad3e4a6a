"""Running frequency counts over a stream of document files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusdelta.functions import text as T
from corpusdelta.session import ensure_checkpoint_dir


def token_counts_stream(docs: DataFrame, by: str = "corpus") -> DataFrame:
    """Streaming-safe A1: explode sentences and tokens, annotate with the
    same column expressions as the batch path, count per (corpus, target)."""
    s = docs.select(by, F.explode(T.sentence_array("text")).alias("sentence"))
    t = s.select(by, F.explode(T.token_array("sentence")).alias("token"))
    t = t.withColumn("upos", T.upos("token")).withColumn("lemma", T.lemma("token", F.col("upos")))
    return t.groupBy(by, T.tagged("lemma", "upos").alias("target")).agg(F.count(F.lit(1)).alias("freq"))


def stream_counts(spark: SparkSession, source_dir: str, schema: str, sink: str = "memory",
                  name: str = "corpus_counts", by: str = "corpus", trigger_once: bool = True,
                  output_mode: str = "complete", **options):
    """Start a streaming count over parquet files arriving in ``source_dir``.
    Returns the ``StreamingQuery``. ``sink='memory'`` (small tests) keeps the
    running table on the driver as ``name``; ``sink='parquet'`` writes each
    complete result, distributed, to ``<checkpoint folder>/<name>`` through
    ``foreachBatch`` (what a cluster job uses)."""
    docs = spark.readStream.schema(schema).options(**options).parquet(source_dir)
    counts = token_counts_stream(docs, by)
    cp = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpusdelta-stream/{uuid.uuid4().hex}"
    w = counts.writeStream.outputMode(output_mode).option("checkpointLocation", cp)
    if sink == "memory":
        w = w.format("memory").queryName(name)
    elif sink == "parquet":
        out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpusdelta-stream-out/{name}"
        w = w.foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(out))
    else:
        w = w.format(sink)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()


def stream_output_path(spark: SparkSession, name: str) -> str:
    """Where ``sink='parquet'`` writes the running counts for ``name``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpusdelta-stream-out/{name}"
