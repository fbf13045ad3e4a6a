"""A written inverted index of sentences by lemma (J15 for many lookups).

Building reads the corpus once: each lemma's sentences become rows of sorted
ids, at most about ``BLOCK`` in a row, so a lemma that is in most sentences has
many rows in many files. Rows lie in folders by a hash of the lemma, so a lookup
opens only the folders of its targets and reads no other sentence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusdelta.session import cut, new_folder, target_partitions

#: Sentences of a row of postings, about; targets that are sent to every task;
#: lemmas of several blocks that are.
BLOCK, TARGETS, LARGE = 4096, 10_000, 100_000


def _bucket(lemma, buckets: int):
    return F.pmod(F.xxhash64(lemma), F.lit(buckets)).cast("int")


def write_postings(sentences: DataFrame, path: str, lemmas: str = "lemmas", keep: Sequence[str] = ("time",),
                   sent: str = "sent_id", buckets: int = 64) -> None:
    """Index ``sentences`` (an id, a lemma array, columns to keep) in the folder
    ``path``. A sentence is listed once even when a lemma repeats."""
    spark = sentences.sparkSession
    n = target_partitions(spark)
    once = new_folder(spark, "sentences")   # the sentences are made once, for the sizes and for the rows
    sentences.select(*keep, F.col(sent).alias("_id"), F.array_distinct(lemmas).alias("_lemmas")).write.parquet(once)
    ex = spark.read.parquet(once).select(*keep, "_id", F.explode("_lemmas").alias("lemma")).where("lemma IS NOT NULL")
    sizes = ex.groupBy(F.col("lemma").alias("_l")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_parts"))
    large = cut(sizes.where("_parts > 1"))  # all other lemmas are one block
    sent_along = F.broadcast(large) if large.count() <= LARGE else large
    blocks = ex.join(sent_along, ex["lemma"] == large["_l"], "left").select(
        *keep, "_id", "lemma", F.pmod(F.xxhash64("_id"), F.coalesce("_parts", F.lit(1))).alias("block"))
    rows = (blocks.groupBy(*keep, "lemma", "block").agg(F.array_sort(F.collect_list("_id")).alias("ids"))
            .withColumn("_bucket", _bucket("lemma", buckets)))
    (rows.repartitionByRange(n, "_bucket", "lemma", "block").sortWithinPartitions("_bucket", "lemma", "block")
     .write.partitionBy("_bucket").parquet(path))


def lookup(spark: SparkSession, path: str, targets: DataFrame, keep: Sequence[str] = ("time",), sent: str = "sent_id",
           buckets: int = 64) -> DataFrame:
    """J15 from a written index: ``(target, keep..., sent_id)`` of the sentences
    that hold a target. Only the targets' folders are read; up to ``TARGETS``
    targets are sent to the tasks, more are joined by a shuffle."""
    wanted = targets.select("target").where("target IS NOT NULL").distinct()
    few = wanted.limit(TARGETS + 1).count() <= TARGETS
    wanted = wanted.select("target", _bucket("target", buckets).alias("_wanted"))
    folders = [r["_wanted"] for r in wanted.select("_wanted").distinct().collect()]     # at most one number per folder
    index = spark.read.parquet(path).where(F.col("_bucket").isin(folders))
    hits = index.join(F.broadcast(wanted) if few else wanted, (index["_bucket"] == wanted["_wanted"]) & (index["lemma"] == wanted["target"]))
    return hits.select("target", *keep, F.explode("ids").alias(sent))
