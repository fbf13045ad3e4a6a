"""n-grams of at least a minimum frequency (A2 with P4), pruned before the wide
shuffle.

Every part of a frequent n-gram is frequent. So the corpus is read level by
level: level m counts 64-bit hashes of the m-grams whose two (m - 1)-grams are
frequent, and the frequent ones of all corpora go into a Bloom filter for the
next level. Only n-grams that pass the last filter are spelt out and shuffled as
text, and these are counted exactly. A filter never loses a frequent n-gram;
what it lets through by chance falls to the exact count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusdelta.functions import text as T
from corpusdelta.operators.batched_logit import splitmix64
from corpusdelta.session import written

#: Bits of a filter; with this many, 13 million frequent parts pass one in 100 others.
BITS = 1 << 27
#: Bits that are set for each member.
PROBES = 4


def _probes(grams: np.ndarray, bits: int) -> np.ndarray:
    a, b = splitmix64(grams), splitmix64(grams ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return (a[:, None] + np.arange(PROBES, dtype=np.uint64) * b[:, None]) % np.uint64(bits)


def _passes(filter_: np.ndarray, grams: np.ndarray) -> np.ndarray:
    at = _probes(grams, len(filter_) * 64)
    return ((filter_[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


class _Sentences:
    """The token hashes of a batch of sentences, end to end."""

    def __init__(self, corpus: np.ndarray, hashes: pa.Array):
        lists = hashes.combine_chunks() if isinstance(hashes, pa.ChunkedArray) else hashes
        self.hash = lists.flatten().to_numpy().astype(np.int64).view(np.uint64)
        self.size = np.diff(lists.offsets.to_numpy())
        self.sentence = np.repeat(np.arange(len(self.size)), self.size)
        self.left = np.repeat(np.cumsum(self.size), self.size) - np.arange(len(self.hash))     # tokens to the sentence's end
        self.seed = splitmix64(corpus.astype(np.int64).view(np.uint64))[self.sentence] if len(self.hash) else self.hash

    def grams(self, n: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the n-grams that begin at these places."""
        g = self.seed[at]
        for i in range(n):
            g = splitmix64(g ^ self.hash[at + i])
        return g

    def candidates(self, n: int, filter_: np.ndarray | None) -> np.ndarray:
        """Places of the n-grams whose two (n - 1)-grams pass the filter."""
        at = np.flatnonzero(self.left >= n)
        if filter_ is None or not len(at):
            return at
        at = at[_passes(filter_, self.grams(n - 1, at))]
        return at[_passes(filter_, self.grams(n - 1, at + 1))] if len(at) else at


def _filter(counted: DataFrame, min_freq: int, bits: int) -> np.ndarray:
    """The Bloom filter of the frequent hashes, put together by its words: at
    most ``bits / 64`` numbers reach the driver."""
    def words(batches):
        for b in batches:
            at = _probes(b.column(0).to_numpy().astype(np.int64).view(np.uint64), bits).ravel()
            place, of = np.unique((at >> np.uint64(6)).astype(np.int64), return_inverse=True)
            out = np.zeros(len(place), np.uint64)
            np.bitwise_or.at(out, of, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(out.view(np.int64))], names=["place", "word"])
    frequent = counted.where(F.col("c") >= min_freq).select("gram")
    got = frequent.mapInArrow(words, "place long, word long").groupBy("place").agg(F.bit_or("word").alias("word")).toArrow()
    filter_ = np.zeros(bits // 64, np.uint64)
    filter_[got["place"].to_numpy()] = got["word"].to_numpy().view(np.uint64)
    return filter_


def sentence_hashes(tokens: DataFrame, by: str, key: str = "target", doc: str = "doc_id") -> DataFrame:
    """``(corpus, seed, targets, hashes)``, one row per sentence; the grouping
    contains the document id, so a doc-id partitioning satisfies it."""
    s = (tokens.groupBy(by, doc, "sent_id").agg(F.array_sort(F.collect_list(F.struct("pos_in_sent", key))).alias("s")))
    return _hashed(s.select(F.col(by).alias("corpus"), F.col(f"s.{key}").alias("targets")))


def _hashed(sentences: DataFrame) -> DataFrame:
    return sentences.select("corpus", F.xxhash64("corpus").alias("seed"), "targets",
                            F.transform("targets", lambda t: F.xxhash64(t)).alias("hashes"))


def candidate_ngrams(sentences: DataFrame, n: int, min_freq: int, bits: int = BITS) -> DataFrame:
    """``(corpus, target, c)``: n-grams that can reach ``min_freq`` in their
    corpus, with their counts by batch of sentences."""
    spark, filter_ = sentences.sparkSession, None
    narrow = sentences.select("seed", "hashes")
    for m in range(1, n):
        shared = spark.sparkContext.broadcast(filter_)

        def level(batches, m=m, shared=shared):
            for b in batches:
                s = _Sentences(b.column(0).to_numpy(), b.column(1))
                grams, c = np.unique(s.grams(m, s.candidates(m, shared.value)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(c)], names=["gram", "c"])
        counted = narrow.mapInArrow(level, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))
        filter_ = _filter(counted, min_freq, bits)
    shared = spark.sparkContext.broadcast(filter_)
    kind = sentences.schema["corpus"].dataType.simpleString()

    def spelt(batches):
        for b in batches:
            s = _Sentences(b.column(1).to_numpy(), b.column(3))
            at = s.candidates(n, shared.value)
            sentence = s.sentence[at]
            words, corpora = b.column(2).flatten().to_pylist(), b.column(0).take(pa.array(sentence))
            texts = pa.array([" ".join(words[i:i + n]) for i in at.tolist()], pa.string())
            both = pa.table({"corpus": corpora, "target": texts}).group_by(["corpus", "target"]).aggregate([([], "count_all")])
            yield from both.rename_columns(["corpus", "target", "c"]).to_batches()
    return sentences.select("corpus", "seed", "targets", "hashes").mapInArrow(spelt, f"corpus {kind}, target string, c long")


def frequent_ngrams(tokens: DataFrame, n: int, min_freq: int, by: str = "corpus", key: str = "target", bits: int = BITS) -> DataFrame:
    """``(by, target, lemma, pos, freq)`` of the contiguous n-grams with at least
    ``min_freq`` occurrences in their corpus: :func:`counts.ngram_counts` with a
    minimum frequency. The sentences are kept as compressed Parquet, without their
    hashes, which do not compress and are quickly made again for each level."""
    kept = written(sentence_hashes(tokens, by, key).select("corpus", "targets"))
    found = candidate_ngrams(_hashed(kept), n, min_freq, bits)
    return (found.groupBy("corpus", "target").agg(F.sum("c").alias("freq")).where(F.col("freq") >= min_freq)
            .select(F.col("corpus").alias(by), "target", T.ngram_lemma("target").alias("lemma"), T.ngram_pos("target").alias("pos"), "freq"))
