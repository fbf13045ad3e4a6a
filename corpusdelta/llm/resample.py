"""Target-distribution importance resampling (operator 13).

Method: hashed n-gram importance weights. The words that a worker has met form
an Aho-Corasick dictionary, each between two delimiters; the payload of a word
is the CRC-32 of its bytes, the CRC with the joining blank behind it, and its
length. One scan of a text emits the payloads of its words. The CRC of a run of
two words follows from adjacent payloads alone, ``crc(a + " " + b) =
shift(crc(a + " "), len(b)) ^ crc(b)``, where ``shift`` is the linear map of
appending zero bytes (``Shift``, by table lookup), so no run is ever built.
Words that the dictionary lacks leave gaps between the emitted ones; they are
hashed directly and learnt. The dictionary changes the work, never the result.

Two passes over the corpus, neither of which moves a text: the first counts
features by bucket (one array in each task, summed by Spark), the second scores
every document with the gains of the buckets. A document's score is the mean
gain plus Gumbel noise of its id, and the highest scores are drawn, which is a
draw without replacement in proportion to the importance weights.

Defined cases: a null or empty text has no features and weight 0; texts of any
length are read whole; a null id takes the noise of an empty id and loses ties;
repeated rows count and are drawn as rows of their own, in any order among
themselves; an empty corpus gives an empty result, an empty target the weights
against no features; only the named input columns are read, so further columns
of any name do no harm.
"""

from __future__ import annotations

import math
import zlib
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusdelta.operators.tokens import dense_ids
from corpusdelta.session import cut

#: Bytes of words (digits, a to z, all beyond ASCII) stay, A to Z become lower
#: case, and every other byte becomes the delimiter.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
DELIMITER = 32
#: Bound of the dictionary in words; beyond it, it is begun anew.
WORDS_KEPT = 1 << 18
#: Documents that are worked on together.
SLICE = 256


class Shift:
    """The map of CRC-32 values by appending zero bytes, for whole arrays."""

    SHORT = 64

    def __init__(self):
        step = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
        tables = [np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)]
        for _ in range(self.SHORT):
            last = tables[-1]
            tables.append(step[last & 255] ^ last >> 8)
        self.short = np.stack(tables[:-1])
        self.long = [tables[-1]]  # by SHORT, twice SHORT, ... bytes
        while len(self.long) < 26:
            self.long.append(self._apply(self.long[-1], self.long[-1]))

    @staticmethod
    def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]

    def __call__(self, crc: np.ndarray, size: np.ndarray) -> np.ndarray:
        low = size % self.SHORT
        out = (self.short[low, 0, crc & 255] ^ self.short[low, 1, crc >> 8 & 255]
               ^ self.short[low, 2, crc >> 16 & 255] ^ self.short[low, 3, crc >> 24])
        rest, k = size // self.SHORT, 0
        while rest.any():
            odd = np.flatnonzero(rest & 1)
            out[odd] = self._apply(self.long[k], out[odd])
            rest, k = rest >> 1, k + 1
        return out


class Dictionary:
    """Words between delimiters, with their payloads."""

    def __init__(self):
        self._begin()

    def _begin(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.index: dict[bytes, int] = {}
        self.crc, self.crc_blank, self.size = array("I"), array("I"), array("I")
        self.waiting: list[bytes] = []  # learnt, but not in the automaton yet

    def refresh(self, least: int = 256) -> None:
        """Between slices: take up what was learnt, once there is enough of it."""
        if len(self.index) > WORDS_KEPT:
            self._begin()
        elif len(self.waiting) > max(least, len(self.index) // 4):
            for word in self.waiting:
                self.automaton.add_word(f" {word.decode('latin-1')} ", self.index[word])
            self.waiting.clear()
            self.automaton.make_automaton()

    def learn(self, word: bytes) -> int:
        known = self.index.get(word)
        if known is None:
            known = self.index[word] = len(self.index)
            crc = zlib.crc32(word)
            self.crc.append(crc)
            self.crc_blank.append(zlib.crc32(b" ", crc))
            self.size.append(len(word))
            self.waiting.append(word)
        return known

    def scan(self, text: str) -> np.ndarray:
        """Dictionary numbers of the words of ``text`` in order."""
        folded = b" " + text.encode().translate(FOLD) + b" "
        inside = np.frombuffer(folded, np.uint8) != DELIMITER
        ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1  # of the delimiters behind words
        found = np.empty((0, 2), np.int64)
        if len(self.index) > len(self.waiting):
            emitted = self.automaton.iter(folded.decode("latin-1"))
            found = np.fromiter(chain.from_iterable(emitted), np.int64).reshape(-1, 2)
        if len(found) == len(ends):
            return found[:, 1]
        number = np.full(len(folded), -1, np.int64)
        number[found[:, 0]] = found[:, 1]
        number = number[ends]
        gaps = np.flatnonzero(number < 0)
        starts = np.flatnonzero(inside[1:] & ~inside[:-1])[gaps] + 1
        number[gaps] = [self.learn(folded[a:b]) for a, b in zip(starts.tolist(), ends[gaps].tolist())]
        return number

    def payloads(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.frombuffer(x, np.uint32)[number] for x in (self.crc, self.crc_blank, self.size)) if len(number) else \
            tuple(np.empty(0, np.uint32) for _ in range(3))


class Features:
    """Buckets of the runs of one and two words, for slices of texts."""

    def __init__(self, buckets: int):
        self.buckets, self.words, self.shift = buckets, Dictionary(), Shift()

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text, the bucket of every word, and the bucket of every
        word with the next one (-1 at the end of a text)."""
        self.words.refresh()
        numbers = [self.words.scan(t or "") for t in texts]
        counts = np.array([len(n) for n in numbers], np.int64)
        crc, crc_blank, size = self.words.payloads(np.concatenate([np.empty(0, np.int64), *numbers]))
        pairs = np.full(len(crc), -1, np.int64)
        if len(crc) > 1:
            pairs[:-1] = (self.shift(crc_blank[:-1], size[1:]) ^ crc[1:]) % self.buckets
            last = np.cumsum(counts)[counts > 0] - 1
            pairs[last] = -1
        return counts, (crc % self.buckets).astype(np.int64), pairs


@lru_cache(2)
def _features(buckets: int) -> Features:
    """Kept by a worker from task to task, with the words it has learnt."""
    return Features(buckets)


def _sliced(batches):
    """The columns of Arrow batches, in slices."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def bucket_counts(docs: DataFrame, buckets: int = 10_000, text_col: str = "text") -> DataFrame:
    """``(bucket, n)``: how many features of all texts fall into each bucket
    that has any."""
    def run(batches):
        features, total = _features(buckets), np.zeros(buckets, np.int64)
        for b in _sliced(batches):
            _, single, pairs = features(b.column(0).to_pylist())
            total += np.bincount(single, minlength=buckets) + np.bincount(pairs[pairs >= 0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    per_task = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    return per_task.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Gain of each bucket from the two ``bucket_counts`` (a parameter's number
    of rows each): ``floor(1000 ln(target share / source share))``, smoothed by one."""
    def whole(counts: DataFrame) -> list[float]:
        out = [0.0] * buckets
        for bucket, n in counts.collect():
            out[bucket] = float(n)
        return out

    s, t = whole(source), whole(target)
    s_all, t_all = sum(s) + buckets, sum(t) + buckets
    return np.array([math.floor(1000 * math.log((b + 1) * s_all / ((a + 1) * t_all))) for a, b in zip(s, t)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id column, ``n_words``, ``n_features`` and
    ``weight``, the floored mean gain of its features."""
    def run(batches):
        features = _features(len(gain))
        padded = np.append(gain, 0)  # the last for what is no pair
        for b in _sliced(batches):
            counts, single, pairs = features(b.column(1).to_pylist())
            running = np.concatenate(([0], np.cumsum(gain[single] + padded[pairs])))
            ends = np.cumsum(counts)
            total = running[ends] - running[ends - counts]
            n = np.maximum(2 * counts - 1, 0)
            mean = total // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (counts, n, mean))],
                                             names=[id_col, "n_words", "n_features", "weight"])

    source = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").cast("string").alias("_text"))
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, min_words: int = 20, percent: int = 25,
             seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Draw ``percent`` of the documents of at least ``min_words`` words towards
    the distribution of ``target``. One row per document: the id column,
    ``n_features``, ``weight``, ``score`` and ``rank`` (1, 2, 3, ... in the order
    of the draw, null if not drawn)."""
    gain = gains(bucket_counts(docs, buckets, text_col), bucket_counts(target, buckets, text_col), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    noise = F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))
    scored = weights(docs, gain, id_col, text_col).withColumn("score", (F.col("weight") + noise).cast("long"))
    scored = cut(scored).withColumn("_row", F.monotonically_increasing_id())  # parts equal rows, however many
    fit = F.col("n_words") >= min_words
    drawn = scored.where(fit).count() * percent // 100
    ranked = dense_ids(scored.where(fit), [F.desc("score"), F.asc_nulls_last(f"`{id_col}`"), F.col("_row")], "rank")
    rank = F.col("rank") + 1
    columns = [F.col(f"`{id_col}`"), "n_features", "weight", "score"]
    return (ranked.select(*columns, F.when(rank <= drawn, rank).cast("long").alias("rank"))
            .unionByName(scored.where(~fit).select(*columns, F.lit(None).cast("long").alias("rank"))))


def drawn(docs: DataFrame, ranked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents whose id ``resample`` has drawn, with all their columns."""
    ids = ranked.where("rank IS NOT NULL").select(F.col(f"`{id_col}`").alias("_drawn")).distinct()
    return docs.join(ids, docs[f"`{id_col}`"].eqNullSafe(ids["_drawn"]), "left_semi")
