"""Quality classifier by nearest-neighbour voting (operator 4).

Terms are byte trigrams of the whole text, case and punctuation included,
hashed into ``TERMS`` buckets (damped, idf-weighted, unit length), and beside
them ``FLOW`` terms of the word flow: the shares of words that repeat the word
before them or not (square roots, unit length). Both are projected on the ``RANK`` leading singular directions of a labelled sample
(latent semantic vectors, unit length). The sample's vectors and labels are
broadcast; each task multiplies blocks of its documents with all of them, which
gives exact cosines, and the ``NEIGHBOURS`` most similar vote with a weight that
falls off with the distance from the nearest. Votes are weighted by the share of
each class among all labelled rows, as the sample takes classes alike.

The model is fitted on at most ``FIT_ROWS`` labelled rows (half of each class,
those with the least hash of the id), so the broadcast has at most
``FIT_ROWS * RANK + WIDTH * RANK`` floats at any input size; every document is
scored.

Defined cases: null and empty texts have no terms and get the share of label 1
among the labelled rows; labels or ids that are null teach nothing; with labels
of one class only every score is that class, with none it is 0.5; repeated rows
are scored alike; an empty table gives an empty result; only the named columns
are read.
"""

from __future__ import annotations

import zlib
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMS, FLOW, RANK, FIT_ROWS, NEIGHBOURS = 4096, 2, 64, 4000, 15
WIDTH = TERMS + FLOW
#: Texts that a task holds as rows of a matrix; bytes that are hashed at a time.
ROWS_HELD, BYTES_HELD = 256, 1 << 20


def term_counts(text: bytes) -> np.ndarray:
    """Counts of the hashed byte trigrams of a text."""
    out = np.zeros(WIDTH, dtype=np.int64)
    for at in range(0, max(0, len(text) - 2), BYTES_HELD):
        b = np.frombuffer(text, np.uint8, min(BYTES_HELD + 2, len(text) - at), at).astype(np.uint32)
        key = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
        key *= np.uint32(0x27D4EB2F)
        out[:TERMS] += np.bincount(key >> np.uint32(20), minlength=TERMS)
    words = text.split()
    same = sum(map(eq, words, islice(words, 1, None)))
    out[TERMS:] = same, max(len(words) - 1 - same, 0)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _weighted(counts: "np.ndarray | PackedCounts", idf: np.ndarray) -> np.ndarray:
    out = np.empty((len(counts), WIDTH), np.float32)
    for at in range(0, len(counts), ROWS_HELD):  # the logarithms of a few rows at a time take twice the memory
        rows, some = slice(at, at + ROWS_HELD), counts[at:at + ROWS_HELD]
        out[rows, :TERMS] = _unit(np.log1p(some[:, :TERMS]).astype(np.float32) * idf)
        out[rows, TERMS:] = _unit(np.sqrt(some[:, TERMS:], dtype=np.float32))
    return out


class PackedCounts:
    """Term counts of a sample as compressed rows, of which a slice is unpacked;
    most counts of a text are 0, so the driver holds a tenth of the matrix."""

    def __init__(self, rows: pa.ChunkedArray):
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, some: slice) -> np.ndarray:
        packed = self.rows[some].to_pylist()
        return np.stack([np.frombuffer(zlib.decompress(p), np.int32) for p in packed])


class Model:
    """Projection, labelled vectors and class shares."""

    def __init__(self, counts: np.ndarray | PackedCounts, labels: np.ndarray, share: float, seed: int = 7):
        n = len(labels)
        self.labels, self.share = labels.astype(np.float32), share
        found = np.zeros(TERMS, np.int64)       # rows that hold a term
        for at in range(0, n, ROWS_HELD):
            found += (counts[at:at + ROWS_HELD][:, :TERMS] > 0).sum(axis=0)
        self.idf = (np.log((1 + n) / (1 + found)) + 1).astype(np.float32)
        x = _weighted(counts, self.idf)
        probe = np.random.default_rng(seed).standard_normal((WIDTH, min(RANK + 16, max(n, 1)))).astype(np.float32)
        for _ in range(2):  # randomised singular vectors, with power steps
            probe = x.T @ np.linalg.qr(x @ probe)[0] if n else probe
        q = np.linalg.qr(x @ probe)[0] if n else np.zeros((0, 0), np.float32)
        self.directions = (np.linalg.svd(q.T @ x, full_matrices=False)[2][:RANK].T if n else np.zeros((WIDTH, 1))).astype(np.float32)
        self.vectors = _unit(x @ self.directions)
        ones = float(self.labels.sum())
        # the sample takes the classes alike: a vote counts as many rows as it stands for
        self.votes = np.where(self.labels > 0, share / max(ones, 1), (1 - share) / max(n - ones, 1)).astype(np.float32)

    def score(self, texts: list[bytes]) -> np.ndarray:
        counts = np.stack([term_counts(t) for t in texts])
        x = _unit(_weighted(counts, self.idf) @ self.directions)
        out = np.full(len(texts), self.share)
        some = np.flatnonzero(np.any(x != 0, axis=1))
        if len(self.labels) == 0 or not some.size:
            return out
        cosine = x[some] @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        like = np.take_along_axis(cosine, near, axis=1)
        distance = 1 - np.minimum(like, 1)
        weight = self.votes[near] / (distance + 0.1 * distance.mean(axis=1, keepdims=True) + 1e-6)
        out[some] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(out, 0, 1)


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (a null id counts as empty)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> Model:
    """Learn from labelled documents; ``labels`` holds only rows to learn from."""
    known = (labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
             .where("id IS NOT NULL AND label IN (0, 1)").distinct())
    n, ones = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    order = F.xxhash64("id")
    chosen = known.where("label = 0").orderBy(order, "id").limit(rows // 2).unionByName(
        known.where("label = 1").orderBy(order, "id").limit(rows // 2))

    def run(batches):
        for b in batches:
            texts = b.column(2).cast(pa.binary()).to_pylist()
            packed = [zlib.compress(term_counts(t or b"").astype(np.int32).tobytes(), 1) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())],
                                             names=["id", "label", "counts"])

    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # at most ``rows`` rows of an id and a label
    sample = source.join(F.broadcast(chosen), "id").dropDuplicates(["id"]).select("id", "label", "text")
    kind = source.schema["id"].dataType.simpleString()
    got = sample.mapInArrow(run, f"id {kind}, label int, counts binary").toArrow().sort_by("id")
    return Model(PackedCounts(got["counts"]), got["label"].to_numpy(), ones / n if n else 0.5)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id column and ``score`` (label 1 likelier)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            out = [m.score([t or b"" for t in texts[k:k + ROWS_HELD].to_pylist()]) for k in range(0, b.num_rows, ROWS_HELD)]
            scores = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=[id_col, "score"])

    source = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").cast("string").alias("text"))
    return source.mapInArrow(run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", folds: int = 3, held_out: int = 1) -> DataFrame:
    """Learn outside fold ``held_out`` and score every document: the id column,
    ``held_out``, ``score``, ``predicted`` (1 from a score of 0.5)."""
    model = fit(docs, labels.where(fold(F.col(f"`{id_col}`"), folds) != held_out), rows, id_col, text_col, label_col)
    return score(docs, model, id_col, text_col).select(
        F.col(f"`{id_col}`"), (fold(F.col(f"`{id_col}`"), folds) == held_out).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text",
              label_col: str = "quality", folds: int = 3, held_out: int = 1) -> DataFrame:
    """The rows of ``docs``, all columns, that are predicted as label 1; the
    same model as ``classify``. Rows pass through one task: no join."""
    model = fit(docs, labels.where(fold(F.col(f"`{id_col}`"), folds) != held_out), rows, id_col, text_col, label_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        m = shared.value
        for b in batches:
            for k in range(0, b.num_rows, ROWS_HELD):
                part = b.slice(k, ROWS_HELD)
                texts = part.column(at).cast(pa.binary()).to_pylist()
                yield part.filter(pa.array(m.score([t or b"" for t in texts]) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
