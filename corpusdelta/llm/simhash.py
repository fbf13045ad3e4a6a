"""SimHash near-duplicates by deletion-variant signatures (operator 5).

Fingerprint: ASCII letters lower-cased, words split at ASCII white space,
shingles of ``shingle`` words joined by one blank (fewer words: all of them;
none: fingerprint zero). Bit i is set if it is set in more than half of the
shingles' XXH64 values (seed 42); repeated shingles count each time.

Links: fingerprints that differ in at most ``max_bits`` bits. The 64 bits are
cut into ``max_bits // 2 + 1`` segments, so some segment of a linked pair
differs in at most one bit. Each fingerprint is indexed by every segment as it
is, and by every segment with one bit replaced by a wildcard; a pair meets
under the wildcard at the bit in which it differs, and is then verified on all
64 bits. Equal fingerprints count as one row, whatever the number of copies.
Keys with more than ``LIGHT`` fingerprints are cut into blocks; each pair of
blocks is searched in one task, which returns only a spanning forest of the
links it finds. So no group meets in one task and no group's pairs are
written out, yet every link is represented in the components.

Defined cases: null or empty texts and texts of white space have fingerprint
zero and are linked like any other; repeated rows are all returned; a null id
is returned with its row and never becomes a component id, unless the whole
component has none (then null); an empty table gives an empty result; other
input columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusdelta.llm.components import connected_components
from corpusdelta.session import cut

SEED = 42
#: Fingerprints of a key that are compared by a plain join.
LIGHT = 24
#: Fingerprints of one block of a heavier key.
BLOCK = 2048
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Shingle hashes held at a time.
_HELD = 1 << 18
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """SimHash of a UTF-8 text, as a signed 64-bit number."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends[:-1]]
    width = min(shingle, len(words))
    n = len(words) - width + 1
    digest, votes = xxhash.xxh64_digest, np.zeros(2048, dtype=np.int64)
    for k in range(0, n, _HELD):
        spans = zip(starts[k:min(k + _HELD, n)], ends[k + width - 1:])
        hashes = np.frombuffer(b"".join([digest(joined[a:b - 1], SEED) for a, b in spans]), dtype=np.uint8)
        places = hashes.reshape(-1, 8) + np.arange(0, 2048, 256)
        votes += np.bincount(places.ravel(), minlength=2048)
    ones = np.einsum("pv,vb->pb", votes.reshape(8, 256), _BITS).ravel()
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id column and ``fp`` long."""
    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fps = [fingerprint(t or b"", shingle) for k in range(0, b.num_rows, 256) for t in texts.slice(k, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=[id_col, "fp"])

    source = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").cast("string").alias("text"))
    return source.mapInArrow(run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, fp long")


def _segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment."""
    n = max_bits // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _variants(nodes: DataFrame, max_bits: int) -> DataFrame:
    """(slot, part, side, fp): the part of the fingerprint that slot keeps, and
    the value of its wildcard bit (null: the segment as it is)."""
    kept, bits = [], []
    for first, size in _segments(max_bits):
        segment = ((1 << size) - 1) << first
        kept += [segment] + [segment & ~(1 << bit) for bit in range(first, first + size)]
        bits += [-1, *range(first, first + size)]
    slots = F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(_signed(k)).alias("mask"), F.lit(bit).alias("bit"))
                      for i, (k, bit) in enumerate(zip(kept, bits))])
    v = nodes.select("fp", F.explode(slots).alias("s")).select("fp", "s.slot", "s.mask", "s.bit")
    return v.select("slot", F.col("fp").bitwiseAND(F.col("mask")).alias("part"),
                    F.when(F.col("bit") >= 0, F.expr("getbit(fp, bit)").cast("int")).alias("side"), "fp")


def links(nodes: DataFrame, max_bits: int = 4) -> DataFrame:
    """nodes (fp, distinct) -> edges (a, b) that connect exactly the
    fingerprints that a chain of links connects; each edge is a link.

    Spark sizes the variants like the fingerprints they were exploded from, and
    would broadcast them; the hints keep them in the shuffle. Of a partition's
    variants, at most one in ``LIGHT`` is a heavy key, the side that is hashed."""
    partitions = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    variants = _variants(nodes.repartition(partitions, F.xxhash64("fp")), max_bits)  # few bytes become many rows
    heavy_keys = cut(variants.groupBy("slot", "part").agg(F.count("*").alias("n")).where(F.col("n") > LIGHT))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    light = variants.join(heavy_keys.hint("shuffle_hash"), ["slot", "part"], "left_anti")
    left = light.where("side IS NULL OR side = 0").select("slot", "part", "side", F.col("fp").alias("a"))
    right = light.where("side IS NULL OR side = 1").select(
        F.col("slot").alias("slot_b"), F.col("part").alias("part_b"), F.col("fp").alias("b"))
    # the check of all bits is part of the join: chance meetings leave no rows
    pairs = left.join(right.hint("merge"), (F.col("slot") == F.col("slot_b")) & (F.col("part") == F.col("part_b")) & close
                      & (F.col("side").isNotNull() | (F.col("a") < F.col("b"))))

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        rest = np.unique(pdf["fp"].to_numpy())
        a, b = [], []
        while rest.size:
            reach, rest = [rest[0]], rest[1:]
            while reach and rest.size:
                at = reach.pop()
                near = np.bitwise_count((rest ^ at).view(np.uint64)) <= max_bits
                found, rest = rest[near], rest[~near]
                a += [at] * found.size
                b += found.tolist()
                reach += found.tolist()
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    heavy = variants.join(heavy_keys.hint("shuffle_hash"), ["slot", "part"]).select(
        "slot", "part", "fp", blocks.alias("blocks"), F.pmod(F.hash("fp"), blocks).alias("own"))
    spread = heavy.select("slot", "part", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    found = (spread.groupBy("slot", "part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
             .applyInPandas(forest, "a long, b long"))
    return pairs.select("a", "b").union(found)


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per input row: the id column, ``fingerprint`` (16 hex digits)
    and ``component_id``, the least id that a chain of links reaches."""
    marked = cut(fingerprints(docs, shingle, id_col, text_col))
    nodes = marked.groupBy("fp").agg(F.min(f"`{id_col}`").alias("least"))
    found = connected_components(links(nodes.select("fp"), max_bits))
    named = (nodes.join(found, F.col("fp") == F.col("node"), "left")
             .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        F.col(f"`{id_col}`"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their group: the one
    with the least id; rows that repeat an id count once. Rows without an id
    can't be told apart and all stay."""
    found = near_duplicates(docs, shingle, max_bits, id_col, text_col)
    kept = found.where(F.col(f"`{id_col}`") == F.col("component_id")).select(F.col("component_id").alias("_kept")).distinct()
    own = docs.where(F.col(f"`{id_col}`").isNotNull())
    return (own.join(kept, F.col(f"`{id_col}`") == F.col("_kept"), "left_semi").dropDuplicates([id_col])
            .unionByName(docs.where(F.col(f"`{id_col}`").isNull())))
