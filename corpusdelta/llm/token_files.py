"""Token-id files (operator 9).

Format: a folder of Parquet files, one for each shard. Shards follow the order
of the document ids, and so do the rows (blocks) of a shard. A block holds
whole documents: their ids (``docs``), their numbers of tokens (``sizes``), the
tokens of the shard before the block (``start``), and the tokens of all its
documents in a byte-aligned variable-length code. Each token is replaced by its
rank by frequency in the corpus, so frequent tokens take one byte. A rank takes
one to four bytes, least first, in ``data``; ``control`` holds two bits for each
token, four tokens a byte, which give the length less one. A table of 256 x 4
lengths, looked up by control byte, decodes a block at once in numpy. The
container is Parquet, so Spark's writers commit the files of each task as a
whole, on any store, also after lost executors.

The corpus is encoded once, kept in the shared checkpoint folder, counted there
(at most one number for each id of the vocabulary leaves the cluster), and
dealt by ranges of the document id. Ranges are cut by id and a hash of the
text, so rows that share an id may be split.

Defined cases: null and empty texts have the end token alone; documents of one
id follow each other in the order of a hash of their text; a null id comes
first; an empty table gives an empty folder and result; only the named columns
are read. A document is never split over blocks.
"""

from __future__ import annotations

import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusdelta.llm.pretokenize import Memo, library_classes, split_many
from corpusdelta.llm.shared import scratch_path

#: Tokens after which a block ends, and tokens that a shard holds about.
BLOCK_TOKENS, SHARD_TOKENS = 1 << 18, 1 << 25
#: Characters of texts that are split together, about.
SLICE_CHARS = 1 << 20


@lru_cache(2)
def _encoder(path: str, added_tokens: bool):
    """The tokenizers library's ids of a text. The vocabulary's pre-tokenizer
    splits at the same pattern as ``split`` (by the library's character classes)
    and spells each byte as one visible character; the library's model is then
    asked once for each pre-token. With ``added_tokens`` a text that holds the
    string of an added token is encoded by the library itself, as its ``encode``
    does; without, such strings are ordinary text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model, table = tokenizer.model, library_classes(tokenizer.pre_tokenizer)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()] if added_tokens else []
    spelt = _byte_spelling()

    def ids(piece: str) -> bytes:
        return array("I", [t.id for t in model.tokenize(piece.encode().decode("latin-1").translate(spelt))]).tobytes()

    memo = Memo(ids)

    def encoded(texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. The pre-tokens of all texts are dictionary-encoded
        together, so the memory is asked once for each different one."""
        whole = {k: t for k, t in enumerate(texts) if any(x in t for x in added)}
        pieces, sizes = split_many(["" if k in whole else t for k, t in enumerate(texts)], table)
        coded = pieces.dictionary_encode()
        each = [memo[p] for p in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]  # no Arrow scalar for each
        length = np.fromiter(map(len, each), np.int64, len(each)) // 4
        first, of = np.cumsum(length) - length, coded.indices.to_numpy()
        n = length[of]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        flat = np.frombuffer(b"".join(each), np.uint32)[np.arange(total) + np.repeat(first[of] - ends + n, n)]
        per_piece = np.append(0, ends)
        cuts = per_piece[np.append(0, np.cumsum(sizes))]
        out = [flat[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
        for k, t in whole.items():
            out[k] = np.array(tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
        return out

    return encoded


def _slices(texts: list[str | None]):
    """Runs of texts of about ``SLICE_CHARS`` characters together."""
    held, size = [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= SLICE_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _byte_spelling() -> dict[int, str]:
    """The character of each byte in byte-level vocabularies: visible Latin-1
    characters stand for themselves, other bytes for U+0100 on, in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


# ---- the code ------------------------------------------------------------

_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of 32-bit numbers."""
    r = np.ascontiguousarray(ranks, dtype="<u4")
    size = 1 + (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    codes = np.zeros(-(-len(r) // 4) * 4, dtype=np.uint8)
    codes[:len(r)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = r.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers that ``pack`` coded."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    at = np.zeros(n, dtype=np.int64)
    np.cumsum(size[:-1], out=at[1:])
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not more.size:
            break
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


# ---- writing -------------------------------------------------------------

def encode(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str, added_tokens: bool = False) -> DataFrame:
    """(doc, tie, n, ids): the ids, with the end, as 16-bit numbers where the
    vocabulary allows it, else as 32-bit numbers."""
    from tokenizers import Tokenizer

    kind = np.dtype("<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")

    def run(batches):
        of, end = _encoder(tokenizer, added_tokens), np.array([end_id], kind)
        for b in batches:
            ids = [np.append(i.astype(kind), end) for texts in _slices(b.column(2).to_pylist()) for i in of(texts)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(i) for i in ids], pa.int64()),
                 pa.array([i.tobytes() for i in ids], pa.binary())], names=["doc", "tie", "n", "ids"])

    text = F.col(f"`{text_col}`").cast("string")
    source = docs.select(F.col(f"`{id_col}`").alias("doc"), F.xxhash64(text).alias("tie"), text.alias("text"))
    return source.mapInArrow(run, f"doc {source.schema['doc'].dataType.simpleString()}, tie long, n long, ids binary")


def _width(ids: bytes, n: int) -> np.dtype:
    return np.dtype("<u2" if len(ids) == 2 * n else "<u4")


def frequency_order(encoded: DataFrame) -> np.ndarray:
    """Ids by falling frequency (ties: the smaller id first)."""
    def run(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            for n, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = np.bincount(np.frombuffer(ids, _width(ids, n)))
                if len(got) > len(total):
                    total, got = got, total
                total[:len(got)] += got
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "c"])

    counts = (encoded.select("n", "ids").mapInArrow(run, "id long, c long")
              .groupBy("id").agg(F.sum("c").alias("c")).toArrow())  # a row for each id of the vocabulary at most
    ids, c = counts["id"].to_numpy(), counts["c"].to_numpy()
    return ids[np.lexsort((ids, -c))]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id",
          text_col: str = "text", added_tokens: bool = False) -> np.ndarray:
    """Write the token files of ``docs`` to the folder ``path``; returns the ids
    by rank, which are also kept in ``path``/order. ``added_tokens``: strings of
    the vocabulary's added tokens get those tokens' ids, as in the library."""
    spark = docs.sparkSession
    kept = scratch_path(spark, "token-ids")
    encode(docs, tokenizer, end_id, id_col, text_col, added_tokens).write.option("compression", "zstd").parquet(kept)
    encoded = spark.read.parquet(kept)
    order = frequency_order(encoded)
    rank = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    spark.createDataFrame([(order.astype("<u4").tobytes(),)], "ids binary").write.parquet(f"{path}/order")
    total = encoded.agg(F.sum("n")).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // SHARD_TOKENS + 1)
    dealt = (encoded.repartitionByRange(shards, "doc", "tie").sortWithinPartitions("doc", "tie")
             .select(F.spark_partition_id().alias("shard"), "doc", "n", "ids"))
    shared = spark.sparkContext.broadcast(rank)  # a number for each id of the vocabulary

    def run(batches):
        rank, before, held, tokens = shared.value, 0, [], 0

        def block():
            shard, doc, n, ids = zip(*held)
            control, data = pack(rank[np.concatenate([np.frombuffer(x, _width(x, k)) for x, k in zip(ids, n)])])
            return pa.RecordBatch.from_arrays(
                [pa.array([shard[0]], pa.int32()), pa.array([before], pa.int64()), pa.array([list(doc)], pa.list_(kind)),
                 pa.array([list(n)], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                names=["shard", "start", "docs", "sizes", "control", "data"])

        for b in batches:
            kind = b.schema.field("doc").type
            for row in zip(*(c.to_pylist() for c in b.columns)):
                held.append(row)
                tokens += row[2]
                if tokens >= BLOCK_TOKENS:
                    yield block()
                    before, held, tokens = before + tokens, [], 0
        if held:
            yield block()

    doc_kind = dealt.schema["doc"].dataType.simpleString()
    (dealt.mapInArrow(run, f"shard int, start long, docs array<{doc_kind}>, sizes array<bigint>, control binary, data binary")
     .write.option("compression", "zstd").parquet(f"{path}/blocks"))
    return order


# ---- reading -------------------------------------------------------------

def read(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """One row per document of the files: ``doc``, ``start`` (tokens of all
    documents before it), ``n_tokens``, ``ids_crc32`` of its ids as 32-bit
    little-endian numbers and, if asked for, ``ids`` themselves."""
    blocks = spark.read.parquet(f"{path}/blocks")
    order = np.frombuffer(spark.read.parquet(f"{path}/order").first()["ids"], "<u4")
    # a number for each shard
    sizes = sorted(tuple(r) for r in blocks.groupBy("shard").agg(F.max(F.col("start") + F.expr(
        "aggregate(sizes, 0L, (a, x) -> a + x)"))).collect())
    before, offset = 0, {}
    for shard, n in sizes:
        offset[shard] = before
        before += n
    shared = spark.sparkContext.broadcast((order, offset))

    def run(batches):
        order, offset = shared.value
        for b in batches:
            for k in range(b.num_rows):
                shard, at, docs, n, control, data = (c[k].as_py() for c in b.columns)
                ids = order[unpack(control, data, sum(n))]
                ends = np.cumsum(n)
                parts = np.split(ids, ends[:-1])
                columns = [pa.array(docs, b.schema.field("docs").type.value_type),
                           pa.array(ends - n + offset[shard] + at, pa.int64()), pa.array(n, pa.int64()),
                           pa.array([zlib.crc32(np.ascontiguousarray(p, "<u4")) for p in parts], pa.int64())]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array([0, *ends.tolist()], pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "start", "n_tokens", "ids_crc32", "ids"][:len(columns)])

    kind = blocks.schema["docs"].dataType.elementType.simpleString()
    return (blocks.select("shard", "start", "docs", "sizes", "control", "data")
            .mapInArrow(run, f"doc {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
               added_tokens: bool = False) -> DataFrame:
    """Write the token files of ``docs`` to a new shared folder and read them."""
    path = scratch_path(docs.sparkSession, "token-files")
    write(docs, path, tokenizer, end_id, id_col, text_col, added_tokens)
    return read(docs.sparkSession, path).withColumnRenamed("doc", id_col)
