"""Long n-grams dealt as runs (A2).

An n-gram overlaps the next one in all words but one, so to deal n-grams to tasks
one by one sends each word n times. Here an n-gram is dealt by a key of its own
words: the greatest of its word pairs, by length and then by hash. Neighbouring
n-grams mostly share it and travel as one run of words; equal n-grams have equal
keys, so each is counted whole in one task. Long pairs are rare ones, so no key
gathers many different n-grams, and equal runs are added up before they travel.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusdelta.operators.batched_logit import splitmix64

#: Tokens of whole sentences that a task holds at a time.
HELD = 1 << 20
#: n-grams of one run at most.
LONGEST = 64
#: From this n on, runs send less than the n-grams.
FROM = 4


def _keys(sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The key of each pair of neighbours: seven bits of its length, then its hash."""
    pair = np.minimum(sizes[:-1] + sizes[1:], 127).astype(np.uint64) << np.uint64(57)
    return pair | (splitmix64(splitmix64(hashes[:-1]) ^ hashes[1:]) >> np.uint64(7))


def _odd(words: list, n: int) -> tuple[str, int] | None:
    """Text and key of an n-gram with a null, which is left out, or a word with a
    blank: its key is that of any n-gram of this text."""
    import xxhash
    if words[-1] is None:
        return None
    text = " ".join(w for w in words if w is not None)
    parts = [p.encode() for p in text.split(" ")]
    hashes = np.array([xxhash.xxh64_intdigest(p, 42) for p in (parts if len(parts) == n else [text.encode()])], np.uint64)
    key = _keys(np.array([len(p) for p in parts]), hashes).max() if len(parts) == n else hashes[0]
    return text, int(key)


def _runs(t: pa.Table, n: int, by: Sequence[str]) -> pa.Table:
    """``(by..., _part, _text, _grams, _c)`` of whole sentences; the ``_c`` of a
    null text counts tokens."""
    words, no = t["_word"].combine_chunks(), t["_no"].to_numpy()
    groups = [t[c].combine_chunks() for c in by]
    first = np.flatnonzero(no == 1)
    sizes = np.diff(np.append(first, len(no)))
    left = np.repeat(first + sizes, sizes) - np.arange(len(no))
    starts = np.flatnonzero(left >= n)
    odd = pc.fill_null(pc.match_substring(words, " "), True).to_numpy(zero_copy_only=False)
    before = np.append(0, np.cumsum(odd))
    plain = before[starts + n] == before[starts]
    odd, starts = starts[~plain], starts[plain]

    key = np.zeros(0, np.uint64)
    if len(starts):
        keys = _keys(pc.fill_null(pc.binary_length(words), 0).to_numpy(), t["_hash"].to_numpy().view(np.uint64))
        key = keys[starts]
        for k in range(1, n - 1):
            key = np.maximum(key, keys[starts + k])
    cut = np.ones(len(starts), bool)
    cut[1:] = (np.diff(starts) != 1) | (key[1:] != key[:-1])
    for g in groups:
        code = g.dictionary_encode(null_encoding="encode").indices.to_numpy()
        cut[1:] |= code[starts[1:]] != code[starts[:-1]]
    at = np.flatnonzero(cut)
    since = np.arange(len(starts)) - np.repeat(at, np.diff(np.append(at, len(starts))))
    at = np.flatnonzero(cut | (since % LONGEST == 0))

    lengths = np.diff(np.append(at, len(starts))) + n - 1
    offsets = np.append(0, np.cumsum(lengths))
    inside = np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths)
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.take(pa.array(np.repeat(starts[at], lengths) + inside))), " ")
    found = [(p, _odd(words.slice(p, n).to_pylist(), n)) for p in odd.tolist()]
    found = [(p, *o) for p, o in found if o]
    place = pa.array(np.append(starts[at], np.array([p for p, _, _ in found], np.int64)))
    out = pa.table([g.take(place) for g in groups]
                   + [pa.array(np.append(key[at], np.array([k for _, _, k in found], np.uint64)).view(np.int64)),
                      pa.concat_arrays([texts, pa.array([x for _, x, _ in found], pa.string())]),
                      pa.array(np.append(lengths - n + 1, np.zeros(len(found), np.int64)).astype(np.int32))],
                   names=[*by, "_part", "_text", "_grams"])
    out = out.group_by([*by, "_part", "_text", "_grams"]).aggregate([([], "count_all")]).rename_columns([*by, "_part", "_text", "_grams", "_c"])
    total = pa.table([*groups, pa.array(np.zeros(len(no), np.int32))], names=[*by, "_grams"])
    total = total.group_by([*by, "_grams"]).aggregate([([], "count_all")]).rename_columns([*by, "_grams", "_c"])
    total = (total.append_column("_part", pa.nulls(total.num_rows, pa.int64())).append_column("_text", pa.nulls(total.num_rows, pa.string())))
    return pa.concat_tables([out, total.select(out.column_names)])


def ngram_runs(tokens: DataFrame, n: int, by: Sequence[str], key: str = "target", doc: str = "doc_id", totals: bool = False) -> DataFrame:
    """``(by..., _part, _text, _grams, _c)``: runs of words, each for ``_c`` times the
    ``_grams`` n-grams in it (0: it is one, of any words), dealt by ``_part``. With
    ``totals``, the rows without a text count tokens.

    The window numbers the words of a sentence and leaves them together and in
    their order; the partitioning by document satisfies it."""
    w = Window.partitionBy(doc, "sent_id").orderBy("pos_in_sent")
    source = tokens.select(*by, F.col(key).cast("string").alias("_word"), F.xxhash64(F.col(key).cast("string")).alias("_hash"),
                           F.row_number().over(w).alias("_no"))

    def run(batches):
        held, size = [], 0

        def flush(last):
            t = pa.Table.from_batches(held)
            no = t["_no"].to_numpy()
            stop = len(no) if last else int(np.flatnonzero(no == 1)[-1])
            whole = t.slice(0, stop)
            steps = np.diff(no[:stop])
            if stop and (no[0] != 1 or ((steps != 1) & (no[1:stop] != 1)).any()):
                raise RuntimeError("words of a sentence do not come in their order")
            out = _runs(whole, n, by).to_batches() if stop else []
            return out if totals else [b.filter(b.column("_text").is_valid()) for b in out], t.slice(stop).to_batches()

        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= HELD:
                out, held = flush(False)
                size = sum(x.num_rows for x in held)
                yield from out
        if size:
            yield from flush(True)[0]

    fields = [f"`{c}` {source.schema[c].dataType.simpleString()}" for c in by]
    return source.mapInArrow(run, ", ".join([*fields, "_part long", "_text string", "_grams int", "_c long"]))


def count_runs(runs: DataFrame, n: int, by: Sequence[str], partitions: int, deal: Sequence[str] | None = None) -> DataFrame:
    """``(by..., _part, target, freq)`` of the n-grams in the runs, dealt by
    ``deal`` (default: ``by`` too)."""
    dealt = runs.repartition(partitions, *(by if deal is None else deal), "_part")
    each = dealt.select("*", F.explode(F.sequence(F.lit(1), F.greatest("_grams", F.lit(1)))).alias("_at"))
    inside = F.expr(f"substring_index(substring_index(_text, ' ', _at + {n - 1}), ' ', -{n})")
    target = F.when(F.col("_grams") == 0, F.col("_text")).otherwise(inside)
    return each.select(*by, "_part", target.alias("target"), "_c").groupBy(*by, "_part", "target").agg(F.sum("_c").alias("freq"))
