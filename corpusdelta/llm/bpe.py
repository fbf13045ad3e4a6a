"""Byte-level BPE encoding and decoding (operator 1).

Method: the vocabulary's byte strings, read as Latin-1, form a pyahocorasick
trie, which gives the longest token that begins at a byte. The encoder takes
it, checks that it may stand next to the token before it, else falls back to
the token's longest prefix that is a token, and steps back over the last token
when none is left. Two tokens may be neighbours if merging never crosses their
border (``_Encoder.compatible``, memoised). A worker that has ended a task
remembers little (``RESTING``): it idles through other stages. Every byte position is given up at
most once, so the work is linear in the text, and the ids equal those of
rank-ordered merging.

Defined cases: a null text encodes as the empty text (no ids, empty decoded
bytes); texts of any length are encoded whole; repeated rows and null document
ids give one row each; an empty table gives an empty result; only the named
input columns are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusdelta.llm.pretokenize import Memo, split

#: Bound of the memory of neighbour checks, in pairs.
PAIRS_KEPT = 1 << 19
#: Pre-tokens and pairs that a worker may remember between two tasks.
RESTING = 1 << 16


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a rank file (base64 token and rank a line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class _Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        size = max(ranks.values()) + 1
        self.token = [b""] * size
        for token, i in ranks.items():
            self.token[i] = token
        self.length = [len(t) for t in self.token]
        self.id_of = {t.decode("latin-1"): i for t, i in ranks.items()}
        self.trie = ahocorasick.Automaton()
        for text, i in self.id_of.items():
            self.trie.add_word(text, i)
        self.reach = max(self.length)
        self.shorter = [self._prefix(t.decode("latin-1")) for t in self.token]
        self.parts = [(i, i) for i in range(size)]  # a token that no merge makes has itself as both parts
        self.merged: dict[tuple[int, int], int] = {}
        for i in sorted(ranks.values()):
            self._derive_merge(i)
        self.pairs: dict[int, bool] = {}
        self.memo = Memo(lambda piece: array("i", self.encode_bytes(piece.encode())).tobytes())
        self.decimal = [str(i) for i in range(size)]

    def _prefix(self, text: str) -> int:
        """The longest token that is a proper prefix of ``text``, -1 if none."""
        for end in range(len(text) - 1, 0, -1):
            i = self.id_of.get(text[:end])
            if i is not None:
                return i
        return -1

    def _derive_merge(self, i: int) -> None:
        """Find the pair of earlier tokens whose merge made token ``i``."""
        text, left = self.token[i].decode("latin-1"), self.shorter[i]
        while left >= 0:
            right = self.id_of.get(text[self.length[left]:])
            if right is not None and left < i and right < i and self._compatible(left, right):
                self.merged[left, right] = i
                self.parts[i] = (left, right)
                return
            left = self.shorter[left]

    def compatible(self, left: int, right: int) -> bool:
        """``_compatible`` with a memory of bounded size."""
        pair = left << 32 | right
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            known = self.pairs[pair] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging keeps ``left`` and ``right`` apart: undo the merges
        of both in turn, latest first; none of the pairs that meet at the
        border may have a merge that comes before the merge that was undone."""
        before = len(self.token) + 1
        while True:
            made = self.merged.get((left, right))
            if made is not None and made < before:
                return False
            if left > right:
                before, left = left, self.parts[left][1]
                if left == before:
                    before, right = right + 1, self.parts[right][0]
                    if right + 1 == before:
                        return True
            else:
                before, right = right + 1, self.parts[right][0]
                if right + 1 == before:
                    before, left = left, self.parts[left][1]
                    if left == before:
                        return True

    def longest(self, text: str, at: int) -> int:
        """The longest token that begins at ``at``."""
        ahead = text[at:at + self.reach]
        for end in range(self.trie.longest_prefix(ahead), 0, -1):
            i = self.id_of.get(ahead[:end])
            if i is not None:
                return i
        raise ValueError("the vocabulary lacks a byte of the text")

    def encode_bytes(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        text = piece.decode("latin-1")
        n, length, shorter = len(text), self.length, self.shorter
        whole = self.id_of.get(text)
        if whole is not None or not n:
            return [whole] if n else []
        may_end = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, self.longest(text, 0)
        while True:
            end = at + length[token]
            if may_end[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                if end == n:
                    return out
                at, token = end, self.longest(text, end)
            elif shorter[token] >= 0:
                token = shorter[token]
            else:  # no token fits here: the border before it is wrong
                may_end[at] = 0
                token = out.pop()
                at -= length[token]

    def rest(self) -> None:
        """Give back what was remembered if it is much; the end of a task."""
        self.memo.rest(RESTING)
        if len(self.pairs) > RESTING:
            self.pairs = {}

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, each pre-token on its own."""
        return np.frombuffer(b"".join(map(self.memo.__getitem__, split(text))), dtype="<i4")

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(4)
def encoder(path: str) -> _Encoder:
    """The encoder of a rank file, built once in each Python worker."""
    return _Encoder(load_ranks(path))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id column and ``ids`` array<int>."""
    def run(batches):
        enc = encoder(path)
        for b in batches:
            ids = [enc.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(ids)], names=[id_col, "ids"])
        enc.rest()

    source = _narrow(docs, id_col, text_col)
    return source.mapInArrow(run, f"{_typed(source, id_col)}, ids array<int>")


def decode(docs: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per document: the id column and ``decoded`` binary (the bytes of
    the ids; null ids: empty). Ids outside the vocabulary raise."""
    def run(batches):
        enc = encoder(path)
        for b in batches:
            out = [enc.decode(ids or ()) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=[id_col, "decoded"])

    source = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{ids_col}`").alias("ids"))
    return source.mapInArrow(run, f"{_typed(source, id_col)}, decoded binary")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode its ids again, and return the digests of both
    instead of the bulky values: the id column, ``n_tokens``, ``ids_sha256``
    (decimal ids joined by one blank) and ``decoded_sha256`` (decoded bytes)."""
    def run(batches):
        enc = encoder(path)
        for b in batches:
            sizes, id_digests, text_digests = [], [], []
            for t in b.column(1).to_pylist():
                ids = enc.encode(t or "").tolist()
                sizes.append(len(ids))
                id_digests.append(hashlib.sha256(" ".join(map(enc.decimal.__getitem__, ids)).encode()).hexdigest())
                text_digests.append(hashlib.sha256(enc.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(id_digests, pa.string()),
                 pa.array(text_digests, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
        enc.rest()

    source = _narrow(docs, id_col, text_col)
    return source.mapInArrow(
        run, f"{_typed(source, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.astype(np.int32), pa.int32()))


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").cast("string").alias("text"))


def _typed(df: DataFrame, name: str) -> str:
    return f"`{name}` {df.schema[name].dataType.simpleString()}"
