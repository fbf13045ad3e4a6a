"""SentencePiece encoding and decoding of merge-type (BPE) models (operator 12).

Method: an Aho-Corasick automaton over the pieces gives the longest piece that
begins at every character. The encoder takes it, checks that it may follow the
piece before it, else falls back to the next shorter piece that begins there,
and steps back over the last piece when none is left; a bitfield keeps the
positions that failed. Two pieces may be neighbours if merging their joined
text anew gives these two again (``_Encoder.compatible``, memoised). Merging is
by score and then from the left, and a merge inside two neighbours never
depends on text beyond them, so a segmentation whose neighbours all pass is the
one that merging the whole text gives. A prefix has one such segmentation, so a
position fails at most once and the work is linear in the text.

A text is cut first where no piece can cross: at characters that occur in no
longer piece and, if the vocabulary has no piece with a blank after another
character, before blanks. The cuts change no result, and equal stretches are
encoded once for each worker's memory.

Characters outside the vocabulary become byte pieces (the unknown id where the
model has none). Models with a normaliser that changes texts, or with unused
pieces, are refused.

Defined cases: a null text encodes as the empty text (no ids, decoded empty);
texts of any length are encoded whole; repeated rows and null document ids give
one row each; an empty table gives an empty result; only the named input
columns are read, so further columns of any name do no harm; null ids decode to
the empty text, ids outside the vocabulary raise.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusdelta.llm.pretokenize import Memo

#: The sign for a blank inside pieces.
BLANK = "▁"
#: Bound of the memory of neighbour checks, in pairs.
PAIRS_KEPT = 1 << 19


class _Encoder:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        if model.normalize(" a  é ") != f"{BLANK}{BLANK}a{BLANK}{BLANK}é{BLANK}" or any(map(model.is_unused, ids)):
            raise ValueError("the model changes texts before merging, or has unused pieces")
        self.piece = [model.id_to_piece(i) for i in ids]
        self.unknown, self.unknown_text = model.unk_id(), model.decode([model.unk_id()]).encode()
        self.control = {i for i in ids if model.is_control(i)}
        byte_ids = {i for i in ids if model.is_byte(i)}
        self.byte = {int(self.piece[i][1:-1], 16): i for i in byte_ids}
        self.score = {self.piece[i]: model.get_score(i) for i in ids
                      if i not in byte_ids and i not in self.control and i != self.unknown}
        self.id_of = {self.piece[i]: i for i in ids if self.piece[i] in self.score}
        self.raw = [self._surface(i, byte_ids) for i in ids]
        self.automaton = ahocorasick.Automaton()
        for text, i in self.id_of.items():
            self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        self.shorter = [self._prefix(text) for text in self.piece]
        self.sound = [text in self.id_of and self.remerge(text) == [text] for text in self.piece]
        self.pairs: dict[int, bool] = {}
        self.stretch = self._stretches()
        self.memo = Memo(lambda text: array("i", self.encode_stretch(text)).tobytes())
        self.decimal = [str(i) for i in ids]

    def _surface(self, i: int, byte_ids: set[int]) -> bytes:
        if i in byte_ids:
            return bytes([int(self.piece[i][1:-1], 16)])
        if i == self.unknown:
            return self.unknown_text
        return b"" if i in self.control else self.piece[i].replace(BLANK, " ").encode()

    def _prefix(self, text: str) -> int:
        """The longest piece that is a proper prefix of ``text``, -1 if none."""
        return next((self.id_of[text[:end]] for end in range(len(text) - 1, 0, -1) if text[:end] in self.id_of), -1)

    def _stretches(self) -> re.Pattern:
        """Pattern of the stretches between places that no piece crosses."""
        joined = {c for text in self.score if len(text) > 1 for c in text}
        others = "".join(map(re.escape, sorted(joined - {BLANK})))
        if any(BLANK in text.lstrip(BLANK) for text in self.score):
            return re.compile(f"[{BLANK}{others}]+|.", re.S)
        return re.compile(f"{BLANK}+[{others}]*|[{others}]+|." if others else f"{BLANK}+|.", re.S)

    def remerge(self, text: str) -> list[str]:
        """Merge the characters of ``text``: the pair whose joined text has the
        highest score first, of equal scores the leftmost."""
        part, after = list(text), list(range(1, len(text) + 1))
        before = list(range(-1, len(text) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < len(part):
                score = self.score.get(part[left] + part[right])
                if score is not None:
                    heapq.heappush(heap, (-score, left, right, part[left] + part[right]))

        for i in range(len(part) - 1):
            offer(i, i + 1)
        while heap:
            _, left, right, joined = heapq.heappop(heap)
            if not part[left] or not part[right] or part[left] + part[right] != joined or after[left] != right:
                continue  # one of the two has been merged meanwhile
            part[left], part[right] = joined, ""
            after[left] = after[right]
            if after[left] < len(part):
                before[after[left]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [p for p in part if p]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined text of two pieces gives the two again."""
        pair = left << 32 | right
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            two = [self.piece[left], self.piece[right]]
            known = self.pairs[pair] = self.remerge("".join(two)) == two
        return known

    def encode_stretch(self, text: str) -> list[int]:
        """Ids of a stretch whose borders no piece crosses."""
        whole = self.id_of.get(text)
        if whole is not None and self.sound[whole]:
            return [whole]
        n = len(text)
        if n == 1:
            return [self.byte[b] for b in text.encode()] if self.byte else [self.unknown]
        longest = [-1] * n
        for end, (i, length) in self.automaton.iter(text):
            longest[end - length + 1] = i  # ends ascend, so the longest of a start comes last
        failed, piece, shorter = bytearray((n >> 3) + 1), self.piece, self.shorter
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            while token >= 0:
                end = at + len(piece[token])
                if not failed[end >> 3] >> (end & 7) & 1 and (self.compatible(out[-1], token) if out else self.sound[token]):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
            elif longest[at] < 0:  # a single character that is no piece, between pieces
                raise ValueError("a character of longer pieces is no piece itself")
            else:  # nothing fits here: the border before it is wrong
                failed[at >> 3] |= 1 << (at & 7)
                token = out.pop()
                at -= len(piece[token])
                token = shorter[token]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        if not text:
            return np.empty(0, "<i4")
        marked = BLANK + text.replace(" ", BLANK)
        return np.frombuffer(b"".join(map(self.memo.__getitem__, self.stretch.findall(marked))), dtype="<i4")

    def decode(self, ids) -> bytes:
        """UTF-8 of the text that ``ids`` stand for: the blank that encoding put
        in front goes, and a byte that is part of no character becomes U+FFFD
        (control ids stand for nothing, but part the bytes around them)."""
        if not self.control.isdisjoint(ids):
            border = [-1, *(k for k, i in enumerate(ids) if i in self.control), len(ids)]
            runs = [run for a, b in zip(border, border[1:]) if (run := ids[a + 1:b])]
            return b"".join(self._decode_run(run, first=k == 0) for k, run in enumerate(runs))
        return self._decode_run(ids, first=True)

    def _decode_run(self, ids, first: bool) -> bytes:
        joined = b"".join(map(self.raw.__getitem__, ids))
        if first and len(ids) and self.piece[ids[0]].startswith(BLANK):
            joined = joined[1:]
        try:
            joined.decode()
            return joined
        except UnicodeDecodeError:
            return self._mended(joined)

    @staticmethod
    def _mended(joined: bytes) -> bytes:
        out, at = [], 0
        while at < len(joined):
            try:
                out.append(joined[at:].decode())
                break
            except UnicodeDecodeError as e:
                out += [joined[at:at + e.start].decode(), "�"]
                at += e.start + 1
        return "".join(out).encode()


@lru_cache(4)
def encoder(path: str) -> _Encoder:
    """The encoder of a model file, built once in each Python worker."""
    return _Encoder(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id column and ``ids`` array<int>."""
    def run(batches):
        enc = encoder(path)
        for b in batches:
            ids = [enc.encode(t or "") for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            values = np.concatenate([np.empty(0, np.int32), *ids]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[id_col, "ids"])

    source = _narrow(docs, id_col, F.col(f"`{text_col}`").cast("string"))
    return source.mapInArrow(run, f"{_typed(source, id_col)}, ids array<int>")


def decode(docs: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per document: the id column and ``decoded`` string."""
    def run(batches):
        enc = encoder(path)
        for b in batches:
            out = [enc.decode(ids or ()).decode() for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[id_col, "decoded"])

    source = _narrow(docs, id_col, F.col(f"`{ids_col}`"))
    return source.mapInArrow(run, f"{_typed(source, id_col)}, decoded string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode its ids again, and return the digests of both
    instead of the bulky values: the id column, ``n_tokens``, ``ids_sha256``
    (decimal ids joined by commas) and ``decoded_sha256`` (UTF-8 of the decoded
    text)."""
    def run(batches):
        enc = encoder(path)
        for b in batches:
            sizes, id_digests, text_digests = [], [], []
            for t in b.column(1).to_pylist():
                ids = enc.encode(t or "").tolist()
                sizes.append(len(ids))
                id_digests.append(hashlib.sha256(",".join(map(enc.decimal.__getitem__, ids)).encode()).hexdigest())
                text_digests.append(hashlib.sha256(enc.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(id_digests, pa.string()),
                 pa.array(text_digests, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    source = _narrow(docs, id_col, F.col(f"`{text_col}`").cast("string"))
    return source.mapInArrow(
        run, f"{_typed(source, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _narrow(docs: DataFrame, id_col: str, value) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias(id_col), value.alias("_value"))


def _typed(df: DataFrame, name: str) -> str:
    return f"`{name}` {df.schema[0].dataType.simpleString()}"
