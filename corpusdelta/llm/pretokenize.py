"""Vectorised pre-token splitting for byte-level BPE vocabularies.

``split`` gives exactly the matches of ``public_tokenizers.PATTERN`` (letters,
numbers, other characters, each with one leading blank; English contractions;
white space), found from the character classes of a whole text at once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

OTHER, LETTER, NUMBER, SPACE, BORDER = 0, 1, 2, 3, 4
BLANK, APOSTROPHE = 32, 39
#: The contractions of the pattern, without the apostrophe.
ONE_LETTER = frozenset("stmd")
TWO_LETTERS = frozenset(("re", "ve", "ll"))


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point, read from the regex library's tables."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for lo, hi in ((0, 0xD800), (0xE000, 0x110000)):  # surrogates are never in valid text
        chars = "".join(map(chr, range(lo, hi)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, chars):
                table[lo + m.start():lo + m.end()] = kind
    return table


def library_classes(pre_tokenizer) -> np.ndarray:
    """Class of every code point as a byte-level pre-tokenizer of the
    tokenizers library takes it; its tables are of another Unicode version than
    those of the regex library. Beyond ASCII its pieces of all code points in
    order are runs of one class, so one probe tells the class of a piece."""
    table = np.zeros(0x110000, dtype=np.uint8)

    def kind(char):
        for like, probe in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            if len(pre_tokenizer.pre_tokenize_str(probe + char)) == 1:
                return like
        return SPACE

    for point in range(128):
        table[point] = kind(chr(point))
    for lo, hi in ((128, 0xD800), (0xE000, 0x110000)):
        for _, (a, b) in pre_tokenizer.pre_tokenize_str("".join(map(chr, range(lo, hi)))):
            table[lo + a:lo + b] = kind(chr(lo + a))
    return table


def split(text: str, table: np.ndarray | None = None) -> list[str]:
    """The pre-tokens of ``text`` in order; they concatenate to it. ``table``
    has the class of every code point (default: ``classes()``)."""
    n = len(text)
    if n == 0:
        return []
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    kind = (classes() if table is None else table)[points]
    start = np.empty(n, dtype=bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    blank = kind == SPACE
    # the last white-space character before a word is cut off; a blank joins the word
    last = np.flatnonzero(blank[:-1] & ~blank[1:])
    start[last] = True
    start[last[points[last] == BLANK] + 1] = False
    for i in np.flatnonzero(points == APOSTROPHE).tolist():
        if start[i] and i + 1 < n:
            size = 1 if text[i + 1] in ONE_LETTER else 2 if text[i + 1:i + 3] in TWO_LETTERS else 0
            if size:
                start[i + 1] = False
                if i + 1 + size < n:
                    start[i + 1 + size] = True
    at = np.flatnonzero(start).tolist()
    ends = at[1:]
    ends.append(n)
    return [text[a:b] for a, b in zip(at, ends)]


def split_many(texts: list[str], table: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
    """``split`` of many texts in one pass: all their pre-tokens in order as one
    Arrow string array, and how many each text has."""
    joined = "\0".join(texts)
    if not joined:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    n = len(points)
    border = np.cumsum([len(t) + 1 for t in texts])[:-1] - 1  # places between texts
    kind = (classes() if table is None else table)[points]
    kind[border] = BORDER
    start = np.empty(n, dtype=bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start[border] = True
    start[border[border + 1 < n] + 1] = True
    blank = kind == SPACE
    last = np.flatnonzero(blank[:-1] & ~blank[1:] & (kind[1:] != BORDER))
    start[last] = True
    start[last[points[last] == BLANK] + 1] = False
    for i in np.flatnonzero((points == APOSTROPHE) & (kind != BORDER)).tolist():
        if start[i] and i + 1 < n:
            size = 1 if joined[i + 1] in ONE_LETTER else 2 if joined[i + 1:i + 3] in TWO_LETTERS else 0
            if size:
                start[i + 1] = False
                if i + 1 + size < n:
                    start[i + 1 + size] = True
    at = np.flatnonzero(start)
    width = np.ones(n, np.int64)
    for least in (0x80, 0x800, 0x10000):
        width += points >= least
    byte = np.zeros(n + 1, np.int64)
    np.cumsum(width, out=byte[1:])
    offsets = np.append(byte[at], byte[n]).astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(joined.encode()))
    own = kind[at] != BORDER
    text = np.searchsorted(border, at[own], side="right")
    return pieces.filter(pa.array(own)), np.bincount(text, minlength=len(texts))


class Memo(dict):
    """``memo[key]`` computes what is missing and keeps at most ``2 * size``
    entries in two generations, so frequent keys stay and rare ones go."""

    def __init__(self, compute, size: int = 400_000):
        super().__init__()
        self.compute, self.size, self.older = compute, size, {}

    def rest(self, kept: int) -> None:
        """Forget everything if it is more than ``kept`` entries, so that an idle
        worker, whose memory other stages need, holds little. Entries that
        stayed would keep the pages of those that went."""
        if len(self) + len(self.older) > kept:
            self.older = {}
            self.clear()

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= 64:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value
