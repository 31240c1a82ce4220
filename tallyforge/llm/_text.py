"""Vectorised word arithmetic over Arrow string columns (numpy, inside Spark tasks).

Every helper works on whole texts.  A batch is cut into pieces of about ``PIECE`` bytes at
document borders, so the memory of a task is bounded by the piece and by its longest text.
A ``Piece`` holds at most ``PIECE_ROWS`` documents.
Words are runs of bytes outside a separator class; the classes used here only name ASCII bytes,
so working on UTF-8 bytes gives the same words as working on code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
PIECE_ROWS = 2048

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def separator_table(kept: bytes | None = None, dropped: bytes | None = None) -> np.ndarray:
    """256 booleans, true for the bytes that separate words: all but ``kept``, or just ``dropped``."""
    table = np.zeros(256, dtype=bool)
    if kept is not None:
        table[:] = True
        table[np.frombuffer(kept, np.uint8)] = False
    else:
        table[np.frombuffer(dropped or b"", np.uint8)] = True
    return table


#: Words are ``[^\x20\x09-\x0D]+``.
SPACES = separator_table(dropped=b" \t\n\x0b\x0c\r")
#: Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text: letters, digits and every byte over 0x7F.
NON_ALNUM = separator_table(kept=b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_random = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


class _Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, PIECE + 1)
            with np.errstate(over="ignore"):
                self.up = np.concatenate([[_U(1)], np.multiply.accumulate(np.full(size, _BASE, np.uint64))])
                self.down = np.concatenate([[_U(1)], np.multiply.accumulate(np.full(size, pow(_BASE, -1, 1 << 64), np.uint64))])
        return self.up[:n], self.down[:n]


_powers = _Powers()


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; it depends on nothing else."""
    up, down = _powers.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


@dataclass
class Piece:
    """Some whole documents of a batch: rows ``first`` to ``first + n``, their lower-cased bytes and words."""

    first: int
    n: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    #: Index of each document's first word, and one more at the end.
    word_offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.word_offsets)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return span_hashes(self.data, self.starts, self.ends)

    def text(self, a: int, b: int) -> str:
        """Words a to b (exclusive), joined by single spaces."""
        raw = self.data.tobytes() if b - a > 64 else None
        cut = (lambda i: raw[self.starts[i] : self.ends[i]]) if raw else (lambda i: self.data[self.starts[i] : self.ends[i]].tobytes())
        return b" ".join(cut(i) for i in range(a, b)).decode("utf-8", "replace")


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = pc.fill_null(column, "")
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def pieces(column: pa.Array, separators: np.ndarray, lower: bool = True) -> Iterator[Piece]:
    """The documents of a string column in order, in pieces; a null is an empty text."""
    if not len(column):
        return
    data, offsets = _buffers(column)
    first, rows = 0, len(column)
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, "right")) - 1)
        last = min(last, rows, first + PIECE_ROWS)
        own = data[offsets[first] : offsets[last]]
        own = _LOWER[own] if lower else own
        at = offsets[first : last + 1] - offsets[first]
        word = ~separators[own]
        begin, end = word.copy(), word.copy()
        if len(own):
            begin[1:] &= ~word[:-1]
            end[:-1] &= ~word[1:]
            # a word never goes on from one document into the next
            inner = at[1:-1]
            inner = inner[(inner > 0) & (inner < len(own))]
            begin[inner] |= word[inner]
            end[inner - 1] |= word[inner - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        yield Piece(first, last - first, own, at, starts, ends, np.searchsorted(starts, at, "left"))
        first = last


def ngrams(hashes: np.ndarray, word_offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside one document, and the index of each run's first word."""
    counts = np.diff(word_offsets)
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(hashes) - n + 1
    h = hashes[:m].copy()
    for j in range(1, n):
        h = h * _U(_BASE) + hashes[j : j + m]
    ok = np.ones(m, bool)
    ends = np.repeat(word_offsets[1:], counts)[:m]
    ok &= np.arange(m) + n <= ends
    at = np.flatnonzero(ok)
    return mix(h[at] + _U(n)), at


def whole(hashes: np.ndarray) -> np.uint64:
    """The hash that ``ngrams`` gives to a run of all these words."""
    return ngrams(hashes, np.array([0, len(hashes)]), len(hashes))[0][0]
