"""Texts as flat arrays: words, lines and their 64-bit hashes for a whole chunk of documents at once.

A chunk holds whole documents of about LIMIT bytes together (one document alone where it is longer), so
memory stays bounded by the chunk and every step is one pass over a numpy array. Words are the runs of
bytes outside 0x20 and 0x09-0x0D; null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LIMIT = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, _U), np.ones(1, _U))


def release() -> None:
    """Gives freed memory back to the system after a task that took much of it, as its worker stays for the tasks that follow."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, a bijection of 64-bit words."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, LIMIT + 1)
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, _U)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if size > 4 * LIMIT:  # a very long document: do not hold on to its tables
            return made[0], made[1]
        _powers = (made[0], made[1])
    return _powers


class Chunk:
    """Documents `first` to `first + n` of a batch: bytes `buf`, document i at off[i]:off[i + 1]."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, first: int, lower: bool = False):
        self.buf = _LOWER[buf] if lower else buf
        self.off, self.first, self.n = off, first, len(off) - 1
        self._sums: np.ndarray | None = None

    def find_words(self) -> "Chunk":
        """Sets start, end (bytes) of every word and wfirst: document i has words wfirst[i]:wfirst[i + 1]."""
        size = len(self.buf)
        solid = np.zeros(size + 2, dtype=bool)
        np.logical_not(_SPACE[self.buf], out=solid[1:-1])
        begin = solid[1:] & ~solid[:-1]
        stop = solid[:-1] & ~solid[1:]
        inner = self.off[1:-1]  # a document ends a word, even if the next begins with one
        if len(inner):
            both = solid[inner] & solid[inner + 1]
            begin[inner[both]] = True
            stop[inner[both]] = True
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop)
        self.wfirst = np.searchsorted(self.start, self.off)
        return self

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes of each span."""
        up, down = _powers_to(len(self.buf) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.buf) + 1, _U)
            np.cumsum((self.buf.astype(_U) + _U(1)) * up[: len(self.buf)], out=self._sums[1:])
        h = (self._sums[end] - self._sums[start]) * down[start]
        return mix(h + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))

    def word_hash(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)


def windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of k neighbours within a document, their first positions, and their own `first`."""
    count = np.maximum(np.diff(first) - k + 1, 0)
    wfirst = np.concatenate(([0], np.cumsum(count)))
    if not wfirst[-1]:
        return np.zeros(0, _U), np.zeros(0, np.int64), wfirst
    at = np.arange(wfirst[-1]) + np.repeat(first[:-1] - wfirst[:-1], count)
    full = np.zeros(len(h) - k + 1, _U)
    for j in range(k):
        full *= _U(0xA24BAED4963EE407)
        full += h[j : len(h) - k + 1 + j]
    return mix(full[at]), at, wfirst


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("") if texts.null_count else texts
    if pa.types.is_null(texts.type):
        texts = pa.array([""] * len(texts))
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def chunks(texts: pa.Array, lower: bool = False, limit: int = LIMIT) -> Iterator[Chunk]:
    """The column's documents, whole, in chunks of about `limit` bytes."""
    data, off = text_buffers(texts)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield Chunk(data[off[i] : off[j]], off[i : j + 1] - off[i], i, lower)
        i = j


def per_document(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over documents, 0 for those without any."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]
