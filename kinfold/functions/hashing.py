"""The 32-bit string hash h = 31 h + c, for many strings at once."""

from __future__ import annotations

import numpy as np


def string_hash(items: list[str]) -> np.ndarray:
    """The hash over UTF-16 units as a signed 32-bit value, of each item."""
    raw = [s.encode("utf-16-le") for s in items]
    size = np.array([len(r) // 2 for r in raw], np.int64)
    units = np.frombuffer(b"".join(raw), "<u2").astype(np.uint32)
    first = np.cumsum(size) - size
    h = np.zeros(len(items), np.uint32)
    left = np.flatnonzero(size)
    for k in range(int(size.max()) if len(size) else 0):
        left = left[size[left] > k]
        h[left] = h[left] * np.uint32(31) + units[first[left] + k]
    return h.view(np.int32)


def slots(items: list[str], count: int = 64) -> np.ndarray:
    """The absolute hash modulo count."""
    return np.abs(string_hash(items).astype(np.int64)) % count


def indexed_slots(tokens: list[str], index: np.ndarray, count: int = 64) -> np.ndarray:
    """The slots of each token with its index written after it. The hash of a text put together is that of its head times 31 to the
    tail's length plus the tail's, so each distinct token and index is hashed once."""
    known = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
    heads = string_hash(list(known)).view(np.uint32)[np.array([known[t] for t in tokens], np.int64)] if tokens else np.zeros(0, np.uint32)
    tails = [str(i) for i in range(int(index.max(initial=-1)) + 1)]
    tail, power = string_hash(tails).view(np.uint32), np.array([pow(31, len(t), 1 << 32) for t in tails], np.uint32)
    h = heads * power[index] + tail[index]
    return np.abs(h.view(np.int32).astype(np.int64)) % count
