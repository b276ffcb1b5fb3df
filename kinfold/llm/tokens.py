"""Token counts of byte-level BPE by rank-synchronous array merging.

Texts are cut into pre-tokens; the distinct ones of a block are held together as one ragged array of symbols. In every round
each sequence finds its lowest-rank pair and all sequences merge theirs at once; sequences without a known pair are done, and
the symbols that are left are the tokens. Counts of pre-tokens are remembered per worker up to a fixed number.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import Chunk, chunks, per_document

#: Pre-tokens that a worker remembers.
SLOTS = 1 << 20
_NONE = np.iinfo(np.int64).max


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is printable Latin-1, else one
    from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Bpe:
    """A vocabulary as arrays: the symbol of each byte, sorted pair keys with their ranks and merged symbols."""

    byte_symbol: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    specials: list[str]
    #: Each symbol comes of one merge only, so that a merge makes no pair of a lower rank than its own, and all places of a
    #: sequence's lowest pair can be merged in one round.
    unique: bool

    @classmethod
    def load(cls, path: str) -> "Bpe":
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError(f"{path}: only byte-level BPE without a normalizer or prefix space")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: special tokens that strip or match words are not supported")
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        byte_symbol = np.zeros(256, np.int64)
        for c, b in printable_bytes().items():
            byte_symbol[b] = vocab[c]
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        return cls(byte_symbol, keys[order], order.astype(np.int64), merged[order], specials, len(set(merged.tolist())) == len(merged))

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; the rank is _NONE for pairs that don't merge."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], _NONE), self.merged[at]

    def count(self, raw: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The number of symbols that are left of each sequence; raw holds their bytes one after the other."""
        out = length.astype(np.int64)
        sym = self.byte_symbol[raw]
        seq = np.repeat(np.arange(len(length)), length)
        if len(sym) < 2:
            return out
        rank = np.full(len(sym), _NONE)  # of the pair that begins at each place
        to = np.zeros(len(sym), np.int64)
        inner = np.flatnonzero(seq[1:] == seq[:-1])
        rank[inner], to[inner] = self.look_up(sym[inner], sym[inner + 1])
        while True:
            starts = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            size = np.diff(np.append(starts, len(sym)))
            lowest = np.minimum.reduceat(rank, starts)
            going = lowest < _NONE
            if not going.all():  # sequences without a pair are done
                keep = np.repeat(going, size)
                sym, seq, rank, to = sym[keep], seq[keep], rank[keep], to[keep]
                size, lowest = size[going], lowest[going]
                starts = np.concatenate(([0], np.cumsum(size)))[:-1]
                if not len(sym):
                    return out
            hit = rank == np.repeat(lowest, size)
            # of places that overlap (aaa), every second from the left; only the first of all where symbols aren't unique
            place = np.flatnonzero(hit)
            run = np.concatenate(([True], np.diff(place) > 1))
            nth = np.arange(len(place)) - np.maximum.accumulate(np.where(run, np.arange(len(place)), 0))
            place = place[nth % 2 == 0]
            if not self.unique:
                place = place[np.concatenate(([True], seq[place][1:] != seq[place][:-1]))]
            sym[place] = to[place]
            np.subtract.at(out, seq[place], 1)
            rank[place] = rank[place + 1]  # there is a pair after the merged one exactly if there was
            keep = np.ones(len(sym), bool)
            keep[place + 1] = False
            now = place - np.arange(len(place))  # where the merged symbols are after the removal
            sym, seq, rank, to = sym[keep], seq[keep], rank[keep], to[keep]
            changed = np.zeros(len(sym), bool)
            changed[now] = changed[np.maximum(now - 1, 0)] = True
            redo = np.flatnonzero(changed[:-1])
            same = seq[redo] == seq[redo + 1]
            rank[redo[~same]] = _NONE
            redo = redo[same]
            rank[redo], to[redo] = self.look_up(sym[redo], sym[redo + 1])
            if now[-1] == len(sym) - 1:
                rank[-1] = _NONE


LETTER, NUMBER, WHITE = 1, 2, 3


@cache
def kinds() -> np.ndarray:
    """The kind of every code point: letter, number, white space or other (0)."""
    table = np.zeros(0x110000, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\p{White_Space}")):
        table[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = kind
    return table


def pre_tokens(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte offsets at which the pre-tokens of the documents off[i]:off[i + 1] of buf begin.

    The pattern splits at changes of kind; the last white space before a word goes with it if it is a blank and stands alone
    if not; a contraction is split off where a single apostrophe stands between a boundary and a letter.
    """
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    point = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
    kind = kinds()[point]
    n = len(point)
    head = np.zeros(n + 1, bool)
    head[np.searchsorted(at, off)] = True
    begins = head.copy()
    begins[1:n] |= kind[1:] != kind[:-1]
    last = np.flatnonzero((kind[:-1] == WHITE) & (kind[1:] != WHITE) & ~head[1:n])
    begins[last] = True
    begins[last[point[last] == 32] + 1] = False
    quote = np.flatnonzero((point[:-1] == 39) & begins[: n - 1] & (kind[1:] == LETTER) & ~head[1:n])
    if len(quote):
        one, two = point[quote + 1], np.where(quote + 2 < n, point[np.minimum(quote + 2, n - 1)], 0)
        two = np.where(head[np.minimum(quote + 2, n)], 0, two)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        begins[quote[short | long] + 1] = False
        begins[quote[short] + 2] = True
        begins[quote[long] + 3] = True
    return at[begins[:n]]


class Counter:
    """Counts tokens of chunks. Counts of pre-tokens are held in a table of fixed size by their hashes; a later one takes the
    place of an earlier one with the same slot."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self.key = np.zeros(SLOTS, np.uint64)
        self.n = np.zeros(SLOTS, np.int64)
        self.specials = [s.encode() for s in bpe.specials]

    def _pieces(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offsets of the pieces between special strings, the document of each piece, and which pieces are special strings."""
        whole = chunk.buf.tobytes() if self.specials else b""
        off, doc = chunk.off, np.arange(chunk.n)
        if not any(s in whole for s in self.specials):
            return off, doc, np.zeros(chunk.n, bool)
        find = re.compile(b"|".join(map(re.escape, self.specials)))
        cuts, docs, special = [0], [], []
        for i in range(chunk.n):
            for m in find.finditer(whole[off[i] : off[i + 1]]):
                cuts += [int(off[i]) + m.start(), int(off[i]) + m.end()]
                docs += [i, i]
                special += [False, True]
            cuts.append(int(off[i + 1]))
            docs.append(i)
            special.append(False)
        return np.array(cuts), np.array(docs), np.array(special)

    def __call__(self, chunk: Chunk) -> np.ndarray:
        if not len(chunk.buf):
            return np.zeros(chunk.n, np.int64)
        off, doc, special = self._pieces(chunk)
        start = pre_tokens(chunk.buf, off)
        end = np.append(start[1:], len(chunk.buf))
        h = chunk.span_hash(start, end)
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        n = np.where(self.key[slot] == h, self.n[slot], 0)
        miss = np.flatnonzero(n == 0)
        if len(miss):
            keys, which, back = np.unique(h[miss], return_index=True, return_inverse=True)
            a, b = start[miss[which]], end[miss[which]]
            length = b - a
            inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            counted = self.bpe.count(chunk.buf[np.repeat(a, length) + inside], length)
            n[miss] = counted[back]
            slot = (keys & np.uint64(SLOTS - 1)).astype(np.int64)
            self.key[slot], self.n[slot] = keys, counted
        first = np.searchsorted(start, off)
        pieces = np.where(special, 1, per_document(n, first))
        return np.bincount(doc, pieces, chunk.n).astype(np.int64)


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row, over whole texts.

    path names the vocabulary's JSON file on the driver. A null or empty text has no bytes and no tokens. Rows are counted one
    by one: repeated rows, null ids and other columns of docs make no difference. An empty table gives an empty result.
    """
    bpe = docs.sparkSession.sparkContext.broadcast(Bpe.load(path))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(bpe.value)
        for batch in batches:
            for c in chunks(batch.column(1)):
                n = count(c)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.first, c.n), pa.array(np.diff(c.off)), pa.array(n), pa.array(n > limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
