"""Plain versions of operators, over dictionaries and loops, to compare results with."""

import re

import numpy as np
import pyarrow as pa

from kinfold.llm import decontam, spans
from kinfold.llm.textbatch import Chunk, chunks

WORD = re.compile("[^\x20\x09-\x0d]+")


def pieces(text):
    """The sentences of a text as (first byte, lower-case words); cuts inside long sentences are the operator's, as they follow its hashes."""
    (c,) = chunks(pa.array([text]), lower=True)
    s = spans.Sentences(c)
    raw = bytes(c.buf)
    return [(int(c.start[a]), [raw[c.start[w] : c.end[w]] for w in range(a, b)]) for a, b in zip(s.begin, s.end, strict=True)]


def runs(own):
    """(first, last) of every run of two or more pieces that just reaches WORDS words from its first on, or from its last back."""
    size = [len(w) for _, w in own]
    found = set()
    for a in range(len(own)):
        b = a
        while b < len(own) and (b == a or sum(size[a : b + 1]) < spans.WORDS):
            b += 1
        if b < len(own):
            found.add((a, b))
        b = a
        while b >= 0 and (b == a or sum(size[b : a + 1]) < spans.WORDS):
            b -= 1
        if b >= 0:
            found.add((b, a))
    return sorted(found)


def deduplicated(rows):
    """The texts of rows (distinct doc_id, text) without the sentences of repeated runs, but for the first."""
    cut = {i: pieces(t) if t else [] for i, t in rows}
    first: dict[bytes, tuple[int, int]] = {}
    own = {i: [(b" ".join(w for _, ws in cut[i][a : b + 1] for w in ws), a, b) for a, b in runs(cut[i])] for i, _ in rows}
    for i, _ in sorted(rows, key=lambda r: r[0]):
        for key, a, _ in own[i]:
            first.setdefault(key, (i, a))
    out = {}
    for i, t in rows:
        gone = {k for key, a, b in own[i] if first[key] != (i, a) for k in range(a, b + 1)}
        if not gone:
            out[i] = t
            continue
        raw = t.encode()
        edge = [p for p, _ in cut[i]] + [len(raw)]
        out[i] = (raw[: edge[0]] + b"".join(raw[edge[k] : edge[k + 1]] for k in range(len(cut[i])) if k not in gone)).decode()
    return out


def words_of(text):
    return decontam.plain_words(Chunk(*decontam._flat([text]), 0, lower=True))


def leaks(docs, items):
    """(doc_id, item_id) of every pair whose full alignment scores SCORE or more."""
    ys = [(i, words_of(t)) for i, t in docs if t]
    found = set()
    for item, text in items:
        x = words_of(text)
        long = [(i, y) for i, y in ys if len(y)]
        for k in range(0, len(long), 100):
            part = long[k : k + 100]
            best, _ = decontam.align([x] * len(part), [y for _, y in part])
            found |= {(part[j][0], item) for j in np.flatnonzero(best >= decontam.SCORE * decontam.MATCH * len(x))}
    return found
