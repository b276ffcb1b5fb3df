"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

Test items are a stated query set, taken in blocks of bounded size; items of equal words are one. A first pass over the corpus counts
in how many documents each n-gram of the items occurs. Seeds are an item's rarer half of those that occur at all, and every
n-gram below a share of the documents, so an edited or cut copy keeps one. N-grams that many items share are a template and no seed,
unless the item has no other; a passage must hold as much of an item's own words as of all. A second pass finds the seeds in every text and gathers those of one item that lie on
about the same diagonal into a window. Windows that hold too few of the item's words for the score are left; with the others the
item is aligned word by word (local alignment with linear gaps), so edited, cut or paraphrased copies score nearly as high as exact
ones. A copy that keeps no seed whole is not found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import Chunk, chunks, mix, windows

#: Words of a seed (a shorter item is one seed); bytes of item texts in one block; the share of the best possible alignment that a
#: leak reaches, whatever the item's length.
SEED, BLOCK, SCORE = 3, 8 << 20, 0.5
#: N-grams in no more than this share of the documents, or in RARE_ROWS of them, are seeds however their item's others do.
RARE, RARE_ROWS = 0.001, 20
#: N-grams in more than this share of the items, and in more than TEMPLATE_ROWS of them, belong to a template.
TEMPLATE, TEMPLATE_ROWS = 0.01, 8
#: Words of windows that are looked up at once.
LOOKUP = 1 << 18
MATCH, MISMATCH, GAP = 2, -1, -1
_U = np.uint64
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in ".,;:!?\"'()[]{}*#$%&|<>-_"]] = True


def plain_words(chunk: Chunk) -> np.ndarray:
    """Hashes of the chunk's words, A-Z in lower case, without ASCII marks at their ends."""
    chunk.find_words()
    start, end = chunk.start.copy(), chunk.end.copy()
    for _ in range(3):
        some = np.flatnonzero(_MARKS[chunk.buf[start]] & (end - start > 1))
        start[some] += 1
        some = np.flatnonzero(_MARKS[chunk.buf[end - 1]] & (end - start > 1))
        end[some] -= 1
    return chunk.span_hash(start, end)


class Items:
    """A block of test items: words, n-grams, and a table to find n-grams by. Item i has the item_ids owners[i]."""

    def __init__(self, ids: list[int], texts: list[str]):
        c = Chunk(*_flat(texts), 0, lower=True)
        words = plain_words(c)
        same: dict[bytes, int] = {}
        self.owners: list[list[int]] = []
        keep = []
        for i, owner in enumerate(ids):
            own = words[c.wfirst[i] : c.wfirst[i + 1]]
            if len(own):
                k = same.setdefault(own.tobytes(), len(same))
                if k == len(self.owners):
                    self.owners.append([])
                    keep.append(own)
                self.owners[k].append(owner)
        self.words = np.concatenate(keep or [np.zeros(0, _U)])
        size = np.array([len(x) for x in keep], np.int64)
        self.first = np.concatenate(([0], np.cumsum(size)))
        # whole items of fewer than SEED words, then the n-grams of the others; a short gram's hash says its length
        parts = []
        for k in range(1, SEED + 1):
            gram, at, gfirst = windows(self.words, self.first, k)
            item = np.repeat(np.arange(len(size)), np.diff(gfirst))
            some = (size[item] == k) | (k == SEED)
            parts.append((gram[some], item[some], at[some] - self.first[item[some]], np.full(int(some.sum()), k)))
        gram, self.item, self.place, length = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.lengths = [int(k) for k in np.unique(length)]
        self.keys, self.key_of = np.unique(_sized(gram, length), return_inverse=True)
        pair = np.unique(self.key_of * max(len(size), 1) + self.item)
        self.shared = np.bincount(pair // max(len(size), 1), minlength=len(self.keys))  # items that have the key
        template = self.shared[self.key_of] > max(TEMPLATE * len(size), TEMPLATE_ROWS)
        template &= np.isin(self.item, self.item[~template])  # an item of nothing but a template has it for its own
        self.plain = ~template
        covered = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(covered, self.first[self.item[template]] + self.place[template], 1)
        np.subtract.at(covered, self.first[self.item[template]] + self.place[template] + length[template], 1)
        alone = np.cumsum(covered[:-1]) == 0
        # each item's distinct words, and how often it has them, outside the template and at all
        owner = np.repeat(np.arange(len(size)), size)
        self.own_words, which, times = np.unique(_of_item(owner, self.words), return_inverse=True, return_counts=True)
        self.own_times = np.stack([np.bincount(which, alone, len(times)), times])
        self.needed = SCORE * np.stack([np.bincount(owner, alone, len(size)), size])
        self.index(np.ones(len(self.key_of), bool))

    def index(self, some: np.ndarray) -> None:
        """From now on find() looks for those of the items' n-grams alone."""
        order = np.argsort(self.key_of, kind="stable")
        self.by_key = order[some[order]]
        self.by_first = np.searchsorted(self.key_of[self.by_key], np.arange(len(self.keys) + 1))
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.keys[np.diff(self.by_first) > 0] >> _U(42)).astype(np.int64)] = True

    def seed(self, found_in: np.ndarray, n_docs: int) -> None:
        """Keep the seeds, by the number of documents that each key is found in."""
        n = len(self.first) - 1
        times = found_in[self.key_of]
        plain = self.plain & (times > 0)
        order = np.lexsort((times, self.item))
        order = order[plain[order]]
        count = np.bincount(self.item[order], minlength=n)
        half = np.cumsum(count) - count + (count - 1) // 2  # the middle of each item's n-grams in order of rarity
        middle = np.zeros(n, np.int64)
        middle[count > 0] = times[order[half[count > 0]]]
        self.index(plain & (times <= np.maximum(middle[self.item], max(RARE * n_docs, RARE_ROWS))))

    def find(self, chunk: Chunk, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions (words of the chunk) at which a key begins, and the key."""
        places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for length in self.lengths:
            gram, at, _ = windows(words, chunk.wfirst, length)
            gram = _sized(gram, length)
            some = np.flatnonzero(self.bits[(gram >> _U(42)).astype(np.int64)])
            if len(some):
                g = gram[some]
                k = np.minimum(np.searchsorted(self.keys, g), len(self.keys) - 1)
                hit = (self.keys[k] == g) & (self.by_first[k + 1] > self.by_first[k])
                places.append(at[some[hit]])
                found.append(k[hit])
        return np.concatenate(places), np.concatenate(found)

    def enough(self, words: np.ndarray, item: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words[a:b] holds as many of the item's words, in any order, as an alignment that scores enough must match (a match
        adds MATCH, anything else takes away), and the same share of those outside a template."""
        out = np.zeros(len(item), bool)
        cut = np.cumsum(b - a)
        i = 0
        while i < len(item):
            j = max(int(np.searchsorted(cut, (cut[i - 1] if i else 0) + LOOKUP, "right")), i + 1)
            size = b[i:j] - a[i:j]
            window = np.repeat(np.arange(j - i), size)
            at = np.arange(size.sum()) + np.repeat(a[i:j] - np.cumsum(size) + size, size)
            key = _of_item(item[i:j][window], words[at])
            k = np.minimum(np.searchsorted(self.own_words, key), len(self.own_words) - 1)
            hit = self.own_words[k] == key
            pair = np.unique(window[hit] * len(self.own_words) + k[hit])
            held = [np.bincount(pair // len(self.own_words), t[pair % len(self.own_words)], j - i) for t in self.own_times]
            out[i:j] = (held >= self.needed[:, item[i:j]]).all(axis=0)
            i = j
        return out


def _sized(gram: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    return mix(gram + np.asarray(length).astype(_U) * _U(0x9E3779B97F4A7C15))


def _of_item(item: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(words + (item.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15))


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The best local alignment score of each item with its passage, and the word of the passage at which it ends.

    All pairs advance together, a word of each item at a time; gaps along the passage are a running maximum.
    """
    b, m, n = len(items), max(map(len, items)), max(map(len, passages))
    x = np.zeros((b, m), _U)
    y = np.zeros((b, n), _U)
    real_x, real_y = np.zeros((b, m), bool), np.zeros((b, n), bool)
    for i in range(b):
        x[i, : len(items[i])] = items[i]
        real_x[i, : len(items[i])] = True
        y[i, : len(passages[i])] = passages[i]
        real_y[i, : len(passages[i])] = True
    best, end = np.zeros(b, np.int32), np.zeros(b, np.int64)
    row = np.zeros((b, n + 1), np.int32)
    slope = -GAP * np.arange(n + 1, dtype=np.int32)
    for k in range(m):
        same = (y == x[:, k : k + 1]) & real_y & real_x[:, k : k + 1]
        new = np.zeros((b, n + 1), np.int32)
        new[:, 1:] = np.maximum(row[:, :-1] + np.where(same, MATCH, MISMATCH), row[:, 1:] + GAP)
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + slope, axis=1) - slope
        row = np.where(real_x[:, k : k + 1], new, row)
        top = row.argmax(axis=1)
        value = row[np.arange(b), top]
        better = (value > best) & real_x[:, k]
        best[better], end[better] = value[better], top[better]
    return best, end


def _windows_of(items: Items, chunk: Chunk, words: np.ndarray, at: np.ndarray, key: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(document, item, first word, end word, seeds) of every window that seeds of one item point to and that may score enough."""
    times = np.diff(items.by_first)[key]
    pos = np.repeat(at, times)
    inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    which = items.by_key[np.repeat(items.by_first[key], times) + inside]
    item = items.item[which]
    doc = np.searchsorted(chunk.wfirst, pos, "right") - 1
    head = pos - items.place[which]  # where the item would begin
    size = np.diff(items.first)[item]
    order = np.lexsort((head, item, doc))
    doc, item, head, size, which = (v[order] for v in (doc, item, head, size, which))
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (head[1:] - head[:-1] > size[1:])))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    group = np.cumsum(new) - 1
    seeds = np.unique(np.stack([group, which]), axis=1)
    n_seeds = np.bincount(seeds[0], minlength=len(first))
    slack = size[first] // 2 + 4
    a = np.maximum(head[first] - slack, chunk.wfirst[doc[first]])
    b = np.minimum(head[last] + size[first] + slack, chunk.wfirst[doc[first] + 1])
    good = items.enough(words, item[first], a, b)
    return [tuple(int(v) for v in t) for t in zip(doc[first][good], item[first][good], a[good], b[good], n_seeds[good], strict=True)]


def _align_all(items: Items, words: np.ndarray, found: list[tuple[int, int, int, int, int]]) -> Iterator[tuple[int, int, float, int, int, int]]:
    """(document, item, score, seeds, first and end word of the window's aligned part) of the windows that score enough."""
    found.sort(key=lambda f: (f[3] - f[2], f[1]))
    i = 0
    while i < len(found):
        j, cells = i, 0
        while j < len(found) and (j == i or cells < 1 << 18):
            cells += found[j][3] - found[j][2]
            j += 1
        part = found[i:j]
        own = [items.words[items.first[f[1]] : items.first[f[1] + 1]] for f in part]
        best, end = align(own, [words[f[2] : f[3]] for f in part])
        for f, x, s, e in zip(part, own, best.tolist(), end.tolist(), strict=True):
            score = s / (MATCH * len(x))
            if score >= SCORE:
                yield f[0], f[1], score, f[4], f[2], f[2] + e
        i = j


def item_blocks(items: DataFrame) -> Iterator[Items]:
    """The items (item_id, text) in blocks of about BLOCK bytes, streamed through the driver one partition at a time."""
    ids, texts, size = [], [], 0
    for r in items.where("item_id is not null and text is not null").select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += len(texts[-1])
        if size >= BLOCK:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, texts)


def seeded_blocks(texts: DataFrame, items: DataFrame) -> Iterator[Items]:
    """The blocks of items with their seeds chosen by the n-grams' document counts in texts (text). A count for each n-gram of a
    block reaches the driver."""
    n_docs = -1
    for block in item_blocks(items):
        if not len(block.keys):
            continue
        n_docs = texts.count() if n_docs < 0 else n_docs
        shared = texts.sparkSession.sparkContext.broadcast(block)  # bounded by the block

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            total = np.zeros(len(block.keys), np.int64)
            for batch in batches:
                for c in chunks(batch.column(0), lower=True):
                    at, key = block.find(c, plain_words(c))
                    pair = np.unique((np.searchsorted(c.wfirst, at, "right") - 1) * len(total) + key)
                    total += np.bincount(pair % len(total), minlength=len(total))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["key", "n"])

        rows = texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
        found_in = np.zeros(len(block.keys), np.int64)
        found_in[rows.column("key").to_numpy()] = rows.column("n").to_numpy()
        shared.destroy()
        block.seed(found_in, n_docs)
        if len(block.by_key):
            yield block


def _leaks_in(items: Items, c: Chunk) -> list[tuple[int, int, float, int, int, int]]:
    words = plain_words(c)
    at, key = items.find(c, words)
    if not len(at):
        return []
    found = list(_align_all(items, words, _windows_of(items, c, words, at, key)))
    return [(d, i, s, n, int(a - c.wfirst[d]), int(b - c.wfirst[d])) for d, i, s, n, a, b in found]


_LEAK = "doc_id long, item_id long, score double, n_seeds int, first_word int, end_word int"


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, score (1: every word of the item in order), n_seeds, first_word and end_word (of the window up to the
    alignment's end) for the best alignment of each leaked item in each document of docs.

    Rows of docs with a null doc_id or text, and items with a null id or text or without words, give nothing. Repeated
    rows of either table count once. Items that share an item_id but not the text are separate, and the best of them counts. Texts
    are read whole; empty tables give empty results. Other columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    tests = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], _LEAK)
    for block in seeded_blocks(own.select("text"), tests):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # bounded by the block

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for c in chunks(batch.column(1), lower=True):
                    found = [(f[0], owner, *f[2:]) for f in _leaks_in(shared.value, c) for owner in shared.value.owners[f[1]]]
                    if found:
                        doc, item, *rest = zip(*found, strict=True)
                        ids = batch.column(0).take(pa.array(np.array(doc) + c.first))
                        cols = [ids, pa.array(item, pa.int64()), pa.array(rest[0], pa.float64()), *(pa.array(v, pa.int32()) for v in rest[1:])]
                        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "score", "n_seeds", "first_word", "end_word"])

        out = out.unionByName(own.mapInArrow(run, _LEAK))
    best = F.max(F.struct("score", "n_seeds", -F.col("first_word"), -F.col("end_word"))).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", F.col("b.score"), F.col("b.n_seeds"), (-F.col("b.col3")).alias("first_word"), (-F.col("b.col4")).alias("end_word")
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, whose text holds no leaked item; as leaks(), but rows without a doc_id count too."""
    tests = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    names, schema, out = docs.columns, docs.schema, docs
    for block in seeded_blocks(docs.select(F.col("text").cast("string").alias("text")), tests):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for c in chunks(batch.column(names.index("text")), lower=True):
                    keep = np.ones(c.n, bool)
                    keep[[f[0] for f in _leaks_in(shared.value, c)]] = False
                    yield batch.slice(c.first, c.n).filter(pa.array(keep))

        out = out.mapInArrow(run, schema)
    return out
