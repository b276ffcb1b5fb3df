"""Substring deduplication by sliding sentence spans.

A text is cut into sentences at line ends and after . ! ? before white space; sentences of more than LONG words are cut further at
words whose hash is the least of their neighbourhood (equal ones included, so periodic text is cut too), and what is still longer at its
least hash until nothing is, so that equal passages are cut alike wherever they stand, but for a few words at their ends. A passage of
51 words holds a run, wherever it begins: its ends lose LONG words each at most, and a run takes WORDS + LONG at most. Every run of two
or more consecutive sentences is hashed that just reaches WORDS words, counted from its first sentence forward and from its last backward. Runs
are joined globally by hash; the occurrence in the smallest doc_id (and, of texts that share it, the one with the least hash), and
there the earliest, stays, and the sentences of all others are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import checkpoints as scratch
from .textbatch import Chunk, chunks, mix

#: Words that a run has at least, words of a sentence that isn't cut further, and neighbours that decide where a piece ends.
WORDS, LONG, NEAR = 20, 10, 3
_U = np.uint64
_MULT = 0xA24BAED4963EE407
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True
_CLOSES = np.zeros(256, bool)
_CLOSES[[ord(c) for c in "\"')]}"]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_MULT, pow(_MULT, -1, 1 << 64)):
        p = np.full(n, base, _U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Sentences:
    """The sentences of a chunk: sentence s has words begin[s]:end[s], document i has sentences first[i]:first[i + 1]."""

    def __init__(self, chunk: Chunk):
        chunk.find_words()
        self.chunk = chunk
        n = len(chunk.start)
        self.h = chunk.word_hash()
        cut = np.zeros(n + 1, bool)
        cut[chunk.wfirst] = True
        if n:
            lines = np.cumsum(chunk.buf == 10)
            last = chunk.end - 1
            inner = last - (_CLOSES[chunk.buf[last]] & (last > chunk.start))
            cut[1:n] |= (lines[chunk.start[1:]] != lines[chunk.start[:-1]]) | _ENDS[chunk.buf[inner[:-1]]]
            begin = np.flatnonzero(cut[:n])
            size = np.diff(np.append(begin, n))
            cut[1:n] |= self._least(np.repeat(size > LONG, size), np.repeat(np.arange(len(begin)), size))[:-1]
            self._halve(cut)
        self.begin = np.flatnonzero(cut[:n])
        self.end = np.append(self.begin[1:], n)[: len(self.begin)]
        self.first = np.searchsorted(self.begin, chunk.wfirst)

    def _least(self, long: np.ndarray, sentence: np.ndarray) -> np.ndarray:
        """The words of long sentences whose hash isn't above that of the NEAR words on either side, in their sentence."""
        out = long.copy()
        for k in range(1, min(NEAR, len(long) - 1) + 1):
            same = sentence[k:] == sentence[:-k]
            out[k:] &= ~same | (self.h[k:] <= self.h[:-k])
            out[:-k] &= ~same | (self.h[:-k] <= self.h[k:])
        return out

    def _halve(self, cut: np.ndarray) -> None:
        """Cuts pieces of more than LONG words before the word of the least hash among those that leave two words on either side, until
        none is left; of equal hashes the first counts."""
        n = len(self.h)
        while True:
            begin = np.flatnonzero(cut[:n])
            size = np.diff(np.append(begin, n))
            long = np.flatnonzero(size > LONG)
            if not len(long):
                return
            inner = size[long] - 3
            at = np.arange(inner.sum()) + np.repeat(begin[long] + 2 - np.cumsum(inner) + inner, inner)
            least = np.minimum.reduceat(self.h[at], np.cumsum(inner) - inner)
            hit = at[self.h[at] == np.repeat(least, inner)]
            piece = np.searchsorted(begin, hit, "right")
            cut[hit[np.concatenate(([True], piece[1:] != piece[:-1]))]] = True

    def runs(self, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last sentence, hash and document of each run, distinct and in order of document and first sentence."""
        s = np.arange(len(self.begin))
        doc = np.repeat(np.arange(self.chunk.n), np.diff(self.first))
        if not len(s):
            return s, s, np.zeros(0, _U), doc
        ahead = np.maximum(np.searchsorted(self.end, self.begin + words), s + 1)
        back = np.minimum(np.searchsorted(self.begin, self.end - words, "right") - 1, s - 1)
        fits = ahead < self.first[doc + 1]
        reaches = back >= self.first[doc]
        a = np.concatenate((s[fits], back[reaches]))
        b = np.concatenate((ahead[fits], s[reaches]))
        pair = np.sort(a << 31 | b)
        pair = pair[np.concatenate(([True], pair[1:] != pair[:-1]))] if len(pair) else pair
        a, b = pair >> 31, pair & ((1 << 31) - 1)
        up, down = _powers(len(self.h) + 1)
        sums = np.zeros(len(self.h) + 1, _U)
        np.cumsum(self.h * up[:-1], out=sums[1:])
        x, y = self.begin[a], self.end[b]
        return a, b, mix((sums[y] - sums[x]) * down[x] + (y - x).astype(_U)), doc[a]


def text_key(docs: DataFrame) -> Column:
    """What tells texts of one doc_id apart: a hash of the text, or 0 where no two rows of docs (doc_id, text) share a doc_id."""
    once = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() == 0
    return F.lit(0).cast("long") if once else F.xxhash64(F.col("text").cast("string"))


def runs(docs: DataFrame, key: Column) -> DataFrame:
    """doc_id, key t of the text, hash h, first sentence u and last sentence v of each run, and own: true for a later occurrence in
    its own document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for c in chunks(batch.column(2), lower=True):
                s = Sentences(c)
                a, b, h, doc = s.runs()
                order = np.lexsort((a, h, doc))
                again = np.zeros(len(a), bool)
                again[order[1:]] = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
                base = s.first[doc]
                cols = [ids[c.first + doc], texts[c.first + doc], h.view(np.int64), (a - base).astype(np.int32), (b - base).astype(np.int32), again]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["doc_id", "t", "h", "u", "v", "own"])

    kept = docs.where("doc_id is not null and text is not null").select("doc_id", key.alias("t"), "text")
    return kept.mapInArrow(run, "doc_id long, t long, h long, u int, v int, own boolean")


def repeats(docs: DataFrame, key: Column) -> DataFrame:
    """doc_id, t, first_doc_ids (where its removed runs stay, ascending), and cut (struct of first and last sentence, ascending) of every
    document that loses sentences. A document is a doc_id with a text, as ids may be shared."""
    found = scratch.materialize(runs(docs, key), "runs")
    each = found.where("not own").select("doc_id", "t", "h", "u", "v")
    shared = each.groupBy("h").agg(F.min("doc_id").alias("d"), F.max("doc_id").alias("z"), F.min("t").alias("lo"), F.max("t").alias("hi")).where("d < z or lo < hi")
    shared = scratch.materialize(shared.select("h", "d", (F.col("lo") < F.col("hi")).alias("level")), "shared")  # written, so that the join can split a run of very many documents
    met = each.join(shared, "h")
    own = found.where("own").select("doc_id", "t", "u", "v", F.col("doc_id").alias("d"))
    later = met.where("doc_id > d").select("doc_id", "t", "u", "v", "d").unionByName(own)
    if shared.where("level").limit(1).count():  # texts may share the id of the first
        tied = met.where("doc_id = d and level").select("doc_id", "t", "h", "u", "v", "d")
        first = scratch.materialize(tied.groupBy("h").agg(F.min("t").alias("first"), F.max("t").alias("last")).where("first < last").select("h", "first"), "first")
        later = later.unionByName(tied.join(first, "h").where("t > first").select("doc_id", "t", "u", "v", "d"))
    return later.groupBy("doc_id", "t").agg(
        F.array_sort(F.collect_set("d")).alias("first_doc_ids"), F.array_sort(F.collect_set(F.struct("u", "v"))).alias("cut")
    )


def _without(chunk: Chunk, cuts: list) -> tuple[list[bytes], list[int], list[int]]:
    """Each document's bytes without its cut sentences (and the white space after them), its sentences, and how many went."""
    lower = Chunk(chunk.buf, chunk.off, chunk.first, lower=True)
    s = Sentences(lower)
    raw = chunk.buf.tobytes()
    texts, n, gone = [], [], []
    for i in range(chunk.n):
        lo, hi = int(chunk.off[i]), int(chunk.off[i + 1])
        a, b = int(s.first[i]), int(s.first[i + 1])
        n.append(b - a)
        if not cuts[i]:
            texts.append(raw[lo:hi])
            gone.append(0)
            continue
        out = np.zeros(b - a, bool)
        for c in cuts[i]:
            out[c["u"] : c["v"] + 1] = True
        edge = np.append(lower.start[s.begin[a:b]], hi)
        kept = [raw[lo : edge[0]]] + [raw[edge[k] : edge[k + 1]] for k in np.flatnonzero(~out)]
        texts.append(b"".join(kept))
        gone.append(int(out.sum()))
    return texts, n, gone


def apart(docs: DataFrame, name: str) -> str:
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def deduplicated(docs: DataFrame, report: bool = False) -> DataFrame:
    """docs with repeated spans removed from text, all other columns as they are; n_chars, where there is one, follows the text.

    With report, only the documents that lose sentences: doc_id, first_doc_ids, n_sentences, n_removed and text.

    Rows with a null doc_id or a null or empty text are left alone. Repeated rows (equal doc_id and text) are one document: neither
    makes the other lose anything, and both lose the same. Rows that share the doc_id but not the text are documents of their own. Of exact copies all but the first lose every sentence, if they have a run at
    all: texts of one sentence or fewer than WORDS words are never changed. Texts of any length are handled whole; an empty
    table gives an empty result.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key, other, cut = apart(docs, "cut_id"), apart(docs, "cut_text"), apart(docs, "cut")
    told = text_key(own)
    with scratch.scope() as stays:
        found = repeats(own, told).select(F.col("doc_id").alias(key), F.col("t").alias(other), F.col("cut").alias(cut), *([F.col("first_doc_ids")] if report else []))
        found = scratch.materialize(found, "cuts")
        stays.append(found)
    base = own if report else docs
    same = (F.col("doc_id").cast("long") == F.col(key)) & (told == F.col(other))
    ids = found.select(key, other)
    few = ids.count() <= scratch.SMALL  # then only the texts that change are shuffled
    if few:
        both = base.join(F.broadcast(ids), same, "left_semi").join(found, same).drop(key, other)
    else:
        both = base.join(found, same, "inner" if report else "left").drop(key, other)
    names = both.columns
    where = {c.lower(): i for i, c in enumerate(names)}
    schema = "doc_id long, first_doc_ids array<long>, n_sentences int, n_removed int, text string" if report else docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(where["text"])):
                rows = batch.slice(c.first, c.n)
                cuts = rows.column(where[cut]).to_pylist()
                changed = pa.array([bool(x) for x in cuts])
                texts, n, gone = _without(c, cuts)
                new = pa.array(texts, pa.binary()).cast(pa.string())
                if report:
                    cols = [rows.column(where["doc_id"]), rows.column(where["first_doc_ids"]), pa.array(n, pa.int32()), pa.array(gone, pa.int32()), new]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "first_doc_ids", "n_sentences", "n_removed", "text"])
                    continue
                cols = {x: rows.column(i) for x, i in zip(names, range(len(names)), strict=True) if x != cut}
                text = names[where["text"]]
                cols[text] = pa.compute.if_else(changed, new, cols[text].cast(pa.string()))
                if "n_chars" in cols and pa.types.is_integer(cols["n_chars"].type):
                    cols["n_chars"] = pa.compute.if_else(changed, pa.compute.utf8_length(new).cast(cols["n_chars"].type), cols["n_chars"])
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    changed = both.mapInArrow(run, schema)
    return changed if report or not few else docs.join(F.broadcast(ids), same, "left_anti").unionByName(changed)
