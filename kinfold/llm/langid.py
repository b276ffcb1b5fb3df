"""Language identification by interpolated Kneser-Ney character language models.

For every language an interpolated Kneser-Ney model of ORDER characters is learned from a bounded sample. All models share
one set of sorted hash arrays: for each n-gram that any language has seen, its hash and the log probability under every
language, back-off included; for each history, every language's back-off weight. A text is looked up once, its score in a
language is the cross-entropy per character, and the lowest wins.

A text is rejected if even that cross-entropy is too far above the middle of the language. How far is an exact upper quantile of
calibration rows, which the scoring model has not learned: of m such rows the limit is the k-th highest, k = RATE * (m + 1) in whole
numbers but 1 at least, so a further row of their kind is above it with probability k / (m + 1) at most. The kind is language and
length class, or the language where that class has too few rows for k to be 2, as one row with a wrong label must not be the limit. A
language with too few itself has the higher of its own limit and that of all languages' rows together. The calibration rows of a language are set aside; one with few rows learns from
all of them, and each is scored by a model of the others.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbatch import Chunk, chunks, mix, release

ORDER = 4
#: Rows of each language, and of all, that learning reads at most, about. A language's model is of LEARN of its rows, or half where there
#: are fewer; the others are set aside. Of a text of more than PART characters learning reads that many, from a place that a hash chooses.
SAMPLE, ROWS, LEARN, PART = 2800, 16_000, 800, 4000
#: The share of a language's own texts that calibration lets be rejected.
RATE = 0.002
#: A language with fewer rows is split into this many folds, each scored by a model of the others.
FEW, FOLDS = 100, 4
#: Letters at which a new length class begins.
LENGTHS = (200, 2000)
#: Letters that are told apart, the most frequent ones; all others are one symbol.
LETTERS = 4000
UNKNOWN = "und"
_U = np.uint64


@cache
def folded() -> np.ndarray:
    """Every code point's lower-case letter; 0 for what isn't a letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def letters(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The chunk's texts as folded letters, runs of anything else as one 0, with ORDER - 1 zeros before each document; and
    where each document's letters begin (its own zeros before that), with the end of all."""
    point = np.frombuffer(chunk.buf.tobytes().decode().encode("utf-32-le"), np.uint32)
    at = np.concatenate(([0], np.cumsum((chunk.buf & 0xC0) != 0x80)))
    off = at[chunk.off]
    sym = folded()[point]
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != 0) | (sym[:-1] != 0)
    begins = off[:-1][off[:-1] < off[1:]]
    keep[begins] = sym[begins] != 0  # the zeros before a document stand for what isn't a letter at its head
    kept = np.concatenate(([0], np.cumsum(keep)))[off]
    pad = ORDER - 1
    first = kept + pad * np.arange(1, chunk.n + 2)
    out = np.zeros(len(sym[keep]) + pad * chunk.n, np.uint32)
    doc = np.repeat(np.arange(chunk.n), np.diff(kept))
    out[np.arange(kept[-1]) + pad * (doc + 1)] = sym[keep]
    return out, first


def grams(ids: np.ndarray, k: int) -> np.ndarray:
    """The k-gram that ends at each place from ORDER - 1 on, packed into 64 bits."""
    key = np.zeros(len(ids) - ORDER + 1, _U)
    for j in range(k):
        key = key << _U(16) | ids[ORDER - k + j : len(ids) - k + 1 + j].astype(_U)
    return key


def symbol_ids(sym: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Places in symbols from 1 on, 0 for what isn't a letter, one more than all for other letters."""
    if not len(symbols):
        return (sym != 0).astype(np.uint16)
    at = np.minimum(np.searchsorted(symbols, sym), len(symbols) - 1)
    return np.where(sym == 0, 0, np.where(symbols[at] == sym, at + 1, len(symbols) + 1)).astype(np.uint16)


class HashArray:
    """Sorted hashes with an index of their leading bits, and a row of values for each."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        h = mix(keys.copy())
        order = np.argsort(h)
        self.h, self.values = h[order], np.ascontiguousarray(values[order], np.float32)
        bits = max(4, int(len(h)).bit_length() + 1)
        self.shift = _U(64 - bits)
        self.index = np.searchsorted(self.h >> self.shift, np.arange((1 << bits) + 1, dtype=_U)).astype(np.int32)
        self.deepest = int(np.diff(self.index).max()) if len(h) else 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 if there is none."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.h):
            return out
        h = mix(keys.copy())
        slot = (h >> self.shift).astype(np.int64)
        at, end = self.index[slot], self.index[slot + 1]
        open_ = np.flatnonzero(at < end)
        at, end, h = at[open_], end[open_], h[open_]
        for _ in range(self.deepest):
            hit = self.h[at] == h
            out[open_[hit]] = at[hit]
            going = ~hit & (at + 1 < end)
            if not going.any():
                break
            open_, at, end, h = open_[going], at[going] + 1, end[going], h[going]
        return out


@dataclass
class Kneser:
    """One language's interpolated Kneser-Ney model as sorted arrays of packed n-grams, by order."""

    grams: list[np.ndarray]
    p: list[np.ndarray]
    histories: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: float

    @classmethod
    def learn(cls, keys: np.ndarray, letters: int) -> "Kneser":
        """From the packed ORDER-grams of a text. Counts of the lower orders are those of distinct left neighbours."""
        top, count = np.unique(keys, return_counts=True)
        levels = [(top, count)]
        for k in range(ORDER - 1, 0, -1):
            short = levels[0][0] & _U((1 << 16 * k) - 1)
            levels.insert(0, np.unique(short, return_counts=True))
        out = cls([], [], [], [], 1.0 / (letters + 2))
        for k, (gram, count) in enumerate(levels, 1):
            once, twice = int((count == 1).sum()), int((count == 2).sum())
            discount = min(max(once / max(once + 2 * twice, 1), 0.1), 0.95)
            history, of = np.unique(gram >> _U(16), return_inverse=True)
            total, kinds = np.bincount(of, count), np.bincount(of)
            backoff = discount * kinds / total
            lower = out.prob(gram & _U((1 << 16 * (k - 1)) - 1), k - 1)
            out.grams.append(gram)
            out.p.append((count - discount) / total[of] + backoff[of] * lower)
            out.histories.append(history)
            out.backoff.append(backoff)
        return out

    def weight(self, history: np.ndarray, k: int) -> np.ndarray:
        """The back-off weight of order k of each history, 1 for unseen ones."""
        known = self.histories[k - 1]
        at = np.minimum(np.searchsorted(known, history), len(known) - 1)
        return np.where(known[at] == history, self.backoff[k - 1][at], 1.0)

    def prob(self, gram: np.ndarray, k: int) -> np.ndarray:
        if k == 0:
            return np.full(len(gram), self.floor)
        known = self.grams[k - 1]
        at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
        p = self.p[k - 1][at].copy()
        miss = known[at] != gram
        if miss.any():
            g = gram[miss]
            p[miss] = self.weight(g >> _U(16), k) * self.prob(g & _U((1 << 16 * (k - 1)) - 1), k - 1)
        return p


@dataclass
class Model:
    """Shared hash arrays of all languages, and what calibration found."""

    languages: list[str]
    symbols: np.ndarray
    grams: list[HashArray]
    backoff: list[HashArray]
    floor: float
    centre: np.ndarray
    limit: np.ndarray
    sharpness: float = 10.0

    def entropies(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Nats per symbol of each document under each language, and each document's number of letters."""
        sym, first = letters(chunk)
        n_lang = len(self.languages)
        size = np.maximum(first[1:] - (ORDER - 1) - first[:-1], 0)
        # n-grams end at places ORDER - 1 and on; those that end in a document's padding don't count
        if len(sym) <= ORDER - 1 or not size.any():
            return np.zeros((chunk.n, n_lang)), np.zeros(chunk.n, np.int64)
        ids = symbol_ids(sym, self.symbols)
        doc = np.repeat(np.arange(chunk.n), size)
        place = np.arange(len(doc)) + (ORDER - 1) * (doc + 1) - (ORDER - 1)
        key = grams(ids, ORDER)[place]
        row = self.grams[ORDER - 1].find(key)
        cut = np.concatenate(([0], np.cumsum(size)))
        full = np.flatnonzero(size)
        total = np.zeros((chunk.n, n_lang))
        good = row >= 0
        values = self.grams[ORDER - 1].values
        for lang in range(n_lang):
            column = np.append(values[:, lang], np.float32(0))  # row -1 is the 0 at the end
            total[full, lang] = np.add.reduceat(column[row], cut[full], dtype=np.float64)
        miss = np.flatnonzero(~good)
        if len(miss):
            extra = np.zeros((len(miss), n_lang), np.float32)
            todo = np.arange(len(miss))
            left = key[miss]
            for k in range(ORDER, 0, -1):
                if k < ORDER:
                    row = self.grams[k - 1].find(left)
                    hit = row >= 0
                    extra[todo[hit]] += self.grams[k - 1].values[row[hit]]
                    todo, left = todo[~hit], left[~hit]
                if not len(todo):
                    break
                held = self.backoff[k - 1].find(left >> _U(16))
                seen = held >= 0
                extra[todo[seen]] += self.backoff[k - 1].values[held[seen]]
                left = left & _U((1 << 16 * (k - 1)) - 1)
            extra[todo] += np.float32(np.log(self.floor))
            for lang in range(n_lang):
                total[:, lang] += np.bincount(doc[miss], extra[:, lang], chunk.n)
        has = np.concatenate(([0], np.cumsum(sym != 0)))
        n_letters = has[np.maximum(first[1:] - (ORDER - 1), first[:-1])] - has[first[:-1]]
        return -total / np.maximum(size, 1)[:, None], n_letters

    def judge(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The best language (-1 without letters), its share of the scores, its cross-entropy, and whether it is rejected."""
        ce, n = self.entropies(chunk)
        best = ce.argmin(axis=1)
        low = ce[np.arange(chunk.n), best]
        share = 1 / np.exp(-(ce - low[:, None]) * np.minimum(n, self.sharpness)[:, None]).sum(axis=1)
        none = n == 0
        bad = none | (excess(low, n, self.centre[best]) > self.limit[best, length_class(n)])
        return np.where(none, -1, best), np.where(none, 0.0, share), np.where(none, 0.0, low), bad


def excess(ce: np.ndarray, n: np.ndarray, centre: np.ndarray | float) -> np.ndarray:
    """How far cross-entropies of texts of n letters are above the middle, in units that hold for all lengths."""
    return (ce - centre) * np.sqrt(np.minimum(n, 400))


def length_class(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(LENGTHS, n, "right")


def upper_limit(values: np.ndarray, rate: float = RATE) -> float:
    """The k-th highest of m values, k = rate * (m + 1) in whole numbers but 1 at least."""
    at = len(values) - max(int(rate * (len(values) + 1)), 1)
    return float(np.partition(values, at)[at])


def learn(texts: list[str], langs: list[str]) -> Model:
    """Models of the texts, which come in an arbitrary order, and what calibration found."""
    languages = sorted(set(langs))
    number = {x: i for i, x in enumerate(languages)}
    lang = np.array([number[x] for x in langs])
    n_lang = len(languages)
    aside = np.zeros(len(texts), bool)
    for i in range(n_lang):
        rows = np.flatnonzero(lang == i)
        if len(rows) >= FEW:
            aside[rows[min(LEARN, len(rows) // 2) :]] = True
    sizes = np.bincount(lang, minlength=n_lang)
    pieces: list[list[np.ndarray]] = [[] for _ in languages]
    for c in chunks(pa.array([t for t, a in zip(texts, aside, strict=True) if not a], pa.large_string())):
        sym, first = letters(c)
        for i, owner in enumerate(lang[~aside][c.first : c.first + c.n]):
            pieces[owner].append(sym[first[i] - (ORDER - 1) : max(first[i + 1] - (ORDER - 1), first[i])])
    found, count = np.unique(np.concatenate([p for x in pieces for p in x] or [np.zeros(1, np.uint32)]), return_counts=True)
    found, count = found[found != 0], count[found != 0]
    symbols = np.sort(found[np.argsort(-count, kind="stable")[:LETTERS]])

    def keys(sym: np.ndarray) -> np.ndarray:
        return grams(symbol_ids(sym, symbols), ORDER) if len(sym) >= ORDER else np.zeros(0, _U)

    def model_of(some: list[np.ndarray]) -> Kneser:
        every = np.concatenate([keys(p) for p in some] or [np.zeros(0, _U)])
        return Kneser.learn(every if len(every) else np.zeros(1, _U), len(symbols))

    models = [model_of(p) for p in pieces]
    owner, low, n = [], [], []  # of each calibration row
    for i in np.flatnonzero(sizes < FEW):
        if len(pieces[i]) > 1:
            for fold in range(min(FOLDS, len(pieces[i]))):
                rest = model_of([p for k, p in enumerate(pieces[i]) if k % FOLDS != fold])
                for p in pieces[i][fold::FOLDS]:
                    if len(k := keys(p)):
                        owner.append(i)
                        low.append(-np.log(rest.prob(k, ORDER)).mean())
                        n.append(int((p != 0).sum()))
    del pieces
    shared, weights = [], []
    for k in range(1, ORDER + 1):
        every = np.unique(np.concatenate([m.grams[k - 1] for m in models]))
        shared.append(HashArray(every, np.log(np.stack([m.prob(every, k) for m in models], axis=1))))
        held = np.unique(np.concatenate([m.histories[k - 1] for m in models]))
        weights.append(HashArray(held, np.log(np.stack([m.weight(held, k) for m in models], axis=1))))
    model = Model(languages, symbols, shared, weights, models[0].floor, np.zeros(n_lang), np.full((n_lang, len(LENGTHS) + 1), np.inf))
    all_ce, all_lang, all_n = [], [], []
    for c in chunks(pa.array([t for t, a in zip(texts, aside, strict=True) if a], pa.large_string())):
        ce, k = model.entropies(c)
        own = lang[aside][c.first : c.first + c.n]
        all_ce.append(ce[k > 0])
        all_lang.append(own[k > 0])
        all_n.append(k[k > 0])
    if all_ce:
        ce, own, k = np.concatenate(all_ce), np.concatenate(all_lang), np.concatenate(all_n)
        owner, low, n = [*owner, *own], [*low, *ce[np.arange(len(ce)), own]], [*n, *k]

        def loss(s: float) -> float:
            z = -(ce - ce.min(axis=1, keepdims=True)) * np.minimum(k, s)[:, None]
            return -(z[np.arange(len(z)), own] - np.log(np.exp(z).sum(axis=1))).clip(-50).mean()

        model.sharpness = min((1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0), key=loss)
    _calibrate(model, np.array(owner, np.int64), np.array(low), np.array(n, np.int64))
    return model


def _calibrate(model: Model, owner: np.ndarray, low: np.ndarray, n: np.ndarray) -> None:
    """Centres and limits from the languages, cross-entropies and letters of calibration rows."""
    if not len(owner):
        return
    model.centre[:] = np.median(low)
    for i in np.unique(owner):
        model.centre[i] = np.median(low[owner == i])
    above, kind = excess(low, n, model.centre[owner]), length_class(n)
    together = upper_limit(above)
    model.limit[:] = together
    for i in np.unique(owner):
        own = owner == i
        limit = upper_limit(above[own])
        model.limit[i] = limit if own.sum() * RATE >= 2 else max(limit, together)
        for c in np.unique(kind[own]):
            if (own & (kind == c)).sum() * RATE >= 2:
                model.limit[i, c] = upper_limit(above[own & (kind == c)])


def held_out(fold: int = 2, folds: int = 4) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % folds == fold


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of a hash-chosen sample of rows of docs (doc_id, text, lang) for each language; None if there are none.

    Parts of at most PART characters of about `sample` texts of each language, ROWS in all, meet in one task, which learns; a count
    for each language and the model's arrays reach the driver.
    """
    own = docs.where("lang is not null and doc_id is not null").where(F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    sample = min(sample, max(1, ROWS // len(counts)))
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    bound = F.coalesce(*(F.when(F.col("lang") == x, F.lit(int(min(1.0, sample / n) * (1 << 32)))) for x, n in counts.items()))
    begin = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - (PART - 1), F.lit(1))).cast("int") + 1
    chosen = own.where(h < bound).select("doc_id", F.substring("text", begin, F.lit(PART)).alias("text"), "lang").repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["doc_id"], r["lang"], r["text"]))
        if rows:
            ids = mix(np.array([r["doc_id"] for r in rows], np.int64).astype(_U))
            rows = [rows[i] for i in np.argsort(ids, kind="stable")]
            model = learn([r["text"] for r in rows], [r["lang"] for r in rows])
            made = pickle.dumps(model)
            del rows, model
            release()
            yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["model"])

    made = chosen.mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else None


def has_letter(chunk: Chunk) -> np.ndarray:
    sym, first = letters(chunk)
    has = np.concatenate(([0], np.cumsum(sym != 0)))
    return has[np.maximum(first[1:] - (ORDER - 1), first[:-1])] > has[first[:-1]]


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy and rejected of every row, from its whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                if shared.value is None:
                    best, share, low, bad = np.full(c.n, -1), np.zeros(c.n), np.zeros(c.n), ~has_letter(c)
                else:
                    best, share, low, bad = shared.value.judge(c)
                names = np.array([*(shared.value.languages if shared.value else []), UNKNOWN], object)[best]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.first, c.n), pa.array(names, pa.string()), pa.array(share), pa.array(low), pa.array(bad)],
                    names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy and rejected of every row of docs (doc_id, text, lang).

    Learned from text and lang of rows with a non-null lang whose crc32(doc_id as text) mod 4 is not 2. lang_pred is `und`, with
    score 0, if the text is null or has no letter, and else the language of the lowest cross-entropy, whether rejected or not.
    A null doc_id counts as held out. Repeated rows each get a row; ties go to the language that sorts first. Without any
    row to learn from, all are `und`, and only those without a letter are rejected. Texts of any length are read whole; learning reads
    a part of long ones. Other columns are ignored; an empty table gives an empty result.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    found = identify(own, train(own.where(~held_out())))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(True)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, whose text isn't rejected by the model of language_id(). Where no row has a language
    to learn from, there is no model to reject by, and only texts without a letter go."""
    names = docs.columns
    own = docs.select(*(F.col(f"`{c}`").cast(t).alias(c) for c, t in (("doc_id", "long"), ("text", "string"), ("lang", "string"))))
    shared = docs.sparkSession.sparkContext.broadcast(train(own.where(~held_out())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(names.index("text"))):
                good = has_letter(c) if shared.value is None else ~shared.value.judge(c)[3]
                yield batch.slice(c.first, c.n).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
