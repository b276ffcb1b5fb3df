"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Learning reads a bounded, hash-chosen sample of labelled rows in one task; every feature has a learning rate of its own, and the L1 term
leaves most weights at exactly 0, so the model is a short list of slots and weights, which is broadcast. Scoring reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import Chunk, chunks, mix, release

BITS = 20
#: Labelled rows and characters of their texts that learning reads at most, about. Of a text of more than PART characters it reads that
#: many, from a place that a hash chooses.
SAMPLE, TOTAL, PART = 12_000, 64_000_000, 20_000
EPOCHS, ALPHA, BETA, L1, L2 = 4, 1.0, 1.0, 15.0, 1.0
_U = np.uint64


def features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words, pairs of neighbours and pairs with one word between, and each one's document.

    Words have A-Z in lower case, and punctuation at their ends taken off."""
    chunk.find_words()
    start, end = chunk.start.copy(), chunk.end.copy()
    for _ in range(3):
        start += (_PUNCT[chunk.buf[start]]) & (end - start > 1)
        end -= (_PUNCT[chunk.buf[end - 1]]) & (end - start > 1)
    h = chunk.span_hash(start, end)
    doc = np.repeat(np.arange(chunk.n), np.diff(chunk.wfirst))
    hashed, docs = [h], [doc]
    for gap, salt in ((1, 0x51ED270B), (2, 0x2545F491)):
        same = doc[:-gap] == doc[gap:]
        hashed.append(mix(h[:-gap][same] * _U(3) + h[gap:][same] * _U(0x9E3779B97F4A7C15) + _U(salt)))
        docs.append(doc[:-gap][same])
    return (np.concatenate(hashed) >> _U(64 - BITS)).astype(np.int32), np.concatenate(docs)


_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in ".,;:!?\"'()[]{}*#$%&|<>-_"]] = True


def distinct(index: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.sort(doc.astype(np.int64) << BITS | index)
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    return (key & ((1 << BITS) - 1)).astype(np.int32), key >> BITS


def learn(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """FTRL-proximal over rows (distinct features, label): the weights and the bias, in the given order of rows.

    A row of the rarer label 1 weighs the root of the odds against it. L1 is above what one row can add to a coordinate in a
    few epochs, so n-grams of a single text stay at 0."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    positive = sum(y for _, y in rows)
    heavier = min(max((len(rows) - positive) / max(positive, 1), 1.0), 100.0) ** 0.5
    zb = nb = 0.0
    for _ in range(epochs):
        for x, y in rows:
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) > L1, -(zx - np.sign(zx) * L1) / ((BETA + np.sqrt(nx)) / ALPHA + L2), 0.0)
            b = -zb / ((BETA + nb**0.5) / ALPHA)
            p = 1 / (1 + np.exp(-min(max(w.sum() + b, -30), 30)))
            g = heavier * (p - 1) if y else p
            z[x] += g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / ALPHA * w
            n[x] += g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / ALPHA * b
            nb += g * g
    w = np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)
    return w, -zb / ((BETA + nb**0.5) / ALPHA)


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """Up to `size` labelled rows of docs (doc_id, text), with fewer where texts are long, by a hash of doc_id below a bound that two
    counts set."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    begin = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - (PART - 1), F.lit(1))).cast("int") + 1
    parts = docs.where("doc_id is not null and text is not null").select("doc_id", F.substring("text", begin, F.lit(PART)).alias("text"))
    count = known.count()
    mean = parts.agg(F.avg(F.length("text")).alias("mean")).first()["mean"] or 1.0
    bound = int(min(1.0, min(size, TOTAL / max(mean, 1.0)) / max(count, 1)) * (1 << 32))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < bound)
    return parts.join(F.broadcast(chosen), "doc_id")


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots and weights that aren't 0, and the bias, of a sample of labels joined to docs. Features are made where the texts are and
    learned from in one task, in order of a hash of doc_id, so reruns agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1), lower=True):
                index, doc = distinct(*features(c))
                first = np.searchsorted(doc, np.arange(c.n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(c.first, c.n) for i in (0, 2)), pa.ListArray.from_arrays(first, index)], names=["doc_id", "toxic", "x"]
                )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = {}
        for batch in batches:
            for i, y, x in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)):
                x = x.values.to_numpy()
                if i not in rows or x.tobytes() < rows[i][0].tobytes():  # of texts that share a doc_id, one
                    rows[i] = (x.copy(), int(y > 0))
        ids = np.array(list(rows), np.int64)
        w, bias = learn([rows[i] for i in ids[np.lexsort((ids, mix(ids.astype(np.uint64))))]])
        some = np.flatnonzero(w)
        del rows
        release()
        cols = [pa.array([some.astype(np.int32)], pa.list_(pa.int32())), pa.array([w[some]], pa.list_(pa.float64())), pa.array([bias])]
        yield pa.RecordBatch.from_arrays(cols, names=["slots", "weights", "bias"])

    sample = labelled_sample(docs, labels).mapInArrow(run, "doc_id long, toxic int, x array<int>")
    made = sample.repartition(1).mapInArrow(fit, "slots array<int>, weights array<double>, bias double").collect()
    if not made:
        return np.zeros(0, np.int32), np.zeros(0), 0.0
    return np.array(made[0]["slots"], np.int32), np.array(made[0]["weights"]), made[0]["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id, score and predicted (score >= 0.5) of every row, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast((model[0], model[1].astype(np.float32), float(model[2])))  # the weights that L1 leaves

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, some, bias = shared.value
        weights = np.zeros(1 << BITS, np.float32)
        weights[slots] = some
        for batch in batches:
            for c in chunks(batch.column(1), lower=True):
                index, doc = features(c)
                used = weights[index] != 0
                index, doc = distinct(index[used], doc[used])
                total = np.bincount(doc, weights[index], c.n) + bias
                p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.first, c.n), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def held_out(fold: int, folds: int = 5):
    return F.crc32(F.col("doc_id").cast("string")) % folds == fold


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text); learned from labels (doc_id, toxic).

    Rows whose crc32(doc_id as text) is divisible by 5 are held out of learning; a null doc_id counts as held out. A null or
    empty text has no features and gets the bias's score. Several labels of one doc_id count once, as the largest; repeated
    rows each get a row. Without labels every score is 0.5. Texts of any length are scored whole; learning reads a part of long
    ones. Other columns are ignored; empty tables give empty results.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    model = train(own.where(~held_out(0)), marks.where(~held_out(0)))
    return score(own, model).select("doc_id", F.coalesce(held_out(0), F.lit(True)).alias("held_out"), "score", "predicted")
