"""Quality rules whose thresholds carry a guarantee on false rejection.

Base rules are fixed. Beyond them a document is rejected if any of its features is above its stratum's cutoff. A quarter of the
good labelled rows (by a hash of doc_id) proposes a path of ever stricter cutoffs, from well beyond its highest values down through
its quantiles; the others certify them: going down the path, a step stands while the exact (Clopper-Pearson) upper bound on the share of
good rows it rejects is at most RISK. Tests along a path stop at the first failure, so each stratum spends its level once; the levels
of the strata are corrected for their number (Bonferroni). With confidence 1 - DELTA, no stratum then loses more than RISK of
its good documents to the cutoffs. A stratum of which needed_rows() good rows or fewer certify has no step that can stand, and
nothing more is rejected in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import checkpoints as scratch
from .textbatch import chunks, per_document, windows

RISK, DELTA = 0.01, 0.05
#: Word counts at which a new stratum begins.
STRATA = (100, 400)
#: The path, from lenient to strict: beyond the highest good row by these multiples of its distance from the median, then quantiles.
BEYOND = (2.0, 1.0, 0.5, 0.25, 0.1)
PATH = (1.0, 0.9995, 0.999, 0.998, 0.996, 0.994, 0.992, 0.99, 0.985, 0.98)
#: One labelled row in so many proposes, the others certify.
PROPOSE = 4
SYMBOLS = "#*$%&|<>"
REPEAT = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct"]
_U = np.uint64
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _repeated(h: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Which words lie in a run of `size` words that is found twice or more in their document."""
    run, at, rfirst = windows(h, first, size)
    covered = np.zeros(len(h) + 1, np.int64)
    if len(run):
        doc = np.repeat(np.arange(len(first) - 1), np.diff(rfirst)).astype(_U)
        key = run ^ (doc * _U(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(run), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.subtract.at(covered, at[twice] + size, 1)
    return np.cumsum(covered[:-1]) > 0


def _later_copies(chunk, has_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each document, its lines with a word, and those of them that equal an earlier line."""
    cut = np.zeros(len(chunk.buf) + 1, bool)
    cut[np.flatnonzero(chunk.buf == 10) + 1] = True
    cut[chunk.off[:-1]] = True
    cut[len(chunk.buf)] = False
    start = np.flatnonzero(cut)
    end = np.append(start[1:], len(chunk.buf))
    words = np.concatenate(([0], np.cumsum(has_word)))
    end_text = end - ((end > start) & (chunk.buf[np.maximum(end, 1) - 1] == 10))
    solid = words[end] > words[start]
    start, end_text = start[solid], end_text[solid]
    doc = np.searchsorted(chunk.off, start, "right") - 1
    key = chunk.span_hash(start, end_text) ^ (doc.astype(_U) * _U(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    if len(key):
        again[order[1:][key[order[1:]] == key[order[:-1]]]] = True
    return np.bincount(doc, minlength=chunk.n), np.bincount(doc, again, chunk.n).astype(np.int64)


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                c.find_words()
                h = c.word_hash()
                n_words = np.diff(c.wfirst)
                is_point = np.concatenate(([0], np.cumsum((c.buf & 0xC0) != 0x80)))
                chars = per_document(is_point[c.end] - is_point[c.start], c.wfirst)
                symbols = per_document(_IS_SYMBOL[c.buf].astype(np.int64), c.off)
                begins = np.zeros(len(c.buf), np.int64)
                begins[c.start] = 1
                lines, copies = _later_copies(c, begins)
                repeats = per_document(_repeated(h, c.wfirst, REPEAT).astype(np.int64), c.wfirst)
                doc = np.repeat(np.arange(c.n), n_words)
                pair = np.sort((doc.astype(_U) << _U(40)) | (h >> _U(24)))
                fresh = np.concatenate(([True], pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, bool)
                distinct = np.bincount((pair[fresh] >> _U(40)).astype(np.int64), minlength=c.n)
                cols = [n_words, chars, symbols, copies, repeats, lines, distinct]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.first, c.n), *(pa.array(v.astype(np.int64)) for v in cols)], names=["doc_id", *COUNTS]
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def binomial_upper(bad: int, n: int, level: float) -> float:
    """The exact upper bound: the largest p with P(X <= bad) >= level for X of Binomial(n, p)."""
    if bad >= n:
        return 1.0
    low, high = bad / n, 1.0
    logs = np.array([math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(bad + 1)])
    i = np.arange(bad + 1)
    for _ in range(60):
        p = (low + high) / 2
        if np.exp(logs + i * math.log(p) + (n - i) * math.log1p(-p)).sum() >= level:
            low = p
        else:
            high = p
    return high


def features() -> dict[str, Column]:
    """Shares that grow with junk; each is 0 for a text without words."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbols": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeats": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
        "sameness": F.lit(1.0) - F.col("n_distinct") / words,
    }


def stratum() -> Column:
    return reduce(lambda s, n: s + (F.col("n_words") >= n).cast("int"), STRATA, F.lit(0))


def needed_rows(risk: float = RISK, level: float = DELTA / (len(STRATA) + 1)) -> int:
    """Good rows that a step needs to stand even if it rejects none of them."""
    return math.ceil(math.log(level) / math.log1p(-risk))


def steps_of(median: float, quantiles: list[float]) -> list[float]:
    """One feature's cutoffs along the path, from its median and the quantiles PATH of the rows that propose."""
    return [quantiles[0] + b * (quantiles[0] - median) for b in BEYOND] + list(quantiles)


def last_standing(rejected: list[int], n: int, risk: float, level: float) -> int:
    """The last step of the path before the first that isn't certified, -1 if none is; rejected: of n good rows, by each step."""
    for i, bad in enumerate(rejected):
        if not n or binomial_upper(bad, n, level) > risk:
            return i - 1
    return len(rejected) - 1


def certified(counts: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> dict[int, dict[str, float]]:
    """The strictest certified cutoffs of each stratum that has any. What reaches the driver is a row for each stratum."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    feats = features()
    part = (F.crc32(F.col("doc_id").cast("string")) % PROPOSE).alias("part")
    good = counts.where(~base_failed()).join(marks, "doc_id").select(stratum().alias("stratum"), part, *(v.alias(k) for k, v in feats.items()))
    with scratch.scope():
        good = scratch.materialize(good, "good")
        proposed = good.where("part = 0").groupBy("stratum").agg(*(F.percentile_approx(k, [0.5, *PATH], 100_000).alias(k) for k in feats)).collect()
        steps = {r["stratum"]: [dict(zip(feats, c, strict=True)) for c in zip(*(steps_of(r[k][0], r[k][1:]) for k in feats), strict=True)] for r in proposed}
        if not steps:
            return {}

        def rejected(i: int) -> Column:
            own = [F.when(F.col("stratum") == s, reduce(Column.__or__, [F.col(k) > c for k, c in path[i].items()])) for s, path in steps.items()]
            return F.sum(F.coalesce(*own, F.lit(False)).cast("long")).alias(f"r{i}")

        n_steps = len(BEYOND) + len(PATH)
        held = good.where("part <> 0").groupBy("stratum").agg(F.count("*").alias("n"), *(rejected(i) for i in range(n_steps))).collect()
    out = {}
    for row in held:
        if row["stratum"] in steps:
            last = last_standing([row[f"r{i}"] for i in range(n_steps)], row["n"], risk, delta / (len(STRATA) + 1))
            if last >= 0:
                out[row["stratum"]] = steps[row["stratum"]][last]
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, stratum, rejected_by (features above their cutoffs) and kept, for every row of docs.

    Words are [^\\x20\\x09-\\x0D]+; labels has doc_id and quality (1: good), of several labels of one doc_id the least counts. A null
    or wordless text has counts of 0 and fails the base rules. Repeated rows each get a row; a null doc_id matches no label. Without
    labels only the base rules reject. Other columns are ignored; an empty table gives an empty result; texts are read whole.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = scratch.materialize(text_counts(own), "counts")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    cutoffs = certified(counts, marks)
    feats = features()
    above = {k: F.lit(False) for k in feats}
    for s, cut in cutoffs.items():
        for k, c in cut.items():
            above[k] = above[k] | ((stratum() == s) & (feats[k] > c))
    by = F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in above.items())))
    kept = ~base_failed() & (F.size(by) == 0)
    return counts.select("doc_id", *COUNTS, base_failed().alias("base_failed"), stratum().alias("stratum"), by.alias("rejected_by"), kept.alias("kept"))
