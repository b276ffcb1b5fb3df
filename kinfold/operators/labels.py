"""Duplicate labels of pairs that no rule suppresses, and their hints."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import messages
from ..functions import sets, text, vectors

WRAPPER, STYLE, LOGIC, COPY, PROP, FORK = "wrapper-duplicate", "style-duplicate", "logic-duplicate", "copy-paste-variant", "prop-parameterizable", "forked-clone"
LABELS = (WRAPPER, STYLE, LOGIC, COPY, PROP, FORK)
#: Rows of a block at most; blocks that fewer rows are dealt into, and rows of a tile; pairs whose sets are read at once.
BLOCK, FEW, TILE, CHUNK = 20992, 4, 512, 2048


def label_facts(components: DataFrame, *more: Column) -> DataFrame:
    """What labels need of each component, and more; token sets are made here, once for each row."""
    return components.select(
        "ord",
        F.coalesce("wrapper", F.lit(False)).alias("wrapper"),
        F.coalesce("has_styles", F.lit(False)).alias("has_styles"),
        F.coalesce("css_in_js", F.lit(False)).alias("css_in_js"),
        text.unique(F.col("style_paths")).alias("style_paths"),
        F.coalesce("style_vec", F.array().cast("array<double>")).alias("style_vec"),
        text.unique(F.col("logic")).alias("logic"),
        text.unique(F.col("literals")).alias("literals"),
        F.size(text.present(F.col("prop_names"))).alias("n_props"),
        F.array_distinct(F.transform(text.tokenize(F.coalesce("source", F.lit(""))), lambda t: F.xxhash64(t))).alias("tokens"),
        text.line_count(F.coalesce("source", F.lit(""))).alias("lines"),
        *more,
    )


def labels(low: float, high: float, disabled: tuple[str, ...] = ()) -> Column:
    """The labels of a row with label_facts() of both sides as x and y, in order."""
    x, y, sim = F.col("x"), F.col("y"), F.col("similarity")
    common = F.size(F.array_intersect(x["style_paths"], y["style_paths"]))
    unshared = F.size(F.array_union(x["style_paths"], y["style_paths"])) - common
    one_sheet = (common > 0) & ~x["css_in_js"] & ~y["css_in_js"] & (unshared == 0)
    tests = {
        WRAPPER: x["wrapper"] & y["wrapper"],
        STYLE: (x["has_styles"] | y["has_styles"]) & ~one_sheet & (vectors.cosine(x["style_vec"], y["style_vec"]) >= 0.8),
        LOGIC: sets.overlap_of_distinct(x["logic"], y["logic"]) >= 0.6,
        COPY: (sim >= 0.95) | (sets.overlap_of_distinct(x["tokens"], y["tokens"]) >= 0.9),
        PROP: (sim >= high) & ((sets.overlap_of_distinct(x["literals"], y["literals"]) >= 0.4) | ((x["n_props"] > 0) & (y["n_props"] > 0))),
    }
    found = F.array_compact(F.array(*(F.when(t, F.lit(k)) for k, t in tests.items() if k not in disabled)))
    if len(disabled) >= len(LABELS) - 1 and FORK not in disabled:
        found = F.array().cast("array<string>")
    if FORK in disabled:
        return F.coalesce(found, F.array().cast("array<string>"))
    fork = (sim >= low) & (F.abs(x["lines"] - y["lines"]) >= 4)
    return F.when((F.size(found) == 0) & fork, F.array(F.lit(FORK))).otherwise(found)


def labelled(pairs: DataFrame, components: DataFrame, low: float, high: float, disabled: tuple[str, ...] = (), language: str = "en") -> DataFrame:
    """Adds category, labels and hints to pairs (a, b, similarity)."""
    facts = label_facts(components)
    one, two = (facts.select(F.col("ord").alias(k), F.struct("*").alias(s)) for k, s in (("a", "x"), ("b", "y")))
    hints = F.create_map(*(F.lit(v) for k, h in messages.hints(language).items() for v in (k, h)))
    out = pairs.join(one, "a").join(two, "b").withColumn("labels", labels(low, high, disabled)).drop("x", "y")
    return out.withColumn("category", category(high)).withColumn("hints", F.transform("labels", lambda x: F.element_at(hints, x)))


def category(high: float) -> Column:
    return F.when(F.col("similarity") >= high, "almost-identical").otherwise("near-duplicate")


def similar_labelled(components: DataFrame, vec: str, threshold: float, low: float, high: float, disabled: tuple[str, ...] = ()) -> DataFrame:
    """a < b, similarity and labels of every pair of components whose cosine is at least the threshold; as labelled(), but pairs are made
    and judged in blocks, so that facts go along with a block and never with a pair. Sets are compared by 64-bit hashes of their items."""
    hashed = lambda c: F.transform(c, lambda x: F.xxhash64(x)).alias(c)
    kinds = ("style_paths", "logic", "literals")
    known = components.where("ord is not null")
    v = F.coalesce(F.col(vec).cast("array<double>"), F.array().cast("array<double>"))
    rows = label_facts(known, v.alias("v")).select(F.col("ord").cast("long").alias("k"), "wrapper", "has_styles", "css_in_js", "n_props", "lines", "style_vec", "tokens", "v", *(hashed(c) for c in kinds))
    differs = lambda c: F.exists(c, lambda x: ~x.cast("float").cast("double").eqNullSafe(x))
    if not known.where(differs(v) | F.coalesce(differs(F.col("style_vec")), F.lit(False))).limit(1).count():  # numbers that were floats go as such
        rows = rows.withColumns({c: F.col(c).cast("array<float>") for c in ("v", "style_vec")})
    count = known.count()
    n = max(-(-count // BLOCK), min(FEW, -(-count // TILE)), 1)
    own = rows.withColumn("own", F.pmod(F.xxhash64("k"), F.lit(n)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    dealt = own.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(list(batches))
        side = both.column("own").to_numpy()
        one, two = np.flatnonzero(side == side.min()), np.flatnonzero(side == both.column("j")[0].as_py())
        k, wrapper, styled, css, props, lines = (both.column(c).to_numpy(zero_copy_only=False) if c != "k" else both.column(c).to_numpy() for c in ("k", "wrapper", "has_styles", "css_in_js", "n_props", "lines"))
        x, look = _matrix(both.column("v")), _matrix(both.column("style_vec"))
        size, width = np.sqrt((x * x).sum(axis=1)), _lengths(both.column("style_vec"))
        squares = np.concatenate((np.zeros((len(k), 1)), np.cumsum(look * look, axis=1)), axis=1)
        held = {c: _Sets(both.column(c)) for c in ("tokens", *kinds)}
        if both.column("i")[0].as_py() != both.column("j")[0].as_py() and len(np.unique(side)) < 2:
            one = one[:0]
        del both
        for at in range(0, len(one), TILE):
            for to in range(0, len(two), 8 * TILE):
                p, q = one[at : at + TILE], two[to : to + 8 * TILE]
                s, scale = x[p] @ x[q].T, size[p][:, None] * size[q][None, :]
                s = np.divide(s, scale, out=np.zeros_like(s), where=scale > 0)
                fits = s >= threshold
                if len(one) == len(two) and one[0] == two[0]:
                    fits &= k[p][:, None] < k[q][None, :]
                i, j = np.nonzero(fits)
                sim, a, b = s[i, j], p[i], q[j]
                code = np.zeros(len(a), np.int32)

                def put(label, where, own):
                    if label not in disabled:
                        code[where] |= own.astype(np.int32) << LABELS.index(label)

                every = slice(None)
                put(WRAPPER, every, wrapper[a] & wrapper[b])
                m = np.minimum(width[a], width[b])
                long = np.sqrt(squares[a, m]) * np.sqrt(squares[b, m])
                dot = np.einsum("ij,ij->i", look[a], look[b])
                near = (styled[a] | styled[b]) & (np.divide(dot, long, out=np.zeros(len(a)), where=long > 0) >= 0.8)
                near = np.flatnonzero(near)
                put(STYLE, near, ~(~css[a[near]] & ~css[b[near]] & held["style_paths"].reach(a[near], b[near], 1.0)))
                put(LOGIC, every, held["logic"].reach(a, b, 0.6))
                put(COPY, every, (sim >= 0.95) | held["tokens"].reach(a, b, 0.9))
                alike = np.flatnonzero(sim >= high)
                put(PROP, alike, ((props[a[alike]] > 0) & (props[b[alike]] > 0)) | held["literals"].reach(a[alike], b[alike], 0.4))
                put(FORK, every, (code == 0) & (sim >= low) & (np.abs(lines[a] - lines[b]) >= 4))
                yield pa.RecordBatch.from_pydict({"a": np.minimum(k[a], k[b]), "b": np.maximum(k[a], k[b]), "similarity": sim, "code": code})

    judged = dealt.groupBy("i", "j").applyInArrow(judge, "a long, b long, similarity double, code int")
    named = F.array_compact(F.array(*(F.when(F.col("code").bitwiseAND(1 << i) != 0, F.lit(x)) for i, x in enumerate(LABELS))))
    return judged.select("a", "b", "similarity", named.alias("labels"))


def _lengths(lists: pa.ChunkedArray) -> np.ndarray:
    return lists.combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Rows padded with zeros."""
    n = _lengths(lists)
    out = np.zeros((len(n), max(n.max(initial=0), 1)))
    out[np.arange(out.shape[1]) < n[:, None]] = lists.combine_chunks().flatten().to_numpy()
    return out


class _Sets:
    """A set of each row, its items numbered."""

    def __init__(self, lists: pa.ChunkedArray):
        self.n = _lengths(lists)
        self.first = np.cumsum(self.n) - self.n
        self.items = pd.factorize(lists.combine_chunks().flatten().to_numpy())[0].astype(np.int32)
        self.inside = np.zeros(len(self.items) + 1, bool)

    def reach(self, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
        """Whether the overlap of each pair is at least that; pairs of one a stand together."""
        most = np.maximum(self.n[a], self.n[b])
        out = np.zeros(len(a), bool)
        able = np.flatnonzero((np.minimum(self.n[a], self.n[b]) > 0) & (np.minimum(self.n[a], self.n[b]) / np.maximum(most, 1) >= least))  # sizes alone rule the others out
        x, y, most = a[able], b[able], most[able]
        if not len(x):
            return out
        common = np.zeros(len(x), np.int64)
        starts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))).tolist()
        for lo, hi in itertools.pairwise([*starts, len(x)]):
            mine = self.items[self.first[x[lo]] : self.first[x[lo]] + self.n[x[lo]]]
            self.inside[mine] = True
            for at in range(lo, hi, CHUNK):
                other = y[at : min(at + CHUNK, hi)]
                size = self.n[other]
                begin = np.cumsum(size) - size
                cells = np.repeat(self.first[other] - begin, size) + np.arange(size.sum())
                common[at : at + len(other)] = np.add.reduceat(self.inside[self.items[cells]], begin, dtype=np.int64)
            self.inside[mine] = False
        out[able] = common / most >= least
        return out
