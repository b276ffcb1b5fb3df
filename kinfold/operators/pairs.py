"""Pair operators: exact cosine joins by blocks, compare-mode joins, and set-overlap joins by prefixes.

Cosine joins never make a nested-loop join. Rows are dealt into blocks of BLOCK by a hash, each pair of blocks is one group of
bounded size, and a group multiplies its two blocks as matrices and emits only what passes the threshold. A table whose counted size is
within SMALL cells is sent to every task instead, and each task multiplies its rows with all of it; both give the same pairs.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import broadcast_if_small, discard, materialize
from ..functions.text import unique

BLOCK, SMALL, CHUNK = 2048, 8_000_000, 512
#: Of set overlap: items ranked by how many sets have them; 64-bit numbers of a sketch; items that a task marks at once; sets of a
#: block.
RANKED, SKETCH, ITEMS, MEMBERS = 1 << 18, 4, 1 << 20, 512
_PAIR = "a long, b long, similarity double"


def _unit(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of the vectors, padded with zeros, and their lengths over the whole vector."""
    sizes = [0 if v is None else len(v) for v in vectors]
    x = np.zeros((len(vectors), max(sizes, default=0)))
    for i, v in enumerate(vectors):
        x[i, : sizes[i]] = v if sizes[i] else 0
    return x, np.sqrt((x * x).sum(axis=1))


def _scores(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, raw: bool) -> np.ndarray:
    n = min(x.shape[1], y.shape[1])
    s = x[:, :n] @ y[:, :n].T
    if not raw:
        size = nx[:, None] * ny[None, :]
        s = np.divide(s, size, out=np.zeros_like(s), where=size > 0)
    return s


def _numbered(rows: DataFrame, key: str, vec: str) -> DataFrame:
    return rows.select(F.col(key).cast("long").alias("k"), F.col(vec).cast("array<double>").alias("v")).where("k is not null")


def _block_groups(rows: DataFrame, count: int) -> DataFrame:
    """Each row with every pair (i, j), i <= j, of blocks that its own is in."""
    n = max(1, -(-count // BLOCK))
    own = rows.withColumn("own", F.pmod(F.xxhash64("k"), F.lit(n)).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return met.select("k", "v", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _over_blocks(rows: DataFrame, key: str, vec: str, raw: bool, keep, schema: str) -> DataFrame:
    """Applies keep(ids of rows, ids of columns, scores, whether each is a pair a < b) to all block products."""
    numbered = _numbered(rows, key, vec)
    count = numbered.count()
    width = numbered.select(F.max(F.size("v"))).first()[0] or 0
    if count * width <= SMALL:
        held = numbered.orderBy("k").toPandas()  # counted above
        ids = held.k.to_numpy(np.int64)
        shared = rows.sparkSession.sparkContext.broadcast((ids, *_unit(list(held.v))))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, y, ny = shared.value
            for batch in batches:
                for at in range(0, len(batch), CHUNK):
                    part = batch.iloc[at : at + CHUNK]
                    x, nx = _unit(list(part.v))
                    k = part.k.to_numpy(np.int64)
                    yield keep(k, ids, _scores(x, nx, y, ny, raw), k[:, None] < ids[None, :])

        tasks = max(1, min(64, count // CHUNK))
        return numbered.repartition(tasks, "k").mapInPandas(scan, schema)

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf.i.iloc[0]), int(pdf.j.iloc[0])
        one, two = pdf[pdf.own == i], pdf[pdf.own == j]
        x, nx = _unit(list(one.v))
        y, ny = _unit(list(two.v))
        a, b = one.k.to_numpy(np.int64), two.k.to_numpy(np.int64)
        pair = (a[:, None] < b[None, :]) if i == j else np.ones((len(a), len(b)), bool)
        return keep(a, b, _scores(x, nx, y, ny, raw), pair)

    return _block_groups(numbered, count).groupBy("i", "j").applyInPandas(group, schema)


def similar_pairs(rows: DataFrame, key: str, vec: str, threshold: float, raw: bool = False) -> DataFrame:
    """a < b and similarity of every pair whose cosine (raw: dot product) is at least the threshold. Null keys are left out."""

    def keep(a: np.ndarray, b: np.ndarray, s: np.ndarray, pair: np.ndarray) -> pd.DataFrame:
        i, j = np.nonzero(pair & (s >= threshold))
        return pd.DataFrame({"a": np.minimum(a[i], b[j]), "b": np.maximum(a[i], b[j]), "similarity": s[i, j]})

    return _over_blocks(rows, key, vec, raw, keep, _PAIR)


def pair_totals(rows: DataFrame, key: str, vec: str) -> DataFrame:
    """checked, total and top over all pairs, without making them: partial sums of each block product, then one row."""

    def keep(a: np.ndarray, b: np.ndarray, s: np.ndarray, pair: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"n": [int(pair.sum())], "total": [float(s[pair].sum())], "top": [float(s[pair].max(initial=0.0))]})

    parts = _over_blocks(rows, key, vec, False, keep, "n long, total double, top double")
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("checked"), F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"), F.coalesce(F.max("top"), F.lit(0.0)).alias("top"))


def best_matches(rows: DataFrame, key: str, vec: str) -> DataFrame:
    """id and best, the highest similarity of each row with any other, where that is above 0."""

    def keep(a: np.ndarray, b: np.ndarray, s: np.ndarray, pair: np.ndarray) -> pd.DataFrame:
        t = np.where(pair, s, 0.0)
        ids, best = np.concatenate([a, b]), np.concatenate([t.max(axis=1, initial=0), t.max(axis=0, initial=0)])
        return pd.DataFrame({"id": ids[best > 0], "best": best[best > 0]})

    return _over_blocks(rows, key, vec, False, keep, "id long, best double").groupBy("id").agg(F.max("best").alias("best"))


def compare_pairs(rows: DataFrame, key: str, vec: str, target: Column, threshold: float) -> DataFrame:
    """Pairs of which exactly one side is a target, and whose cosine is at least the threshold."""
    marked = rows.select(F.col(key).alias("k"), F.coalesce(target, F.lit(False)).alias("t"))
    found = similar_pairs(rows, key, vec, threshold)
    a, b = (marked.select(F.col("k").alias(x), F.col("t").alias(f"t_{x}")) for x in "ab")
    return found.join(a, "a").join(b, "b").where("t_a <> t_b").select("a", "b", "similarity")


def compare_counts(rows: DataFrame, target: Column) -> DataFrame:
    """How many pairs compare mode looks at and how many it filters, in closed form."""
    sides = rows.agg(F.sum(F.coalesce(target, F.lit(False)).cast("long")).alias("t"), F.count("*").alias("n")).selectExpr("coalesce(t, 0) as t", "n - coalesce(t, 0) as r")
    return sides.selectExpr("t * r as compared", "(t * (t - 1) + r * (r - 1)) div 2 as filtered")


def _hashed(sets: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Sets (k, s) with 64-bit hashes h of their items, under a seed by which no two items have one hash; and the hashes of the RANKED
    items that most sets have, those in fewer sets first."""
    for seed in itertools.count():
        x, y = (F.xxhash64(F.lit(n), F.col("item")) for n in (2 * seed, 2 * seed + 1))
        each = sets.select(F.explode("s").alias("item")).select(x.alias("x"), y.alias("y"))
        counts = each.groupBy("x").agg(F.count("*").alias("df"), (F.min("y") != F.max("y")).alias("clash"))
        counts = materialize(counts.where("clash or df > 1"), "counts")
        if not counts.where("clash").limit(1).count():
            break
        discard(counts)
    least, ahead = None, 0
    for r in counts.groupBy("df").agg(F.count("*").alias("n")).orderBy(F.desc("df")).collect():  # a row for each count that occurs
        if (ahead := ahead + r["n"]) > RANKED:
            break
        least = r["df"]
    top = counts.where(F.col("df") >= least).orderBy("df", "x").select("x").toPandas().x.to_numpy(np.int64) if least else np.zeros(0, np.int64)
    discard(counts)
    return sets.select("k", F.transform("s", lambda item: F.xxhash64(F.lit(2 * seed), item)).alias("h")), top


def _marks(sets: DataFrame, top: np.ndarray, least: float) -> DataFrame:
    """Of each set (k, h) its size, a digest, a sketch, its prefix, which is empty where no other set can overlap enough, and h again.

    A bit of the sketch is the parity of the items that fall on it, so two sketches differ in no more bits than their sets in items.
    """
    order = np.argsort(top)
    shared = sets.sparkSession.sparkContext.broadcast((top[order], (order + 1).astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = shared.value
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            begin = 0
            while begin < len(sizes):
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + ITEMS, side="right")))
                n, x = sizes[begin:end], batch.column(1).slice(begin, end - begin).flatten().to_numpy()
                doc, first = np.repeat(np.arange(len(n)), n), np.concatenate(([0], np.cumsum(n)))
                place = np.zeros(len(x), np.int32)  # 0: rare
                if len(known):
                    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                    place = np.where(known[at] == x, rank[at], 0)
                x = x[np.lexsort((x, place, doc))]
                heads = np.where(n >= least * (n + 1) - 1e-9, n - np.ceil(least * n - 1e-9).astype(np.int64) + 1, 0)
                p = x[np.arange(len(x)) - first[doc] < heads[doc]]
                odd = (np.bincount(doc * (64 * SKETCH) + x % (64 * SKETCH), minlength=len(n) * 64 * SKETCH) & 1).astype(np.uint8)
                sketch = np.packbits(odd.reshape(len(n), -1), axis=1).view(np.int64)
                data = x.tobytes()
                digest = b"".join(hashlib.blake2b(data[8 * i : 8 * j], digest_size=16).digest() for i, j in itertools.pairwise(first.tolist()))
                digest = np.frombuffer(digest, np.int64).reshape(-1, 2)
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(heads))).astype(np.int32)), pa.array(p))
                columns = [n, *digest.T, *sketch.T]
                key, h = (batch.column(i).slice(begin, end - begin) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([key, *(pa.array(np.ascontiguousarray(c)) for c in columns), prefix, h], names=names)
                begin = end

    names = ["k", "n", "d1", "d2", *(f"b{i}" for i in range(SKETCH)), "p", "h"]
    return sets.mapInArrow(run, ", ".join(f"{c} long" for c in names[:-2]) + ", p array<long>, h array<long>")


def _confirmed(met: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """a, b and overlap of the pairs (a, b) of sets (k, h) that overlap enough.

    Pairs near each other are compared in one place, to which each of their sets goes once: that of the least set within two steps of the
    pair's first. Where a place has many sets, in blocks of MEMBERS by MEMBERS of them.
    """
    ends = met.select(F.explode(F.array(F.struct(F.col("a").alias("k"), F.col("b").alias("o")), F.struct(F.col("b").alias("k"), F.col("a").alias("o")))).alias("e")).select("e.*")
    near = ends.groupBy("k").agg(F.least("k", F.min("o")).alias("x"))
    near = ends.join(near.select(F.col("k").alias("o"), "x"), "o").groupBy("k").agg(F.min("x").alias("x"))
    near = materialize(near, "near")
    keyed = materialize(met.join(near.withColumnRenamed("k", "a"), "a").select("a", "b", "x"), "keyed")
    members = keyed.select("x", F.explode(F.array("a", "b")).alias("k")).distinct().groupBy("x").agg(F.count("*").alias("n"))
    large = materialize(members.where(F.col("n") > MEMBERS).select("x", F.ceil(F.col("n") / MEMBERS).alias("blocks")), "large")
    places = max(1, -(-near.count() // (4 * MEMBERS)))
    block = lambda c: F.pmod(F.xxhash64(c), F.coalesce("blocks", F.lit(1)))
    dealt = keyed.join(broadcast_if_small(large), "x", "left").select("a", "b", F.pmod(F.xxhash64("x", block("a"), block("b")), F.lit(places)).alias("g"))
    needed = materialize(dealt.select(F.col("g").alias("place"), F.explode(F.array("a", "b")).alias("k")).distinct(), "needed")
    sent = sets.select("k", "h").join(broadcast_if_small(needed), "k")

    def compare(own: pa.Table, asked: pa.Table) -> pa.Table:
        a, b = (asked.column(c).to_numpy() for c in "ab")
        if not len(a):
            return pa.table({"a": a, "b": b, "overlap": np.zeros(0)})
        k, h = own.column("k").to_numpy(), own.column("h").combine_chunks()
        n = h.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(n) - n
        items = np.unique(h.flatten().to_numpy(), return_inverse=True)[1]
        order = np.argsort(k, kind="stable")
        x, y = (order[np.searchsorted(k, c, sorter=order)] for c in (a, b))
        sort = np.argsort(x, kind="stable")
        a, b, x, y = a[sort], b[sort], x[sort], y[sort]
        common, inside = np.zeros(len(a), np.int64), np.zeros(len(items) + 1, bool)
        starts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))).tolist()
        for lo, hi in itertools.pairwise([*starts, len(a)]):
            mine = items[first[x[lo]] : first[x[lo]] + n[x[lo]]]
            inside[mine] = True
            for at in range(lo, hi, CHUNK):
                other = y[at : min(at + CHUNK, hi)]
                size = n[other]
                begin = np.cumsum(size) - size
                cells = np.repeat(first[other] - begin, size) + np.arange(size.sum())
                common[at : at + len(other)] = np.add.reduceat(inside[items[cells]], begin, dtype=np.int64)
            inside[mine] = False
        overlap = common / np.maximum(n[x], n[y])
        own = overlap >= least - 1e-9
        return pa.table({"a": a[own], "b": b[own], "overlap": overlap[own]})

    return sent.groupBy("place").cogroup(dealt.groupBy("g")).applyInArrow(compare, "a long, b long, overlap double")


def overlap_pairs(rows: DataFrame, key: str, items: str, least: float) -> DataFrame:
    """a < b and overlap (common distinct items over the larger set's) of every pair of sets with overlap >= least > 0.

    Equal sets are one class, of which one set goes on. Two different sets share one of their first n - ceil(least * n) + 1 items in any
    common order; with the rarest items first these prefixes meet rarely. Sets that share a prefix item are kept if their sizes, the
    items left from there on and their sketches allow the overlap, and only those few are compared as a whole.
    """
    sets, top = _hashed(rows.select(F.col(key).cast("long").alias("k"), unique(F.col(items)).alias("s")).where("k is not null and size(s) > 0"))
    marks = materialize(_marks(sets, top, least), "marks")
    classes = marks.groupBy("d1", "d2").agg(F.min("k").alias("rep"), F.count("*").alias("size")).where("size > 1").drop("size")
    copies = materialize(marks.join(classes, ["d1", "d2"]).select("k", "rep"), "copies")
    others = materialize(copies.where("k <> rep").select("k"), "others")
    sketch = [f"b{i}" for i in range(SKETCH)]
    heads = marks.where("size(p) > 0").join(broadcast_if_small(others), "k", "left_anti").select("k", "n", *sketch, F.posexplode("p").alias("at", "x"))
    a, b = (heads.select("x", *(F.col(c).alias(f"{c}_{s}") for c in ("k", "n", "at", *sketch))) for s in "ab")
    most = F.greatest("n_a", "n_b") * least - 1e-9
    left = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= most
    unlike = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in sketch), F.lit(0))
    met = a.join(b, "x").where((F.col("k_a") < F.col("k_b")) & left & (unlike <= F.col("n_a") + F.col("n_b") - 2 * most))
    met = materialize(met.select(F.col("k_a").alias("a"), F.col("k_b").alias("b")).distinct(), "met")
    links = _confirmed(met, marks, least)
    for x in "ab":  # every copy has the links of its class
        links = links.join(copies.select(F.col("rep").alias(x), F.col("k").alias(f"k_{x}")), x, "left").withColumn(x, F.coalesce(f"k_{x}", x)).drop(f"k_{x}")
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "overlap")
    x, y = (copies.select("rep", F.col("k").alias(c)) for c in "ab")
    return links.unionByName(x.join(y, "rep").select("a", "b", F.lit(1.0).alias("overlap"))).where("a < b")
