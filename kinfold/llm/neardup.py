"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union-find grouping.

Steps, none of which holds a group in one task or on the driver:

1. One pass over the texts makes, per document, the size and an order-free 128-bit digest of its set of
   word shingles, a SuperMinHash signature and the hashes of the signature's bands.
2. Rows with equal digests are one class, represented by one of its rows. Only representatives go on, under the row's
   number, so that texts which share a doc_id are told apart; ids come back when the groups are known.
3. Banding: in every bucket each member is paired with the bucket's least member (a star, not all pairs). Pairs
   whose signatures agree too little are dropped, the rest are confirmed on full shingle sets, salted by
   the star's size, and confirmed links are grouped by label propagation with pointer jumping.
4. Members of one bucket that are still in different groups may be linked by a pair that no star held. Those
   are compared too, in blocks of bounded size that emit links only, and the groups are merged again.

With 30 bands of 5 rows a pair at similarity 0.85 shares a bucket with probability 1 - 2e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import checkpoints as scratch
from .textbatch import chunks, mix, windows

BANDS, ROWS = 30, 5
SLOTS = BANDS * ROWS
#: A pair goes to verification if its signatures agree in this share of slots or more. At similarity 0.85 the share has
#: a standard deviation below 0.03, so 0.6 is eight of them away.
AGREE = 0.6
#: Members of a star that one task compares with the star's centre.
STAR = 512
#: The same for members that the stars have left over: five standard deviations.
AGREE_LEFT = 0.7
#: Members of a bucket in one block.
BLOCK = 512
_U = np.uint64
_SIGNED = "doc_id long, t long, n long, d1 long, d2 long, sig binary, bands array<long>"


def shingle_sets(chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, concatenated, and where each begins.

    A document of fewer than k words has its whole word sequence as its only shingle; one without words has none.
    """
    chunk.find_words()
    h = chunk.word_hash()
    full, _, first = windows(h, chunk.wfirst, k)
    sets, sizes = [], np.zeros(chunk.n + 1, np.int64)
    n_words = np.diff(chunk.wfirst)
    for i in range(chunk.n):
        if n_words[i] >= k:
            s = np.sort(full[first[i] : first[i + 1]])
            if len(s) > 1:
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                s = s[keep]
        elif n_words[i]:
            a, b = chunk.wfirst[i], chunk.wfirst[i + 1]
            short, _, _ = windows(h[a:b], np.array([0, b - a]), int(b - a))
            s = mix(short + _U(int(b - a)))
        else:
            continue
        sets.append(s)
        sizes[i + 1] = len(s)
    return (np.concatenate(sets) if sets else np.zeros(0, _U)), np.cumsum(sizes)


def super_min_hash(elements: np.ndarray, first: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures, one row a document.

    Each element deals the ranks 0, 1, 2, ... to the slots in an order of its own (a Fisher-Yates shuffle seeded by
    the element) and offers rank + fraction to each; a slot keeps the least offer. Rank j is dealt to all documents at
    once, and a document stops as soon as all its slots hold offers of rank j or less, as later ones are larger: long
    documents stop after a few ranks.
    """
    n = len(first) - 1
    sig = np.full((n, slots), np.iinfo(np.uint32).max, np.uint32)
    flat = sig.reshape(-1)
    count = np.diff(first)
    live = np.flatnonzero(count)
    doc = np.repeat(np.arange(n), count)
    state = elements
    order = None
    for j in range(slots):
        if not len(live):
            break
        if j == 1 or (j and not kept.all()):
            mask = np.zeros(n, bool)
            mask[live] = True
            stay = mask[doc]
            doc, state = doc[stay], state[stay]
            order = order[stay] if j > 1 else None
        if j == 1:  # only documents with open slots need the shuffle itself; redo its first swap
            order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(doc), 1))
            rows = np.arange(len(doc))
            order[rows, k0[stay]] = 0
        rnd = mix(state + _U((0x9E3779B97F4A7C15 * (j + 1)) & ((1 << 64) - 1)))
        fraction = (rnd & _U((1 << 24) - 1)).astype(np.uint32)
        k = j + ((rnd >> _U(32)) * _U(slots - j) >> _U(32)).astype(np.int64)
        if j == 0:
            slot = k0 = k
        else:
            rows = np.arange(len(doc))
            slot = order[rows, k].astype(np.int64)
            order[rows, k] = order[rows, j]
        np.minimum.at(flat, doc * slots + slot, (np.uint32(j) << np.uint32(24)) + fraction)
        worst = sig[live].max(axis=1) >> np.uint32(24)
        kept = worst > j
        live = live[kept]
    return sig


def digests(sets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit sums over each document's set."""
    out = []
    for h in (sets, mix(sets + _U(0x5851F42D4C957F2D))):
        sums = np.concatenate((np.zeros(1, _U), np.cumsum(h)))
        out.append((sums[first[1:]] - sums[first[:-1]]).view(np.int64))
    return out[0], out[1]


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, hash t of the text, set size n, digest d1 d2, a byte of each signature slot, and the band hashes (empty where n is 0) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(2), lower=True):
                sets, first = shingle_sets(c, k)
                sig = super_min_hash(sets, first)
                n = np.diff(first)
                d1, d2 = digests(sets, first)
                wide = mix(sig.astype(_U) + np.arange(1, SLOTS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
                bands = wide.reshape(c.n, BANDS, ROWS).sum(axis=2, dtype=_U)
                bands = mix(bands + np.arange(BANDS, dtype=_U))
                low = np.ascontiguousarray((mix(sig.astype(_U)) & _U(255)).astype(np.uint8))
                full = n > 0
                offsets = np.concatenate(([0], np.cumsum(np.where(full, BANDS, 0)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(c.first, c.n),
                        batch.column(1).slice(c.first, c.n),
                        pa.array(n),
                        pa.array(d1),
                        pa.array(d2),
                        pa.array([row.tobytes() for row in low], pa.binary()),
                        pa.ListArray.from_arrays(offsets, bands[full].view(np.int64).reshape(-1)),
                    ],
                    names=["doc_id", "t", "n", "d1", "d2", "sig", "bands"],
                )

    return docs.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(run, _SIGNED)


def _agreeing(pairs: DataFrame, sig: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes allow the similarity and whose signatures agree in AGREE of their slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SLOTS) for i in (2, 3))
            good = (x == y).sum(axis=1) >= AGREE * SLOTS
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(good)) for i in (0, 1)], names=["a", "b"])

    a, b = (sig.select(F.col("v").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"s_{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b")
    sized = both.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    return sized.select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """v and the shingle set as packed 64-bit hashes in ascending order, of the rows (v, d1, d2, text) whose text's set has the digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = [batch.column(i).to_numpy() for i in (1, 2)]
            for c in chunks(batch.column(3), lower=True):
                sets, first = shingle_sets(c, k)
                same = np.flatnonzero(np.logical_and(*(d == w[c.first : c.first + c.n] for d, w in zip(digests(sets, first), want, strict=True))))
                packed = [sets[first[i] : first[i + 1]].tobytes() for i in same]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(same + c.first)), pa.array(packed, pa.binary())], names=["v", "packed"])

    return docs.select("v", "d1", "d2", "text").mapInArrow(run, "v long, packed binary")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union of their full sets.

    a's set is sent once to every task that compares its partners: a star of many members is dealt over salts,
    and each task reads one centre followed by its members.
    """
    sized = pairs.groupBy("a").agg(F.count("*").alias("stars")).select("a", F.ceil(F.col("stars") / STAR).cast("int").alias("salts"))
    dealt = pairs.join(sized, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    own = sets.select(F.col("v").alias("b"), "packed")
    members = dealt.select("a", "b", "salt").join(own, "b").select("a", "salt", "b", "packed")
    centres = sized.join(sets.select(F.col("v").alias("a"), "packed"), "a").select(
        "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "packed"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, now = None, np.zeros(0, _U)
        for batch in batches:
            out: tuple[list[int], list[int]] = ([], [])
            for a, b, packed in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                x = np.frombuffer(packed.as_buffer(), _U)
                if b is None:
                    centre, now = a, x.copy()
                    continue
                assert a == centre
                both = _common(now, x)
                if 100 * both >= percent * (len(now) + len(x) - both):
                    out[0].append(a)
                    out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["a", "b"])

    together = centres.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return together.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """v and label, the smallest vertex reachable from v, for every vertex of edges (a, b).

    Each round takes the least label of all neighbours, then follows labels one step (pointer jumping); a round's labels are
    written to the shared folder. Rounds grow with the logarithm of the longest path of a group.
    """
    links = scratch.materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = scratch.materialize(links.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("label")), "labels")
    while True:
        seen = links.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        least = labels.join(seen, "v").select("v", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        up = labels.select(F.col("v").alias("to"), F.col("label").alias("upper"))
        moved = scratch.materialize(least.join(up, "to").select("v", F.least("to", "upper").alias("label"), "was"), "labels")
        done = moved.where("label <> was").limit(1).count() == 0
        scratch.discard(labels)
        labels = moved
        if done:
            scratch.discard(links)
            return labels.select("v", "label")


def _sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame, once: bool, k: int) -> DataFrame:
    """The sets of the wanted classes (v), from one row of each; once: no two rows share a doc_id."""
    keys = scratch.materialize(classes.select("v", "at", "t", "d1", "d2").join(wanted.select("v").distinct(), "v"), "wanted")
    rows = docs.join(scratch.broadcast_if_small(keys), (docs["doc_id"] == keys["at"]) & (F.xxhash64(docs["text"]) == keys["t"]))
    sets = full_sets(rows, k)
    sets = scratch.materialize(sets if once else sets.dropDuplicates(["v"]), "sets")
    scratch.discard(keys)
    return sets


def _sizes(members: DataFrame) -> DataFrame:
    """nb, the number of blocks of each bucket (of members whose g differ, where there is a g). It is a written table: a join with it can
    split a bucket of very many members."""
    count = F.ceil(F.count("*") / BLOCK).cast("int").alias("nb")
    if "g" not in members.columns:
        return scratch.materialize(members.groupBy("bucket").agg(count), "sizes")
    each = members.groupBy("bucket").agg(count, F.min("g").alias("lo"), F.max("g").alias("hi"))
    return scratch.materialize(each.where("lo < hi").select("bucket", "nb"), "sizes")


def _blocks(members: DataFrame) -> DataFrame:
    """Deals the members (with nb) of every bucket over pairs of blocks (i, j) of about BLOCK rows, so that each pair of members meets in
    one of them and no task holds a whole bucket. `own` is the row's block."""
    own = members.withColumn("own", F.pmod(F.xxhash64("v", "bucket"), F.col("nb")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return met.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("nb", "other")


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows with equal (bucket, i, j), from batches in that order."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "i", "j")], axis=1)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(key)], strict=True):
            if a == b:
                continue
            if held and tuple(key[a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(key[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _open_pairs(t: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of the group, the later rows that it may be linked with: in another group of documents, of a fitting size, with
    signatures that agree, and with no earlier band hash in common (there the pair meets already). `earlier` has the hashes of the bands
    before the bucket's: the bytes of the signature can't tell, as one in 256 slots that differ looks equal."""
    doc, g, n, own = (t.column(c).to_numpy() for c in ("v", "g", "n", "own"))
    band = t.column("band")[0].as_py()
    across = t.column("i")[0].as_py() != t.column("j")[0].as_py()
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, SLOTS)
    earlier = t.column("earlier").combine_chunks().flatten().to_numpy().reshape(len(doc), band)
    for x in range(len(doc) - 1):
        y = np.arange(x + 1, len(doc))
        fit = (g[y] != g[x]) & (doc[y] != doc[x]) & (np.minimum(n[y], n[x]) * 100 >= np.maximum(n[y], n[x]) * percent)
        if across:
            fit &= own[y] != own[x]
        y = y[fit]
        if len(y):
            y = y[(sig[y] == sig[x]).sum(axis=1) >= AGREE_LEFT * SLOTS]
            y = y[~(earlier[y] == earlier[x]).any(axis=1)]
            if len(y):
                yield x, y


def _left_over(sets_of, buckets: DataFrame, sig: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of one bucket that the stars have left in different groups.

    A first pass over signatures keeps the members that have any such partner; a second compares their full sets, in the same
    blocks, and gives a link for every two groups that it joins. Neither emits pairs that aren't links.
    """
    g = F.coalesce("label", "b")
    placed = scratch.materialize(buckets.join(groups.withColumnRenamed("v", "b"), "b", "left").select("bucket", "band", F.col("b").alias("v"), g.alias("g")), "placed")
    earlier = F.slice("bands", 1, F.col("band")).alias("earlier")

    def met(members: DataFrame, sizes: DataFrame) -> DataFrame:
        signed = members.join(sizes, "bucket").join(sig, "v")
        return _blocks(signed.select("bucket", "band", "v", "g", "n", "sig", earlier, "nb"))

    order = ["bucket", "i", "j"]

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_group(batches):
            found = np.zeros(len(t), bool)
            for x, y in _open_pairs(t, percent):
                found[x] = True
                found[y] = True
            if found.any():
                yield pa.RecordBatch.from_arrays([t.column(c).filter(pa.array(found)).combine_chunks() for c in ("bucket", "v")], names=["bucket", "v"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_group(batches):
            doc, g = t.column("v").to_numpy(), t.column("g").to_numpy()
            sets = [np.frombuffer(x.as_buffer(), _U) for x in t.column("packed")]
            parent: dict[int, int] = {}

            def root(v: int) -> int:
                while (up := parent.get(v, v)) != v:
                    v = up
                return v

            out: tuple[list[int], list[int]] = ([], [])
            for x, ys in _open_pairs(t, percent):
                for y in ys:
                    p, q = root(int(g[x])), root(int(g[y]))
                    if p != q:
                        both = _common(sets[x], sets[y])
                        if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                            parent[max(p, q)] = min(p, q)
                            out[0].append(int(doc[x]))
                            out[1].append(int(doc[y]))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], names=["a", "b"])

    dealt = met(placed, _sizes(placed)).repartition(*order).sortWithinPartitions(*order, "v")
    kept = scratch.materialize(dealt.mapInArrow(partners, "bucket long, v long").distinct(), "partners")
    sets = sets_of(kept)
    again = met(placed.join(kept, ["bucket", "v"]), _sizes(kept)).join(sets, "v")
    more = scratch.materialize(again.repartition(*order).sortWithinPartitions(*order, "v").mapInArrow(confirm, "a long, b long"), "more")
    scratch.discard(kept, sets)
    return more


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document (columns doc_id and text of docs; others are ignored).

    Words are [^\\x20\\x09-\\x0D]+ of the text with A-Z in lower case; documents are linked where 100 * intersection >=
    percent * union of their sets of k-word shingles. component_id is the smallest doc_id reachable over links.

    Null or wordless texts have no shingles and are linked with nothing. Repeated rows each get a row; rows that share a doc_id
    are one document, which is linked if any of its texts is. A row whose doc_id is null is its own group: component_id is null and it is kept. An empty
    table gives an empty result. Texts are read whole, whatever their length. The result is a table in the shared folder, the only
    one that stays there.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with scratch.scope() as stays:
        out = scratch.materialize(_near_duplicates(docs, percent, k), "near")
        stays.append(out)
    return out


def _near_duplicates(docs: DataFrame, percent: int, k: int) -> DataFrame:
    signed = scratch.materialize(signatures(docs, k).withColumn("row", F.monotonically_increasing_id()), "signed")
    shared_ids = signed.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1").select("doc_id")
    once = shared_ids.limit(1).count() == 0
    # v is the number of one row of the class; at and t are that row's doc_id and text hash
    by = ["d1", "d2", "n"]
    full = signed.where("n > 0 and doc_id is not null")
    classes = full.groupBy(*by).agg(F.min("row").alias("v"), F.min("doc_id").alias("least"), F.count("*").alias("times")).select("v", "least", "times")
    reps = full.join(classes, full["row"] == classes["v"]).select("v", F.col("doc_id").alias("at"), "t", "least", "times", *by, "sig", "bands")
    reps = scratch.materialize(reps, "reps")

    def sets_of(wanted: DataFrame) -> DataFrame:
        return _sets_of(docs, reps, wanted, once, k)

    banded = reps.select("v", F.posexplode("bands").alias("band", "bucket"))
    shared = banded.groupBy("bucket").agg(F.min("v").alias("a"), F.max("v").alias("z")).where("a < z")
    buckets = scratch.materialize(banded.join(shared.select("bucket", "a"), "bucket").select("bucket", "band", "a", F.col("v").alias("b")).distinct(), "buckets")
    stars = buckets.where("a < b").select("a", "b").distinct()
    sig = reps.select("v", "n", "sig", "bands")
    likely = scratch.materialize(_agreeing(stars, sig, percent), "likely")
    sets = sets_of(likely.select(F.explode(F.array("a", "b")).alias("v")))
    links = scratch.materialize(verified(likely, sets, percent), "linked")
    scratch.discard(sets, likely)
    groups = components(links)

    more = _left_over(sets_of, buckets, sig, groups, percent)
    scratch.discard(buckets)
    if not once:  # the texts of one doc_id are one document
        shared_ids = scratch.materialize(shared_ids, "shared_ids")
        texts = full.join(scratch.broadcast_if_small(shared_ids), "doc_id", "left_semi").select("doc_id", *by).distinct()
        texts = scratch.materialize(texts.join(reps.select("v", *by), by).select("doc_id", "v"), "texts")
        ends = scratch.materialize(texts.groupBy("doc_id").agg(F.min("v").alias("a"), F.max("v").alias("z")).where("a < z").select("doc_id", "a"), "ends")
        more = more.unionByName(texts.join(scratch.broadcast_if_small(ends), "doc_id").where("v <> a").select("a", F.col("v").alias("b")))
    if more.limit(1).count():
        groups = components(links.unionByName(more))
    lowest = groups.join(reps.select("v", "least"), "v").groupBy("label").agg(F.min("least").alias("component_id"))
    placed = groups.join(scratch.broadcast_if_small(scratch.materialize(lowest, "lowest")), "label").select("v", "component_id")
    # classes whose rows don't all have their own doc_id as component_id
    named = reps.select("v", "least", "times", *by).join(placed, "v", "left").withColumn("component_id", F.coalesce("component_id", "least"))
    whole = scratch.materialize(named.where("times > 1 or component_id < least").select(*by, "component_id"), "whole")
    out = signed.select("doc_id", *by).join(scratch.broadcast_if_small(whole), by, "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    if not once:
        out = scratch.materialize(out, "out")
        least = out.join(scratch.broadcast_if_small(shared_ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("least"))
        out = out.join(scratch.broadcast_if_small(scratch.materialize(least, "least")), "doc_id", "left").withColumn("component_id", F.coalesce("least", "component_id")).drop("least")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
