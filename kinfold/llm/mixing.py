"""Mixing sources to target weights by a time-varying curriculum, with DataFrame operations only.

Every source has a weight schedule over training time t from 0 to 1, whose integral over the whole run is its target. A
document takes the place in its source where the source's cumulative demand reaches the words before it; inverting the
demand gives the document's training position, and documents are sorted by position over ranges.

Running sums within a source are made in two levels, as a source may hold any share of all rows: hash-dealt cells of about
CELL documents are summed first, the cells' sums are run over their source, and the documents over their cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import checkpoints as scratch

#: Documents of one cell, about.
CELL = 4096
#: No source is taken more often than this.
MOST = 3
#: Slope of the schedules: source weights change linearly from 1 - s to 1 + s times their mean, with s dealt over sources
#: from -SLOPE to SLOPE by rank.
SLOPE = 0.5
WORDS = "[^\\x20\\x09-\\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """Adds w and target to rows (source, source_size), of which there is one for each source.

    Sources by code point, null last, weigh `weights` in turn and share the sum of all sizes in proportion; none gets more than
    `most` times its size, and what that leaves is shared by weight again until none is above. Sorted by size / weight, the
    capped sources come first; with the sum of their caps C and the others' weights W, the others get w * (total - C) / W.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), ((rank - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", rank).withColumn("w", w)
    by_cap = Window.orderBy(F.col("source_size") / F.col("w"), "rank")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = F.col("source_size") * F.lit(float(most))
    shared = (
        ranked.withColumn("cap", cap)
        .withColumn("total", F.sum("source_size").over(everywhere).cast("double"))
        .withColumn("all_w", F.sum("w").over(everywhere))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("caps_before")) / (F.col("all_w") - F.col("w_before")))
        .withColumn("capped", F.col("w") * F.col("level") >= F.col("cap"))
    )
    # the level that holds is that of the first source that isn't capped; where all are, each has its cap
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("w"), "rank", "level"))).over(everywhere)["level"]
    target = F.when(F.col("capped") | level.isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * level))
    return shared.withColumn("target", target).select("source", "source_size", "rank", "w", "target")


def position(done: Column, target: Column, slope: Column) -> Column:
    """The time t at which a source has been asked for `done` of its target, with weight 1 + slope * (2t - 1) at t.

    The integral to t is t * (1 - slope) + slope * t * t, so t is the root of that quadratic."""
    share = F.when(target > 0, F.least(done / target, F.lit(1.0))).otherwise(F.lit(0.0))
    one = F.lit(1.0) - slope
    root = F.sqrt(F.greatest(one * one + slope * share * 4, F.lit(0.0)))
    return share * 2 / (one + root)


def mix(docs: DataFrame, most: int = MOST, slope: float = SLOPE) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, positions and weight of every document, sorted by first position.

    size counts the words [^\\x20\\x09-\\x0D]+ of the text (null: 0). taken are the words the mix takes of the document, repeats
    counted: whole passes over its source and, of the last pass, what is left of the target in the source's order (by md5 of
    doc_id, then doc_id, then size); the document at the end of the target is taken in part, so each source meets its target but
    for a fraction of a word. positions holds the training time of each copy that is begun, empty for documents that are
    not taken; those come last.

    A null source is a source of its own, sorted last. Rows with a null doc_id are placed by the md5 of their text. Repeated rows
    are documents of their own: each has a row, and their parts together are the same in every run. Sources without words get
    a target of 0. An empty table gives an empty result. Other columns of docs are ignored.
    """
    n_words = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORDS)), F.lit(0)).cast("long")
    key = F.coalesce(F.md5(F.col("doc_id").cast("long").cast("string")), F.md5(F.col("text").cast("string")), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words.alias("size"), key.alias("key"))
    keyed = scratch.materialize(own, "sizes")  # texts are read once; the rest works on these few columns
    per_source = keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    targets = source_targets(per_source.select("source", "source_size"), most=most).join(
        per_source.select(F.col("source").alias("s"), F.ceil(F.col("docs") / CELL).alias("cells")), F.col("source").eqNullSafe(F.col("s"))
    )
    sources = F.count("*").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    spread = F.lit(slope) * (F.when(sources > 1, F.lit(2.0) * (F.col("rank") - 1) / (sources - 1) - 1).otherwise(F.lit(0.0)))
    facts = targets.select("s", "source_size", "target", "cells", spread.alias("slope"))
    # a cell is a range of keys: the leading 28 bits of md5, evenly dealt
    lead = F.coalesce(F.conv(F.substring("key", 1, 7), 16, 10).cast("long"), F.lit(0))
    celled = (
        keyed.join(facts, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("cell", F.floor(lead * F.col("cells") / F.lit(1 << 28)).cast("long"))
        .drop("s", "cells")
    )
    sums = celled.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    ahead = F.sum("cell_size").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    bases = sums.select(F.col("source").alias("s"), F.col("cell").alias("c"), F.coalesce(ahead, F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "cell").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        celled.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(bases, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c")))
        .withColumn("before", F.col("base") + F.col("inner"))
    )
    wanted = F.floor(F.col("target")).cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(wanted / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    counted = placed.withColumn("passes", passes).withColumn("left", wanted - F.col("passes") * F.col("source_size"))
    part = F.greatest(F.least(F.col("left") - F.col("before"), F.col("size")), F.lit(0))
    taken = counted.withColumn("taken", F.col("passes") * F.col("size") + part).withColumn("part", part)
    copies = F.col("passes") + F.when(F.col("part") > 0, 1).otherwise(0)
    begun = F.when((copies > 0) & (F.col("taken") > 0), F.sequence(F.lit(0).cast("long"), copies - 1)).otherwise(F.array().cast("array<long>"))
    times = F.transform(begun, lambda c: position((F.col("before") + c * F.col("source_size")).cast("double"), F.col("target"), F.col("slope")))
    out = taken.withColumn("positions", times).withColumn("position", F.coalesce(F.try_element_at("positions", F.lit(1)), F.lit(2.0)))
    chosen = out.select("doc_id", "source", "size", "source_size", "target", "taken", "positions", "position")
    return chosen.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id").drop("position")


def training_order(mixed: DataFrame) -> DataFrame:
    """doc_id, source, copy (from 0), words (of that copy) and position of every copy that mix() takes, sorted by position over ranges."""
    copies = mixed.select("doc_id", "source", "size", "taken", F.posexplode("positions").alias("copy", "position"))
    words = F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size")).alias("words")
    return copies.select("doc_id", "source", "copy", words, "position").repartitionByRange("position", "doc_id", "copy").sortWithinPartitions("position", "doc_id", "copy")
