"""Ordering and selection of reported pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import materialize


def ordered(pairs: DataFrame) -> DataFrame:
    """By rounded similarity, highest first; equals by a, then b."""
    return pairs.orderBy(F.desc(F.round("similarity", 4)), "a", "b")


def placed(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Adds rank, the row's place in the order from 1 on, over any number of rows: ranges are sorted apart, and each begins after the
    counts of those before it. A row for each range reaches the driver."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    dealt = materialize(dealt, "ranges")
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first")).orderBy("part").collect()
    base, ahead = [], 0
    for r in counts:
        base.append((r["part"], ahead, r["first"]))
        ahead += r["n"]
    bases = F.broadcast(rows.sparkSession.createDataFrame(base, "part int, ahead long, first long"))
    return dealt.join(bases, "part").withColumn("rank", F.col("ahead") + F.col("at") - F.col("first") + 1).drop("part", "at", "ahead", "first")


def top_pairs(pairs: DataFrame, n: int) -> DataFrame:
    return ordered(pairs).limit(n)


def limit_pairs(pairs: DataFrame, limit: int | None) -> DataFrame:
    """In that order, accepts a pair while both of its ends are in fewer than `limit` accepted pairs.

    Done in rounds: an undecided pair is accepted if its rank among the undecided pairs of each end is within what that end
    has left; pairs at a full end are dropped. That equals the sequential selection, and rounds are few.
    """
    if limit is None:
        return ordered(pairs)
    open_ = materialize(pairs.select("a", "b", "similarity").withColumn("s", F.round("similarity", 4)), "open")
    taken = open_.limit(0)
    while open_.limit(1).count():
        used = taken.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("used"))
        ends = open_.select("a", "b", "s", F.explode(F.array("a", "b")).alias("id"))
        rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("s"), "a", "b"))
        fits = ends.withColumn("rank", rank).join(used, "id", "left").withColumn("fits", F.col("rank") <= limit - F.coalesce("used", F.lit(0)))
        good = fits.groupBy("a", "b").agg(F.min(F.col("fits").cast("int")).alias("ok")).where("ok = 1").select("a", "b")
        taken = materialize(taken.unionByName(open_.join(good, ["a", "b"])), "taken")
        full = taken.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= limit).select("id")
        rest = open_.join(good, ["a", "b"], "left_anti")
        for end in "ab":
            rest = rest.join(full.withColumnRenamed("id", end), end, "left_anti")
        open_ = materialize(rest.select("a", "b", "similarity", "s"), "open")
    return ordered(taken.drop("s"))
