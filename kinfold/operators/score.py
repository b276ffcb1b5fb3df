"""The scorecard of a run and its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def suppression_counts(verdicts: DataFrame) -> DataFrame:
    """reason and n over verdicts with a reason."""
    return verdicts.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def top_reasons(counts: DataFrame, n: int = 3) -> DataFrame:
    return counts.orderBy(F.desc("n"), "reason").limit(n)


def scorecard(totals: DataFrame, best: DataFrame, counts: DataFrame) -> DataFrame:
    """One row: evaluated, mean, top, covered, least and highest best match, and suppressed; 0 where there is nothing."""
    ends = best.agg(F.count("*").alias("covered"), F.coalesce(F.min("best"), F.lit(0.0)).alias("min_best"), F.coalesce(F.max("best"), F.lit(0.0)).alias("max_best"))
    gone = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("suppressed"))
    mean = F.when(F.col("checked") > 0, F.col("total") / F.col("checked")).otherwise(F.lit(0.0))
    row = totals.join(F.broadcast(ends)).join(F.broadcast(gone))  # one row each
    r = lambda c: F.round(c, 4)
    return row.select(F.col("checked").alias("evaluated"), r(mean).alias("mean"), r(F.col("top")).alias("top"), "covered", r(F.col("min_best")).alias("min_best"), r(F.col("max_best")).alias("max_best"), "suppressed")


def coverage(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """How many components are in a pair, of how many, and the rounded percentage."""
    paired = pairs.select(F.explode(F.array("a", "b")).alias("id")).agg(F.count_distinct("id").alias("paired"))
    total = components.agg(F.count("*").alias("total"))
    share = F.when(F.col("total") > 0, F.round(F.col("paired") * 100 / F.col("total"))).otherwise(0).cast("long")
    return paired.join(F.broadcast(total)).select("paired", "total", share.alias("percent"))
