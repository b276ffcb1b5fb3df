"""Suppression rules. Facts about a component are columns made once before the join; a pair's verdict is one chain of conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sets, text

#: Reasons in the order in which they are tried; the first that holds counts.
REASONS = ("compare-filter", "over-max-threshold", "near-path", "component-composition", "wrapper-different-base", "wrapper-specialization", "low-signal-pair")
LISTS = ("hooks", "logic", "literals", "tags", "texts", "classes", "refs", "prop_names")


def signal_score() -> Column:
    """Up to two distinct items of each of five lists, summed."""
    return sum((F.least(F.size(F.array_distinct(text.present(F.col(c)))), F.lit(2)) for c in ("logic", "hooks", "classes", "texts", "prop_names")), F.lit(0))


def has_props() -> Column:
    return (F.size(text.present(F.col("prop_names"))) + F.coalesce(F.col("spreads"), F.lit(0))) > 0


def is_wrapper() -> Column:
    """Marked as one, or short with few kinds of tags, props, and no logic of its own."""
    wide = (
        (text.filled_line_count(F.col("source")) <= 8)
        & (F.size(F.array_distinct(text.present(F.col("tags")))) <= 2)
        & has_props()
        & (F.size(text.present(F.col("logic"))) == 0)
        & (F.size(text.present(F.col("hooks"))) == 0)
        & (F.size(text.present(F.col("texts"))) <= 2)
    )
    return F.coalesce(F.col("wrapper"), F.lit(False)) | wide


def facts(components: DataFrame) -> DataFrame:
    """ord, name, dirs (leaf first), and what the rules need of each component; null lists count as empty."""
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    return components.select(
        "ord",
        "name",
        F.reverse(F.filter(F.split(folder, "/"), lambda x: x != "")).alias("dirs"),
        text.present(F.col("refs")).alias("refs"),
        F.coalesce("target", F.lit(False)).alias("target"),
        is_wrapper().alias("wraps"),
        sets.top_item(F.col("tags")).alias("top_tag"),
        signal_score().alias("signal"),
        has_props().alias("props"),
        text.filled_line_count(F.col("source")).alias("lines"),
        *(F.size(text.present(F.col(c))).alias(f"n_{c}") for c in ("logic", "hooks", "texts", "literals")),
    )


def path_distance(a: Column, b: Column) -> Column:
    """The place, from the leaf folder up, of the first folder that differs; 0 for equal folders."""
    n = F.greatest(F.size(a), F.size(b))
    places = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    off = F.filter(places, lambda i: (i <= n) & ~F.try_element_at(a, i).eqNullSafe(F.try_element_at(b, i)))
    return F.coalesce(F.array_min(off), F.lit(0))


def joined_facts(pairs: DataFrame, facts_: DataFrame) -> DataFrame:
    """Pairs (a, b, similarity) with both sides' facts as structs x and y."""
    one = facts_.select(F.col("ord").alias("a"), F.struct("*").alias("x"))
    two = facts_.select(F.col("ord").alias("b"), F.struct("*").alias("y"))
    return pairs.join(one, "a").join(two, "b")


def reason(top: float = 1.0, least_distance: int = 0, compare: bool = False) -> Column:
    """The first reason that holds for a row of joined_facts(), null if none does."""
    x, y = F.col("x"), F.col("y")
    both_wrap = x["wraps"] & y["wraps"]
    few = (x["n_logic"] + y["n_logic"] == 0) & (x["n_hooks"] + y["n_hooks"] == 0) & (x["n_texts"] + y["n_texts"] <= 3) & (x["n_literals"] + y["n_literals"] <= 6)
    rules = [
        (F.lit(compare) & (x["target"] == y["target"]), REASONS[0]),
        (F.col("similarity") - top > 1e-6, REASONS[1]),
        (F.lit(least_distance > 0) & (path_distance(x["dirs"], y["dirs"]) < least_distance), REASONS[2]),
        (F.array_contains(x["refs"], y["name"]) | F.array_contains(y["refs"], x["name"]), REASONS[3]),
        (both_wrap & sets.disjoint(x["refs"], y["refs"]), REASONS[4]),
        (both_wrap & (F.coalesce(x["top_tag"] == y["top_tag"], F.lit(False)) | few), REASONS[5]),
        (
            (x["lines"] <= 16) & (y["lines"] <= 16) & (x["props"] | y["props"] | x["wraps"] | y["wraps"]) & (x["signal"] <= 2) & (y["signal"] <= 2),
            REASONS[6],
        ),
    ]
    return F.coalesce(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for test, name in rules))
