"""Filters of components by name and by what they use."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.files import any_glob


def valid(patterns: tuple[str, ...]) -> list[str]:
    """The patterns that are regular expressions; others are dropped."""
    out = []
    for p in patterns:
        try:
            re.compile(p)
        except re.error:
            continue
        out.append(p)
    return out


def _matches(pattern: str):
    return lambda x: x.rlike(pattern)


def kept(components: DataFrame, names: tuple[str, ...] = (), usages: tuple[str, ...] = ()) -> DataFrame:
    """Without components whose name, or any tag or reference, matches."""
    gone = F.lit(False)
    for p in valid(names):
        gone = gone | F.coalesce(F.col("name").rlike(p), F.lit(False))
    used = F.concat(text.present(F.col("tags")), text.present(F.col("refs")))
    for p in valid(usages):
        gone = gone | F.exists(used, _matches(p))
    return components.where(~gone)


def mark_targets(components: DataFrame, globs: tuple[str, ...], root: str = "") -> DataFrame:
    """Adds target: whether the path, whole or relative to root, matches a glob."""
    rel = F.regexp_replace("path", "^" + re.escape(root.rstrip("/") + "/"), "") if root else F.col("path")
    return components.withColumn("target", any_glob(F.col("path"), globs) | any_glob(rel, globs))
