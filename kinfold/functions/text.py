"""String scalars as column expressions; all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the Unicode class plus the byte order mark.
SPACE = r"(?U)[\s\x{FEFF}]"


def normalize(text: Column) -> Column:
    """Without block and line comments (a URL's tail counts as one), white space collapsed and trimmed."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", ""), r"//[^\n\r]*", "")
    return F.regexp_replace(F.regexp_replace(plain, SPACE + "+", " "), "^ | $", "")


def present(items: Column) -> Column:
    """The array without nulls and empty strings; null counts as empty."""
    kept = F.filter(items, lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(kept, F.array().cast("array<string>"))


def unique(items: Column) -> Column:
    """Distinct present items in order of first appearance."""
    return F.array_distinct(present(items))


def tokenize(text: Column) -> Column:
    """Lower-case runs of ASCII word characters."""
    return F.filter(F.split(F.lower(text), r"\W+"), lambda x: x != "")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_count(text: Column) -> Column:
    return F.coalesce(F.size(lines(text)), F.lit(0))


def filled_lines(text: Column) -> Column:
    return F.filter(lines(text), lambda x: ~x.rlike(f"^{SPACE}*$"))


def filled_line_count(text: Column) -> Column:
    return F.coalesce(F.size(filled_lines(text)), F.lit(0))


def clip(text: Column, most: int) -> Column:
    """At most `most` characters, the last three of a longer text being dots."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def snippet(text: Column, count: int = 12, most: int = 120) -> Column:
    """The first filled lines, clipped and joined by line ends."""
    return F.array_join(F.transform(F.slice(filled_lines(text), 1, count), lambda x: clip(x, most)), "\n")


def short_path(path: Column) -> Column:
    """Of more than five segments (joined by >) the first two and the last two, with dots between."""
    parts = F.split(path, ">")
    cut = F.concat(F.slice(parts, 1, 2), F.array(F.lit("...")), F.slice(parts, -2, 2))
    return F.array_join(F.when(F.size(parts) > 5, cut).otherwise(parts), ">")


def or_none(items: Column, sep: str) -> Column:
    return F.when(F.size(items) > 0, F.array_join(items, sep)).otherwise(F.lit("none"))
