"""Style text of components: rules of imported files that their classes use, and styles inside scripts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.files import style_path


#: Where class names and style templates stand in scripts: fixed values.
MEMBER = r"styles\.([A-Za-z0-9_-]+)"
INDEXED = r"""styles\[['"]([^'"]+)['"]\]"""
TEMPLATES = (r"css`([\s\S]*?)`", r"styled\.[^(]+`([\s\S]*?)`", r"styled\([^`]+`([\s\S]*?)`")


def class_names(classes: Column, source: Column) -> Column:
    """Classes in markup and members of a styles object."""
    return F.array_distinct(F.concat(text.present(classes), *(F.regexp_extract_all(source, F.lit(p), F.lit(1)) for p in (MEMBER, INDEXED))))


def css_in_js(source: Column) -> Column:
    """The bodies of css, styled.x and styled(x) templates, in that order, a line end between."""
    return F.array_join(F.concat(*(F.regexp_extract_all(source, F.lit(k), F.lit(1)) for k in TEMPLATES)), "\n")


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges with both ends inside, those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _closing(css: str) -> dict[int, int]:
    """Where each open brace that is closed is closed."""
    out, open_ = {}, []
    for m in re.finditer("[{}]", css):
        if m[0] == "{":
            open_.append(m.start())
        elif open_:
            out[open_.pop()] = m.start()
    return out


def used_rules(css: str, classes: list[str]) -> str:
    """The rules of css that follow the name of one of the classes (in any case): the next brace with what it closes, and its selector
    back to the last closing brace or semicolon. Rules without a closing brace are left out, an empty line goes between those kept, and
    rules that touch stay as they stand."""
    if not classes:
        return ""
    names = re.compile(r"\.(?:" + "|".join(re.escape(n.lower()) for n in classes) + ")(?![A-Za-z0-9_-])")
    closing = _closing(css)
    braces = sorted({css.find("{", m.start()) for m in names.finditer(css.lower())})
    found = [(max(css.rfind("}", 0, b), css.rfind(";", 0, b)) + 1, closing[b]) for b in braces if b in closing]
    return "\n\n".join(x for a, b in merged(found) if (x := css[a : b + 1].strip()))


def filter_rules(rows: DataFrame, css: str, classes: str, into: str) -> DataFrame:
    """Adds `into`, used_rules() of columns css and classes; brace matching isn't regular, so it runs in Arrow batches."""

    def run(pair: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in pair:
            yield pd.Series([used_rules(x or "", list(y) if y is not None else []) for x, y in zip(a, b, strict=True)])

    return rows.withColumn(into, F.pandas_udf(run, "string")(F.col(css), F.col(classes)))


def load_styles(components: DataFrame, files: DataFrame) -> DataFrame:
    """Adds style_text, style_paths, css_in_js and has_styles to components (path, ordinal, classes, source, style_imports) from style
    files (path, source).

    Text inside the script comes first, then the used rules of each import in order; files don't count without class names.
    style_paths are all imports, whether their files exist or not.
    """
    named = components.withColumn("class_list", class_names(F.col("classes"), F.col("source"))).withColumn("inner_css", css_in_js(F.col("source")))
    named = named.withColumn("style_paths", F.array_distinct(F.transform("style_imports", style_path)))
    each = named.where(F.size("class_list") > 0).select("path", "ordinal", "class_list", F.posexplode("style_paths").alias("pos", "imported"))
    sheets = files.select(style_path(F.col("path")).alias("imported"), F.col("source").alias("css")).dropDuplicates(["imported"])
    used = filter_rules(each.join(sheets, "imported"), "css", "class_list", "rules").where("rules <> ''")
    lists = used.groupBy("path", "ordinal").agg(F.array_sort(F.collect_list(F.struct("pos", "rules"))).alias("s"))
    inner = F.when(F.col("inner_css") != "", F.array("inner_css")).otherwise(F.array().cast("array<string>"))
    rules = F.coalesce(F.transform("s", lambda x: x["rules"]), F.array().cast("array<string>"))
    out = named.join(lists, ["path", "ordinal"], "left").withColumn("style_text", F.array_join(F.concat(inner, rules), "\n"))
    return out.withColumn("css_in_js", F.col("inner_css") != "").withColumn("has_styles", F.col("style_text").rlike("\\S")).drop("s", "class_list", "inner_css")
