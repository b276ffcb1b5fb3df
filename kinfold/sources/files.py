"""Source files, style files and suites as DataFrames."""

from __future__ import annotations

import json
import re
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files that a scan takes by default, and those that it leaves out: fixed values.
INCLUDE = ("**/*.{ts,tsx,js,jsx}",)
EXCLUDE = ("**/node_modules/**", "**/dist/**", "**/coverage/**", "**/*.d.ts")
STYLE_EXTENSIONS = (".css", ".scss", ".sass", ".less")


def glob_regex(glob: str) -> str:
    """The regular expression of a glob with **, *, ?, {a,b} and [..], for whole paths with /."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            inside = glob[i + 1 : end]
            out += "[" + ("^" + inside[1:] if inside[:1] in "!^" else inside) + "]"
            i = end + 1
            continue
        if c == "{":
            depth += 1
            out += "(?:"
        elif c == "}" and depth:
            depth -= 1
            out += ")"
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        i += 1
    return f"^{out}$"


def any_glob(path: Column, globs: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for g in globs:
        found = found | path.rlike(glob_regex(g))
    return found


def selected(files: DataFrame, path: str = "path", include: tuple[str, ...] = INCLUDE, exclude: tuple[str, ...] = EXCLUDE) -> DataFrame:
    """The rows whose path, relative to the root, is included and not excluded."""
    return files.where(any_glob(F.col(path), include) & ~any_glob(F.col(path), exclude))


def read_sources(spark: SparkSession, root: str, include: tuple[str, ...] = INCLUDE, exclude: tuple[str, ...] = EXCLUDE) -> DataFrame:
    """path (relative), source, size and mtime of every selected file below root, in collation order of path."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    state = (F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    files = selected(raw.select(_below(root).alias("path"), F.decode("content", "UTF-8").alias("source"), *state), "path", include, exclude)
    # one row for each file: names are ordered by collation, as people read them
    return files.dropDuplicates(["path"]).orderBy(F.expr("path collate unicode"))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), size and mtime of every file below root."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return raw.select(_below(root).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def _below(root: str) -> Column:
    base = re.sub(r"^[a-z]+:/*", "/", root).rstrip("/") + "/"
    return F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + re.escape(base), "")


def style_path(path: Column) -> Column:
    """With .css where it has no known extension."""
    known = F.lit(False)
    for e in STYLE_EXTENSIONS:
        known = known | path.endswith(e)
    return F.when(known, path).otherwise(F.concat(path, F.lit(".css")))


def component_ref(ref: Column) -> Column:
    """path and name of "path#name", split at the last #; raises without one."""
    bad = F.raise_error(F.concat(F.lit("no component name in "), ref))
    name = F.when(F.instr(ref, "#") > 0, F.substring_index(ref, "#", -1)).otherwise(bad)
    return F.struct(F.regexp_extract(ref, "^(.*)#[^#]*$", 1).alias("path"), name.alias("name"))


def load_suite(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """groups (group_id, label, id) and hard negatives (a, b, reason) of a JSON manifest; raises if it isn't valid."""
    text = "\n".join(r[0] for r in spark.read.option("lineSep", "\0").text(path).collect())
    return suite_tables(spark, json.loads(text))


def suite_tables(spark: SparkSession, suite: dict) -> tuple[DataFrame, DataFrame]:
    groups, seen, positive = [], set(), set()
    for g in suite.get("groups", []):
        if not g.get("id") or g["id"] in seen:
            raise ValueError(f"a group needs an id of its own: {g.get('id')}")
        seen.add(g["id"])
        members = list(dict.fromkeys(g.get("members", [])))
        if len(members) < 2:
            raise ValueError(f"group {g['id']} needs two members or more")
        groups += [(g["id"], g.get("label"), m) for m in members]
        positive |= {frozenset((a, b)) for a in members for b in members if a != b}
    hard, pairs = [], set()
    for h in suite.get("hardNegatives", []):
        pair = frozenset((h["a"], h["b"]))
        if len(pair) < 2 or pair in positive or pair in pairs:
            raise ValueError(f"not a hard negative: {sorted(pair)}")
        pairs.add(pair)
        hard.append((h["a"], h["b"], h.get("reason")))
    return spark.createDataFrame(groups, "group_id string, label string, id string"), spark.createDataFrame(hard, "a string, b string, reason string")


def relative(path: str, root: str) -> str:
    p = PurePosixPath(path)
    return str(p.relative_to(root)) if p.is_relative_to(root) else path
