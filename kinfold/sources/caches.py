"""Stored state between runs: fingerprints, cached vectors and parsed records as Parquet tables."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
DEPS = "array<struct<path:string,size:bigint,mtime:timestamp>>"


def fingerprint(*columns: str) -> Column:
    """SHA-1 of the columns' text put together without separators; null counts as empty."""
    return F.sha1(F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))


def safe_fingerprint(*columns: str) -> Column:
    """The same with each text's length before it, so that moved borders differ."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.sha1(F.concat(*(x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p))))


def model_key(kind: str, model: str = "") -> str:
    return {"remote": f"remote:{model}", "mock": "mock"}.get(kind, f"local:{model}")


def config_fingerprint(allow_ignores: bool, extensions: tuple[str, ...]) -> str:
    return hashlib.sha1(json.dumps([allow_ignores, sorted(extensions)]).encode()).hexdigest()


def component_fingerprint(columns: list[str]) -> Column:
    return F.sha1(F.to_json(F.struct(*columns)))


def read_cache(spark: SparkSession, path: str, schema: str, version: int = VERSION) -> DataFrame:
    """The rows of this version; empty if there is no readable cache."""
    try:
        found = spark.read.schema(f"version int, {schema}").parquet(path)
        return found.where(F.col("version") == version).drop("version")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def write_cache(rows: DataFrame, path: str, version: int = VERSION) -> None:
    """Rows may be read from the cache itself: they are written beside it first, and then take its place."""
    spark, beside = rows.sparkSession, f"{path}.new"
    rows.withColumn("version", F.lit(version)).write.mode("overwrite").parquet(beside)
    new, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (beside, path))
    store = new.getFileSystem(spark._jsc.hadoopConfiguration())
    store.delete(old, True)
    if not store.rename(new, old):
        raise OSError(f"{beside} could not take the place of {path}")


def _same(rows: DataFrame, cache: DataFrame, keys: list[str], state: list[str]) -> DataFrame:
    old = cache.select(*(F.col(k).alias(f"_{k}") for k in keys + state), F.lit(True).alias("_known"))
    on = [F.col(k) == F.col(f"_{k}") for k in keys]
    equal = F.coalesce("_known", F.lit(False))
    for s in state:
        equal = equal & F.col(s).eqNullSafe(F.col(f"_{s}"))
    return rows.join(old, on, "left").withColumn("hit", equal).drop(*(f"_{k}" for k in keys + state), "_known")


def hits_and_misses(rows: DataFrame, cache: DataFrame, keys: list[str], state: list[str]) -> DataFrame:
    """One row: of rows, how many the cache has with equal state, and how many not."""
    found = _same(rows, cache, keys, state)
    return found.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def stale(rows: DataFrame, cache: DataFrame, keys: list[str], state: list[str]) -> DataFrame:
    """The rows that have to be made again."""
    return _same(rows, cache, keys, state).where("not hit").drop("hit")


def cached_vectors(entries: DataFrame, cache: DataFrame, parts: tuple[str, ...] = ("code", "style", "structure", "holistic")) -> DataFrame:
    """entries (id, model_key, fingerprint) with the cached vectors of the same fingerprint, and complete: whether none is missing."""
    names = [f"{p}_vec" for p in parts]
    out = entries.join(cache.select("id", "model_key", "fingerprint", *names), ["id", "model_key", "fingerprint"], "left")
    whole = F.lit(True)
    for n in names:
        whole = whole & (F.coalesce(F.size(n), F.lit(0)) > 0)
    return out.withColumn("complete", whole)


def vanished(cache: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Cache rows whose key is no longer there."""
    return cache.join(present.select(*keys).distinct(), keys, "left_anti")


def cleaned(cache: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Cache rows whose key is still there."""
    return cache.join(present.select(*keys).distinct(), keys, "left_semi")


def file_records(files: DataFrame, components: DataFrame, now: DataFrame, config: str) -> DataFrame:
    """path, size, mtime, config and deps (path, size, mtime; null where there is no such file) of parsed files (path, size, mtime), from
    their components' style_paths and the listing `now` (path, size, mtime)."""
    imports = components.select("path", F.explode("style_paths").alias("dep")).distinct()
    known = now.select(F.col("path").alias("dep"), F.col("size").alias("dep_size"), F.col("mtime").alias("dep_mtime"))
    each = imports.join(known, "dep", "left").groupBy("path").agg(F.collect_list(F.struct(F.col("dep").alias("path"), F.col("dep_size").alias("size"), F.col("dep_mtime").alias("mtime"))).alias("deps"))
    return files.select("path", "size", "mtime").join(each, "path", "left").select("path", "size", "mtime", F.lit(config).alias("config"), F.coalesce("deps", F.expr(f"cast(array() as {DEPS})")).alias("deps"))


def _dependencies(cached: DataFrame, now: DataFrame) -> DataFrame:
    """path of each cached file, with the dependencies' state then and now (null where there is none)."""
    deps = cached.select("path", F.explode("deps").alias("d")).select("path", F.col("d.path").alias("dep"), F.col("d.size").alias("size"), F.col("d.mtime").alias("mtime"))
    known = now.select(F.col("path").alias("dep"), F.col("size").alias("now_size"), F.col("mtime").alias("now_mtime"))
    return deps.join(known, "dep", "left")


def valid_files(cached: DataFrame, files: DataFrame, config: str) -> DataFrame:
    """Cached file records (path, size, mtime, config, deps: array of path, size, mtime) that still hold: the same settings, and the file
    and everything that it depends on unchanged in files (path, size, mtime); what was missing must still be."""
    same = cached.where(F.col("config") == config).join(files.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_semi")
    changed = _dependencies(same, files).where("not (size <=> now_size and mtime <=> now_mtime)").select("path").distinct()
    return same.join(changed, "path", "left_anti")


def cleaned_files(cached: DataFrame, files: DataFrame) -> DataFrame:
    """Cached file records whose file is still in files, and all once present dependencies too."""
    gone = _dependencies(cached, files).where("size is not null and now_size is null").select("path").distinct()
    return cleaned(cached, files, ["path"]).join(gone, "path", "left_anti")
