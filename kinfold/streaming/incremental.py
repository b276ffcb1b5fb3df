"""Incremental runs over a stream of files: each micro-batch re-parses what has changed and updates stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import parse
from ..sources import caches

FILES = "path string, size long, mtime timestamp, source string"


def changed(batch: DataFrame, known: DataFrame) -> DataFrame:
    """The newest row of each path in a batch that isn't known with the same size and time."""
    newest = batch.groupBy("path").agg(F.max(F.struct("mtime", "size", "source")).alias("f")).select("path", "f.size", "f.mtime", "f.source")
    return caches.stale(newest, known.select("path", "size", "mtime"), ["path"], ["size", "mtime"])


def process(spark: SparkSession, batch: DataFrame, batch_id: int, state: str) -> None:
    """Parses the changed files of one batch into a version of its own below `state`. A batch that is run again after a failure
    overwrites its own version only, so each file counts once."""
    known = current(spark, state, "files", "path string, size long, mtime timestamp, batch long").where(F.col("batch") < batch_id)
    fresh = changed(batch, known).persist()
    try:
        fresh.select("path", "size", "mtime", F.lit(batch_id).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{state}/files/batch={batch_id}/")
        parse.parse_files(fresh).withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{state}/components/batch={batch_id}/")
    finally:
        fresh.unpersist()


def current(spark: SparkSession, state: str, name: str, schema: str) -> DataFrame:
    """The rows of the newest version of each path; empty before the first batch."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{state}/{name}")
    except AnalysisException:
        return spark.createDataFrame([], schema)
    newest = rows.groupBy("path").agg(F.max("batch").alias("newest"))
    return rows.join(newest, "path").where("batch = newest").drop("newest")


def components(spark: SparkSession, state: str) -> DataFrame:
    """The components of the newest version of every file, without those of versions that later batches replaced."""
    files = current(spark, state, "files", "path string, size long, mtime timestamp, batch long")
    rows = spark.read.schema(parse.SCHEMA.replace(", error string", "") + ", wrapper boolean, batch long").option("recursiveFileLookup", "true").parquet(f"{state}/components")
    return rows.join(files.select("path", "batch"), ["path", "batch"], "left_semi")


def watch(stream: DataFrame, state: str, checkpoint: str, process_: Callable = process, once: bool = True) -> StreamingQuery:
    """Runs process on every micro-batch of stream (FILES); with once, on what there is now."""
    def each(batch: DataFrame, batch_id: int) -> None:
        process_(batch.sparkSession, batch, batch_id, state)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
