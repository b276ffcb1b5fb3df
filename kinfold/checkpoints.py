"""Tables in the folder that driver and executors share, to cut the lineage of iterative operators.

An operator writes a Parquet table there and reads it again, so that a lost executor costs at most the stage in hand and never a
recomputation of everything before it. Tables that nothing reads any more are deleted, by discard() or at the end of a scope().
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
#: Rows of ids that a broadcast may hold; 8 MB of keys.
SMALL = 1_000_000
#: Bytes of a row group: a writer holds one in memory.
ROW_GROUP = 16 << 20


class _Scopes(threading.local):
    """The open scopes of a thread, so that operators in other threads keep their tables."""

    def __init__(self):
        self.open: list[list[tuple[SparkSession, str]]] = []


_scopes = _Scopes()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a local one only where the master is local, as in tests."""
    found = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {_SETTING} to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="kinfold-")
    spark.conf.set(_SETTING, made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/kinfold/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kinfold_path = path
    if _scopes.open:
        _scopes.open[-1].append((spark, path))
    return out


def _delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._kinfold_path)


@contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """Delete at the end every table that was made inside, but those that are put into the list it gives."""
    kept: list[DataFrame] = []
    _scopes.open.append([])
    try:
        yield kept
    finally:
        made, stay = _scopes.open.pop(), {df._kinfold_path for df in kept}
        for spark, path in made:
            if path in stay:
                if _scopes.open:
                    _scopes.open[-1].append((spark, path))
            else:
                _delete(spark, path)


def broadcast_if_small(ids: DataFrame) -> DataFrame:
    """A materialized table of ids, marked for broadcast if its counted size allows; a larger one is joined by a shuffle. A string
    column counts as eight numbers."""
    width = sum(8 if kind == "string" else 1 for _, kind in ids.dtypes)
    return F.broadcast(ids) if ids.count() * max(width // 4, 1) <= SMALL else ids
