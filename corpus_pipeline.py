"""A corpus pipeline of five stages over documents; each stage's rows are written as Parquet and read again by the next.

1. language ID: documents whose text the language models reject go;
2. MinHash near-dedup: the document with the smallest doc_id of each group stays;
3. substring dedup: sentences of repeated spans go, and documents of which nothing is left;
4. benchmark decontamination: documents that hold a test item go;
5. mixing: the documents that are left, with the words taken of each, in training order.

All but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold import checkpoints
from kinfold.llm import decontam, langid, mixing, neardup, spans


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that share a doc_id are one document and stay or go together; rows without one stay."""
    groups = neardup.near_duplicates(docs)
    gone = checkpoints.materialize(groups.where("not kept").select("doc_id").distinct(), "gone")
    checkpoints.discard(groups)
    key = spans.apart(docs, "gone_id")
    ids = checkpoints.broadcast_if_small(gone.select(F.col("doc_id").alias(key)))
    return docs.join(ids, docs["doc_id"].cast("long") == ids[key], "left_anti")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that lose every sentence go; those that had no word before stay as they are."""
    had = spans.apart(docs, "had_words")
    word = F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    left = spans.deduplicated(docs.withColumn(had, F.coalesce(word, F.lit(False))))
    return left.where(~F.col(had) | word).drop(had)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]
#: SQL can't express the language models, the signatures, the sentence spans or the alignment.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each written to the shared folder and read again. What a stage made there goes when its rows are
    written, and those go when the next stage's are."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        with checkpoints.scope() as stays:
            docs = checkpoints.materialize(stage(spark, docs, sf_dir), name)
            stays.append(docs)
        checkpoints.discard(*before)
        before = [docs]
    return docs
