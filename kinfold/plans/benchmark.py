"""Scores embedding models on a labelled suite."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import vectors
from ..operators import evaluate, pairs, rules


def score_model(found: DataFrame, groups: DataFrame, hard: DataFrame, config: Config) -> DataFrame:
    """One row of measures for entries (ord, id, vector and features) against a suite. Ranks use dot products, reports cosines."""
    named = groups.select("id").unionByName(hard.select(F.col("a").alias("id"))).unionByName(hard.select(F.col("b").alias("id")))
    evaluate.check_references(named, found)
    ids = found.groupBy("id").agg(F.min("ord").alias("ord"))
    positives = evaluate.group_positives(groups.join(ids, "id").select("group_id", F.col("ord").alias("id")))
    negative = hard.select("a", "b")
    for x in "ab":
        negative = negative.join(ids.select(F.col("id").alias(x), F.col("ord").alias(f"o_{x}")), x)
    negative = negative.select(F.least("o_a", "o_b").alias("a"), F.greatest("o_a", "o_b").alias("b"))
    dots = pairs.similar_pairs(found, "ord", "vector", float("-inf"), raw=True).withColumnRenamed("similarity", "score")
    sizes = found.select("ord", vectors.norm(F.col("vector")).alias("size"))
    for x in "ab":
        dots = dots.join(sizes.select(F.col("ord").alias(x), F.col("size").alias(f"n_{x}")), x)
    size = F.col("n_a") * F.col("n_b")
    cosined = dots.withColumn("similarity", F.when(size > 0, F.col("score") / size).otherwise(F.lit(0.0))).select("a", "b", "score", "similarity")
    judged = rules.joined_facts(cosined, rules.facts(found)).select("a", "b", "score", F.col("similarity").alias("cosine"), rules.reason(config.max_threshold, config.min_path_distance).isNull().alias("eligible"))
    scored = evaluate.flagged(judged, positives, negative).persist()
    n_pos, n_hard = positives.count(), negative.distinct().count()
    sweep = evaluate.threshold_sweep(scored, n_pos, n_hard)
    none = found.sparkSession.createDataFrame([(0.0, 0, 0, 0, 0.0, 0.0, 0.0)], "threshold double, tp long, fp long, hard_fp long, precision double, recall double, f1 double")
    best = evaluate.best_threshold(sweep if n_pos else none).select("threshold", F.col("precision"), F.col("recall"), F.col("f1").alias("best_f1"), "hard_fp")
    row = best.join(evaluate.average_precision(scored)).join(evaluate.rank_measures(scored)).join(evaluate.separation(scored))  # one row each
    return row.withColumn("hard_negatives", F.lit(n_hard)).withColumn("score", evaluate.benchmark_score(F.col("best_f1"), F.col("average_precision"), F.col("hard_fp"), F.lit(n_hard)))


def compare_models(spark: SparkSession, models: dict[str, Config], make, groups: DataFrame, hard: DataFrame) -> DataFrame:
    """A leaderboard; make(config) gives the entries of a model."""
    out = None
    for name, config in models.items():
        row = score_model(make(config), groups, hard, config).withColumn("model", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return evaluate.leaderboard(out)


#: Models by name, with a title, the kind of backend and other names: fixed values.
PRESETS = {
    "local": ("Local all-MiniLM-L6-v2", "local", ("baseline-local",)),
    "mock": ("Mock hash", "mock", ()),
    "openai/text-embedding-3-small": ("OpenAI 3 small", "remote", ("text-embedding-3-small", "openai-small")),
    "openai/text-embedding-3-large": ("OpenAI 3 large", "remote", ("text-embedding-3-large", "openai-large")),
    "google/gemini-embedding-001": ("Gemini Embedding 001", "remote", ("gemini-embedding-001", "gemini")),
    "qwen/qwen3-embedding-8b": ("Qwen3 Embedding 8B", "remote", ("qwen3-embedding-8b", "qwen")),
    "baai/bge-m3": ("BGE-M3", "remote", ("bge-m3", "bge")),
    "intfloat/multilingual-e5-large": ("Multilingual-E5-Large", "remote", ("multilingual-e5-large", "e5-large", "e5")),
    "sentence-transformers/all-mpnet-base-v2": ("all-mpnet-base-v2", "remote", ("all-mpnet-base-v2", "mpnet")),
}
#: Those that an evaluation takes by default: all but the mock.
DEFAULT_MODELS = tuple(m for m in PRESETS if m != "mock")


def resolve_model(name: str) -> tuple[str, str, str]:
    """Id, title and kind of a model by id or other name; an unknown one is a remote model of that id."""
    for key, (title, kind, others) in PRESETS.items():
        if name == key or name in others:
            return key, title, kind
    return name, name, "remote"


def model_config(base: Config, model: str) -> Config:
    """The settings of a model; selection settings don't apply to evaluations."""
    key, _, kind = resolve_model(model)
    own = {"remote": {"model": "remote", "remote": {**base.remote, "model": key}}, "mock": {"model": "mock"}, "local": {"model": "local"}}[kind]
    return dataclasses.replace(base, **own, limit=None, compare=())
