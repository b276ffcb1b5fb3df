"""The driver's tables as the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_features(pages: DataFrame) -> DataFrame:
    """Markup features of pages (page_id, url, html) as component lists."""
    found = lambda pattern: F.regexp_extract_all("html", F.lit(pattern), F.lit(1))
    return pages.select(
        F.col("page_id"),
        F.regexp_extract("url", "/([^/?#]+)([?#].*)?$", 1).alias("name"),
        F.regexp_replace("url", "^[a-z]+://", "").alias("path"),
        F.col("html").alias("source"),
        found("<([a-zA-Z][a-zA-Z0-9]*)").alias("tags"),
        text.present(F.flatten(F.transform(found('class="([^"]*)"'), lambda x: F.split(x, " ")))).alias("classes"),
        F.filter(F.transform(found(">([^<>]+)<"), lambda x: F.trim(x)), lambda x: x != "").alias("texts"),
        found('="([^"]*)"').alias("literals"),
        found(r"([A-Za-z_]+)\(").alias("logic"),
        found("(use[A-Z][A-Za-z]*)").alias("hooks"),
        found(" ([a-z-]+)=").alias("prop_names"),
        F.split(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""), "/").alias("refs"),
        F.contains("html", F.lit("<style>")).alias("has_styles"),
        F.array(F.regexp_extract("url", "://([^/]+)", 1)).alias("style_paths"),
    )


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with vectors from embeddings, and features of the page of the same number, null where there is none."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("ord"), F.col("embedding").cast("array<double>").alias("vector"), "label", (F.col("label") == 3).alias("wrapper"), (F.col("label") < 2).alias("target")
    )
    feats = page_features(table(spark, sf_dir, "pages"))
    return vectors.join(feats, F.col("ord") == F.col("page_id"), "left").drop("page_id").select(
        "*", F.lit(0).alias("spreads"), F.lit(False).alias("css_in_js"), F.slice("vector", 1, 16).alias("style_vec")
    )
