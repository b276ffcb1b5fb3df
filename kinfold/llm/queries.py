"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import checkpoints as scratch
from . import chat, decontam, langid, mixing, neardup, quality, spans, tokens, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that lose sentences, with the documents where those stay, and the text that is left."""
    return spans.deduplicated(table(spark, sf_dir, "documents"), report=True)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_path(spark, "archive")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path)


def op7_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one (-7) whose texts hold the template's control strings."""
    said = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(*chat.prefix_tree(turns.unionByName(probe)))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the copies taken, and the training positions of the first and the last of them."""
    at = lambda i: F.round(F.try_element_at("positions", F.lit(i)), 9)
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", F.size("positions").cast("long").alias("n_copies"), at(1).alias("first_position"), at(-1).alias("last_position")
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_token_counts,
        op3_benchmark_leaks,
        op4_repeated_spans,
        op5_near_duplicates,
        op6_warc_archive,
        op7_chat_tree,
        op8_source_mix,
        op9_quality,
        op10_toxicity,
    )
}
SQL: dict[str, str] = {}

SQL["op8_source_mix"] = """WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, coalesce(md5(doc_id::VARCHAR), md5(text), '') AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM s),
w AS (SELECT *, ((rk - 1) % 3 + 1)::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM r),
c AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS caps, coalesce(sum(w) OVER o, 0) AS ws, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w FROM w
  WINDOW o AS (ORDER BY source_size / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total::DOUBLE - caps) / (all_w - ws) AS level FROM c),
m AS (SELECT arg_min(level, (source_size / w, rk)) AS level FROM l WHERE w * level < cap),
t AS (SELECT l.source, source_size, CASE WHEN count(*) OVER () > 1 THEN 0.5::DOUBLE * (2.0::DOUBLE * (rk - 1) / (count(*) OVER () - 1) - 1) ELSE 0 END AS slope, CASE WHEN w * l.level >= cap OR m.level IS NULL THEN cap ELSE least(cap, w * m.level) END AS target FROM l LEFT JOIN m ON true),
p AS (SELECT d.*, source_size, target, slope, floor(target)::BIGINT AS wanted, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN wanted // source_size ELSE 0 END AS passes FROM p),
u AS (SELECT *, greatest(least(wanted - passes * source_size - before, size), 0) AS part FROM q),
v AS (SELECT *, (passes * size + part)::BIGINT AS taken, CASE WHEN passes * size + part > 0 THEN (passes + (part > 0)::INT)::BIGINT ELSE 0 END AS n_copies FROM u),
x AS (SELECT *, least(before::DOUBLE / target, 1) AS s1, least((before + (n_copies - 1) * source_size)::DOUBLE / target, 1) AS s2 FROM v)
SELECT doc_id, size, source_size, target, taken, n_copies, CASE WHEN n_copies > 0 THEN round(s1 * 2 / ((1 - slope) + sqrt(greatest((1 - slope) * (1 - slope) + slope * s1 * 4, 0))), 9) END AS first_position,
 CASE WHEN n_copies > 0 THEN round(s2 * 2 / ((1 - slope) + sqrt(greatest((1 - slope) * (1 - slope) + slope * s2 * 4, 0))), 9) END AS last_position FROM x"""

SQL["op7_chat_tree"] = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, 4 + length(role) + len(regexp_extract_all(role, '\\|###|</turn>|:')) + 2 + length(text) + len(regexp_extract_all(text, '\\|###|</turn>')) + 9 AS n FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 sum(n)::BIGINT AS formatted_chars FROM f GROUP BY conv_id"""

SQL["op6_warc_archive"] = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS holder FROM p),
v AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(h, (1 + 5 * i)::INT, 5))::BIGINT) AS g, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS b FROM m)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
 array_to_string(list_transform(g, lambda x: substr(b, (1 + (x // 32768) % 32)::INT, 1) || substr(b, (1 + (x // 1024) % 32)::INT, 1) || substr(b, (1 + (x // 32) % 32)::INT, 1) || substr(b, (1 + x % 32)::INT, 1)), '') AS payload_digest,
 CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> holder THEN holder END AS refers_to FROM v"""
