"""A whole run: files to components, representations, vectors, pairs, verdicts, labels and a scorecard."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import materialize
from ..config import Config
from ..operators import embed, filters, labels, pairs, parse, represent, rules, score, select, styles
from ..sources import caches, files

PARTS = ("code", "style", "structure", "holistic")
#: More than the components of any file.
MOST = 1 << 20


@dataclass
class Report:
    components: DataFrame
    pairs: DataFrame
    scorecard: DataFrame
    reasons: DataFrame
    #: Of files and of vectors: hits, misses and cleaned entries of the cache; empty without one.
    cache: dict[str, dict[str, int]] = field(default_factory=dict)


def backend_of(config: Config) -> embed.Backend:
    if config.model == "remote":
        return embed.backend("remote", **config.remote)
    if config.model == "mock":
        return embed.mock
    path = config.model_path or config.model
    if config.auto_download_model:
        embed.fetch(path, config.model_repo)
    return embed.backend("local", path=path)


def numbered(components: DataFrame) -> DataFrame:
    """Adds ord: files in collation order of their paths, and within a file the order of appearance."""
    each = select.placed(components.select("path").distinct(), F.expr("path collate unicode"), "path")
    return components.join(each, "path").withColumn("ord", F.col("rank") * MOST + F.col("ordinal")).drop("rank")


def analysed(sources: DataFrame, sheets: DataFrame, config: Config) -> DataFrame:
    """The components of files, with style text and representations."""
    found = parse.parse_files(sources, config.allow_ignores, extensions=config.style_extensions)
    styled = styles.load_styles(found, sheets).withColumn("prop_names", F.col("props.names")).withColumn("spreads", F.col("props.spreads"))
    return represent.represented(styled)


def _schema(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


def cached_components(spark: SparkSession, sources: DataFrame, sheets: DataFrame, config: Config, stats: dict) -> DataFrame:
    """analysed() of the files that the cache doesn't hold as they are, and its records of the others. The cache is brought up to date."""
    now = materialize(files.listing(spark, config.root), "listing")
    print_ = caches.config_fingerprint(config.allow_ignores, config.style_extensions)
    known = caches.read_cache(spark, f"{config.cache}/files", f"path string, size bigint, mtime timestamp, config string, deps {caches.DEPS}")
    present = materialize(caches.cleaned_files(known, now), "present")
    valid = materialize(caches.valid_files(present, now, print_).join(sources.select("path"), "path", "left_semi"), "valid")
    changed = sources.join(valid.select("path"), "path", "left_anti")
    made = materialize(analysed(changed, sheets, config), "analysed")
    old = caches.read_cache(spark, f"{config.cache}/components", _schema(made))
    whole = materialize(old.join(valid.select("path"), "path", "left_semi").select(made.columns).unionByName(made), "components")
    fresh = caches.file_records(changed, made, now, print_)
    hits, total = valid.count(), sources.count()
    stats["files"] = {"hits": hits, "misses": total - hits, "cleaned": known.count() - present.count()}
    others = materialize(present.join(sources.select("path"), "path", "left_anti"), "others")  # files that this run doesn't take stay cached
    stay = old.join(others.select("path"), "path", "left_semi").select(made.columns)
    caches.write_cache(materialize(whole.unionByName(stay), "kept"), f"{config.cache}/components")
    caches.write_cache(materialize(others.unionByName(valid).unionByName(fresh), "kept"), f"{config.cache}/files")
    return whole


def entries(components: DataFrame, config: Config, stats: dict | None = None) -> DataFrame:
    """Components with part vectors and the combined vector. Each distinct text is embedded once; with a cache only those that it has no
    vector of, and it is brought up to date."""
    model, names = backend_of(config), [f"{p}_vec" for p in PARTS]
    out = components
    if config.cache:
        key = caches.model_key(config.model, (config.remote or {}).get("model", "") if config.model == "remote" else config.model_path or config.model)
        schema = "model_key string, id string, fingerprint string, path string, " + ", ".join(f"{n} array<double>" for n in names)
        known = caches.read_cache(out.sparkSession, f"{config.cache}/vectors", schema)
        present = materialize(caches.cleaned(known, files.listing(out.sparkSession, config.root), ["path"]), "present")
        out = out.withColumn("model_key", F.lit(key)).withColumn("fingerprint", caches.fingerprint("code_rep", "style_rep", "style_text", "structure_rep", "holistic_rep"))
        out = caches.cached_vectors(out, present.drop("path")).withColumnsRenamed({n: f"old_{n}" for n in names})
        out = materialize(out, "asked")
        hits = out.where("complete").count()
        stats = {} if stats is None else stats
        stats["vectors"] = {"hits": hits, "misses": out.count() - hits, "cleaned": known.count() - present.count()}
        out = out.withColumns({f"todo_{p}": F.when(F.coalesce(F.size(f"old_{p}_vec"), F.lit(0)) <= 0, F.col(f"{p}_rep")) for p in PARTS})
        out = embed.embed_parts(out, {f"todo_{p}": f"new_{p}_vec" for p in PARTS}, model)
        out = out.withColumns({n: F.when(F.size(f"old_{n}") > 0, F.col(f"old_{n}")).otherwise(F.col(f"new_{n}")) for n in names})
        out = out.drop(*(f"{x}_{n}" for x in ("old", "new") for n in names), *(f"todo_{p}" for p in PARTS))
    else:
        out = embed.embed_parts(out, {f"{p}_rep": f"{p}_vec" for p in PARTS}, model)
    # an empty text has a vector of zeros, that of styles as long as the code's
    size = F.greatest(F.coalesce(F.size("code_vec"), F.lit(1)), F.lit(1))
    out = out.withColumns({n: F.coalesce(n, F.array_repeat(F.lit(0.0), size if n == "style_vec" else F.lit(1))) for n in names})
    out = out.withColumn("vector", embed.entry_vector(F.col("has_styles"), config.weights))
    if config.cache:
        out = materialize(out, "entries")
        keys = ["model_key", "id", "fingerprint"]
        made = out.select(*keys, "path", *names).dropDuplicates(keys)
        stay = present.join(made.select("model_key", "id").distinct(), ["model_key", "id"], "left_anti")
        caches.write_cache(materialize(stay.unionByName(made), "kept"), f"{config.cache}/vectors")
        out = out.drop("model_key", "fingerprint", "complete")
    return out


def analyse(spark: SparkSession, found: DataFrame, config: Config) -> Report:
    """The report of entries (see entries()) under the settings."""
    facts = rules.facts(found)
    compare = bool(config.compare)
    if compare:
        scored = pairs.compare_pairs(found, "ord", "vector", F.col("target"), config.threshold)
    else:
        scored = pairs.similar_pairs(found, "ord", "vector", config.threshold)
    verdicts = materialize(rules.joined_facts(scored, facts).select("a", "b", "similarity", rules.reason(config.max_threshold, config.min_path_distance, compare).alias("reason")), "verdicts")
    reasons = score.suppression_counts(verdicts)
    if compare:
        filtered = pairs.compare_counts(found, F.col("target")).where("filtered > 0").select(F.lit("compare-filter").alias("reason"), F.col("filtered").alias("n"))
        reasons = reasons.unionByName(filtered)
    reported = labels.labelled(verdicts.where("reason is null").drop("reason"), found, config.threshold, config.high_threshold, config.disabled_labels, config.language)
    ids = found.select("ord", "id")
    chosen = select.limit_pairs(reported.select("a", "b", "similarity"), config.limit)
    named = chosen.join(reported.drop("similarity"), ["a", "b"])
    for x in "ab":
        named = named.join(ids.select(F.col("ord").alias(x), F.col("id").alias(f"id_{x}")), x)
    rows = found.select("ord", "vector")
    card = score.scorecard(pairs.pair_totals(rows, "ord", "vector"), pairs.best_matches(rows, "ord", "vector"), reasons)
    return Report(found, select.ordered(named).withColumn("similarity", F.round("similarity", 4)), card, reasons)


def scan(spark: SparkSession, config: Config) -> Report:
    """The report of the files below config.root. With config.cache, a folder that Spark can write, unchanged files are not parsed
    again and known texts not embedded again."""
    sources = materialize(files.read_sources(spark, config.root, config.include, config.exclude), "sources")
    sheets = files.read_sources(spark, config.root, tuple(f"**/*{e}" for e in config.style_extensions), config.exclude)
    stats: dict[str, dict[str, int]] = {}
    found = cached_components(spark, sources, sheets, config, stats) if config.cache else analysed(sources, sheets, config)
    found = filters.kept(filters.mark_targets(found, config.compare, config.root), config.ignore_names, config.ignore_usages)
    made = analyse(spark, materialize(entries(numbered(found), config, stats), "entries"), config)
    made.cache = stats
    return made
