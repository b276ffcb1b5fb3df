import os

import duckdb

import corpus_pipeline
from kinfold import checkpoints as scratch
from kinfold.llm import langid, neardup, queries


def test_stages_keep_the_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, scratch.materialize(stage(spark, docs, sf_dir), name)
        counts.append(docs.count())
        if name != "mix_sources":
            assert docs.columns == columns
            assert docs.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
        if name == "near_dedup":
            assert neardup.near_duplicates(docs).where("not kept").count() == 0
    assert counts[1] >= 0.98 * counts[0] and counts[2] < counts[1] and counts[4] < counts[3] and counts[5] == counts[4]
    assert all(r["taken"] <= 3 * r["size"] for r in docs.collect())


def test_run_equals_plain_versions(spark, sf_dir, tmp_path):
    """Each stage over all that its predecessor kept: rejection by the model, then brute force, loops, alignment of every pair, and SQL."""
    from . import plain
    from .test_neardup import brute

    folder = scratch.shared_dir(spark).removeprefix("file://") + "/kinfold"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = corpus_pipeline.run(spark, sf_dir)
    found = {r["doc_id"]: (r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in out.collect()}
    assert len(set(os.listdir(folder)) - before) == 1  # only the result stays
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rejected = {r["doc_id"] for r in langid.language_id(docs).where("rejected").collect()}
    rows = {r["doc_id"]: r for r in docs.collect() if r["doc_id"] not in rejected}
    texts = {i: r["text"] for i, r in rows.items()}
    texts = {i: texts[i] for i, (_, c) in brute(texts.items()).items() if i == c}
    had = {i for i, t in texts.items() if plain.WORD.search(t or "")}
    texts = {i: t for i, t in plain.deduplicated(list(texts.items())).items() if i not in had or plain.WORD.search(t)}
    leaked = {i for i, _ in plain.leaks(texts.items(), [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])}
    left = [(i, t, rows[i]["source"]) for i, t in texts.items() if i not in leaked]
    spark.createDataFrame(left, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    names = ["doc_id", "size", "source_size", "target", "taken"]
    want = con.execute(f"select {', '.join(names)} from ({queries.SQL['op8_source_mix']})").fetchall()
    assert found == {r[0]: (r[1], r[2], round(r[3], 6), r[4]) for r in want}


def test_stages_of_odd_and_empty_tables(spark, odd, empty, sf_dir):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert name == "mix_sources" or out.columns == docs.columns
            assert out.count() <= docs.count()


def test_without_any_language_texts_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "text", "cast(null as string) lang", "source", "n_chars")
    assert corpus_pipeline.language_id(spark, docs, sf_dir).count() == docs.where(r"text rlike '\\p{L}'").count() > 0
