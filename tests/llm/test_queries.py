import zlib

import duckdb
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from kinfold.llm import queries

from . import plain
from .test_neardup import brute
from .test_text_operators import slow_counts

COLUMNS = {
    "op1_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op2_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op5_near_duplicates": ["doc_id", "n_shingles", "component_id", "kept"],
    "op6_warc_archive": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op7_chat_tree": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op8_source_mix": ["doc_id", "size", "source_size", "target", "taken"],
    "op9_quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op10_toxicity": ["doc_id", "held_out", "score", "predicted"],
}


@pytest.fixture(scope="module")
def found(spark, sf_dir):
    held = {}

    def get(name):
        if name not in held:
            held[name] = queries.QUERIES[name](spark, sf_dir).collect()
        return held[name]

    return get


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(found, name):
    assert found(name)[0].__fields__[: len(COLUMNS[name])] == COLUMNS[name]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equal_sql(found, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted((tuple(r[n] for n in names) for r in found(name)), key=repr) == sorted(want.fetchall(), key=repr)


def test_near_duplicates_equal_brute_force(found, docs):
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found("op5_near_duplicates")} == brute(docs.items())


def test_tokens_equal_the_library(found, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r["doc_id"]: r["n_tokens"] for r in found("op2_token_counts")} == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in docs.items()}


def test_quality_equals_brute_force(found, docs):
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS["op9_quality"][1:6]) for r in found("op9_quality")} == {i: slow_counts(t) for i, t in docs.items()}


def test_folds(found, docs):
    for name, folds, fold in (("op1_language_id", 4, 2), ("op10_toxicity", 5, 0)):
        assert {r["doc_id"]: r["held_out"] for r in found(name)} == {i: zlib.crc32(str(i).encode()) % folds == fold for i in docs}


def test_removed_spans_equal_the_plain_version(found, docs):
    want = plain.deduplicated(list(docs.items()))
    rows = found("op4_repeated_spans")
    assert rows and {r["doc_id"]: r["text"] for r in rows} == {i: t for i, t in want.items() if t != docs[i]}
    assert all(set(r["first_doc_ids"]) <= set(docs) and max(r["first_doc_ids"]) <= r["doc_id"] and r["n_removed"] > 0 for r in rows)


def test_leaks_equal_alignment_of_every_pair(spark, found, docs, sf_dir):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = plain.leaks(docs.items(), items)
    got = {(r["doc_id"], r["item_id"]) for r in found("op3_benchmark_leaks")}
    assert got <= want and len(got) >= 0.95 * len(want)
