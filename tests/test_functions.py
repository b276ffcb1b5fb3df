import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfold.functions import sets, text, vectors
from kinfold.functions.hashing import slots, string_hash
from kinfold.operators import embed
from kinfold.sources.files import glob_regex, style_path


def one(spark, column, **values):
    import re

    names = list(values)
    kinds = {str: "string", list: "array<string>", float: "double", int: "int", bool: "boolean", type(None): "string"}
    rows = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {kinds[type(values[n])] if not (isinstance(values[n], list) and values[n] and isinstance(values[n][0], float)) else 'array<double>'}" for n in names)) if names else spark.range(1)
    assert re
    return rows.select(column).first()[0]


@pytest.mark.parametrize(
    "given_, wanted",
    [("a /* x\ny */ b", "a b"), ("a // c\nb", "a b"), ("  a 　b﻿ ", "a b"), ("see http://x.y/z", "see http:"), ("", "")],
)
def test_normalize(spark, given_, wanted):
    assert one(spark, text.normalize(F.col("t")), t=given_) == wanted


def test_lists_and_lines(spark):
    assert one(spark, text.unique(F.col("x")), x=["b", "", "a", "b"]) == ["b", "a"]
    assert one(spark, text.tokenize(F.col("t")), t="Foo-bar é 1_a") == ["foo", "bar", "1_a"]
    assert one(spark, text.short_path(F.col("t")), t="a>b>c>d>e>f>g") == "a>b>...>f>g"
    assert one(spark, text.short_path(F.col("t")), t="a>b>c>d>e") == "a>b>c>d>e"
    assert one(spark, text.clip(F.col("t"), 40), t="x" * 55) == "x" * 37 + "..."
    assert one(spark, text.filled_line_count(F.col("t")), t="a\n \n\tb\n") == 2
    assert one(spark, text.line_count(F.col("t")), t="a\n\nb") == 3
    assert one(spark, text.snippet(F.col("t")), t="\n".join(f"l{i}\n" for i in range(20))).split("\n")[-1] == "l11"


def test_set_measures(spark):
    assert one(spark, sets.overlap(F.col("x"), F.col("y")), x=["a", "b", "a"], y=["b", "c", "d", "e"]) == 0.25
    assert one(spark, sets.overlap(F.col("x"), F.col("x")), x=[]) == 0
    assert one(spark, sets.disjoint(F.col("x"), F.col("y")), x=["a"], y=["b"]) is True
    assert one(spark, sets.disjoint(F.col("x"), F.col("y")), x=[], y=["b"]) is False
    assert one(spark, sets.top_item(F.col("x")), x=["b", "a", "a", "b"]) == "b" and one(spark, sets.top_item(F.col("x")), x=[]) is None


def test_vectors(spark):
    assert one(spark, vectors.normalized(F.col("v")), v=[0.0, 0.0, 0.0]) == [0, 0, 0]
    assert one(spark, vectors.normalized(F.col("v")), v=[3.0, 4.0]) == [0.6, 0.8]
    assert one(spark, vectors.cosine(F.col("v"), F.col("w")), v=[0.0, 0.0], w=[0.0, 0.0]) == 0
    assert one(spark, vectors.cosine(F.col("v"), F.col("w")), v=[1.0, 0.0], w=[1.0, 0.0, 5.0]) == 1
    assert one(spark, vectors.cosine_full(F.col("v"), F.col("w")), v=[1.0, 0.0], w=[3.0, 0.0, 4.0]) == pytest.approx(0.6)
    combine = vectors.combined([(F.col("v"), F.lit(1.0)), (F.col("w"), F.lit(1.0))])
    assert one(spark, combine, v=[1.0, 0.0], w=[0.0, 0.0]) == [1, 0]
    assert one(spark, vectors.combined([(F.col("v"), F.lit(0.0))]), v=[1.0, 0.0]) == []
    assert one(spark, combine, v=[1.0, 0.0, 9.0], w=[0.0, 1.0]) == pytest.approx([2**-0.5, 2**-0.5])


def test_string_hash():
    assert string_hash(["abc", "button0", "", "polygenelubricants"]).tolist() == [96354, 241352510, 0, -(2**31)]
    assert slots(["polygenelubricants"]).tolist() == [2**31 % 64]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(max_size=12), max_size=8))
def test_string_hash_equals_the_plain_loop(items):
    want = []
    for s in items:
        h, raw = 0, s.encode("utf-16-le", "surrogatepass")
        for k in range(0, len(raw), 2):
            h = (31 * h + raw[k] + 256 * raw[k + 1]) & 0xFFFFFFFF
        want.append(h - (1 << 32) if h >= 1 << 31 else h)
    assert string_hash(items).tolist() == want


def test_mock_vectors_are_deterministic_and_unit():
    a, b, none = embed.mock(["one two", "one two", ""])
    assert a == b and np.linalg.norm(a) == pytest.approx(1) and not any(none)


def test_each_text_is_embedded_once(spark, tmp_path):
    log = tmp_path / "log"

    def model(texts):
        with log.open("a") as f:
            f.writelines(t + "\n" for t in texts)
        return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, ""), (4, None), (5, "bbb")], "id int, t string")
    found = {r["id"]: r["v"] for r in embed.embed(rows, "t", "v", model).collect()}
    assert found == {1: [2.0], 2: [2.0], 3: None, 4: None, 5: [3.0]} and sorted(log.read_text().split()) == ["aa", "bbb"]


def test_remote_answers():
    r = embed.Remote("http://x/v1", "m")
    assert r.endpoint() == "http://x/v1/embeddings"
    assert [r.vector(a) for a in ({"data": [{"embedding": [1]}]}, {"embedding": [2]}, {"embeddings": [[3]]})] == [[1], [2], [3]]
    with pytest.raises(ValueError):
        embed.backend("remote")


@pytest.mark.parametrize(
    "glob, path, wanted",
    [("**/*.{ts,tsx}", "a/b/c.tsx", True), ("**/*.{ts,tsx}", "c.ts", True), ("**/dist/**", "a/dist/b/c.js", True), ("*.ts", "a/b.ts", False), ("a?/[bc]*.js", "ax/cd.js", True), ("a/[!b].js", "a/b.js", False)],
)
def test_globs(glob, path, wanted):
    import re

    assert bool(re.search(glob_regex(glob), path)) is wanted


def test_style_path(spark):
    assert one(spark, style_path(F.col("t")), t="a/b") == "a/b.css" and one(spark, style_path(F.col("t")), t="a.SCSS") == "a.SCSS.css" and one(spark, style_path(F.col("t")), t="a.scss") == "a.scss"
