import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from kinfold import cli, config, report
from kinfold.plans import benchmark, queries, scan
from kinfold.streaming import incremental

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CARD = "import './card.css';\nexport function {0}({{ title, items }}) {{\n  const [open, setOpen] = useState(false);\n  const toggle = () => setOpen(!open);\n  return (\n    <section className=\"card wide\">\n      <h2>{{title}}</h2>\n      <button onClick={{toggle}}>Show all of it</button>\n      <p className=\"note\">{1}</p>\n    </section>\n  );\n}}\n"


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for where, text in {
        "a/Card.tsx": CARD.format("Card", "first"), "b/Panel.tsx": CARD.format("Panel", "first"), "c/Other.tsx": "export const Other = ({ n }) => <ul><li>{n}</li><li>x</li></ul>;\n",
        "node_modules/x.tsx": CARD.format("Gone", "no"), "d/Skip.tsx": "// kinfold-ignore-file\n" + CARD.format("Skip", "no"), "a/card.css": ".card { color: red }\n.unused { }\n", "e/Broken.tsx": "const A = (",
    }.items():
        (root / where).parent.mkdir(parents=True, exist_ok=True)
        (root / where).write_text(text)
    return root


def test_scan(spark, project, tmp_path):
    found = scan.scan(spark, config.layered({"root": str(project), "threshold": 0.6, "high_threshold": 0.9}))
    made = report.emit(found, str(tmp_path / "out"))
    assert [c["name"] for c in made["components"]] == ["Card", "Panel", "Other"]
    assert [(p["a"], p["b"]) for p in made["pairs"]] == [("a/Card.tsx#Card", "b/Panel.tsx#Panel")]
    assert made["stats"]["evaluated"] == 3 and made["components"][0]["has_styles"] and not made["components"][1]["has_styles"]
    assert json.loads((tmp_path / "out.json").read_text())["pairs"] and "a/Card.tsx#Card" in (tmp_path / "out.txt").read_text()


def test_scan_in_compare_mode(spark, project):
    found = scan.scan(spark, config.layered({"root": str(project), "threshold": 0.6, "compare": ["a/*"]}))
    made = report.as_dict(found)
    assert len(made["pairs"]) == 1 and made["stats"]["reasons"]["compare-filter"] >= 1


def test_a_second_scan_parses_and_embeds_only_what_changed(spark, project, tmp_path, monkeypatch):
    import os
    import shutil

    from kinfold.operators import embed, parse

    root, log = tmp_path / "p", tmp_path / "log"
    shutil.copytree(project, root)
    plain_parse, plain_mock = parse.parse_files, embed.mock

    def parsing(sources, *a, **k):
        return plain_parse(sources.withColumn("source", noted(F.col("path"), F.col("source"))), *a, **k)

    @F.udf("string")
    def noted(path, source):
        with open(log, "a") as f:
            f.write(f"parsed {path}\n")
        return source

    def embedding(texts):
        with open(log, "a") as f:
            f.writelines("embedded\n" for _ in texts)
        return plain_mock(texts)

    monkeypatch.setattr(parse, "parse_files", parsing)
    monkeypatch.setattr(embed, "mock", embedding)
    settings = config.layered({"root": str(root), "threshold": 0.6, "cache": str(tmp_path / "cache")})

    def run():
        log.write_text("")
        found = scan.scan(spark, settings)
        made, lines = report.as_dict(found), log.read_text().splitlines()
        return made, sorted({x for x in lines if x.startswith("parsed")}), lines.count("embedded"), found.cache

    first, parsed, embedded, stats = run()
    assert len(parsed) >= 4 and embedded >= 9 and stats["files"]["hits"] == 0 and stats["vectors"]["misses"] == 3
    again, parsed, embedded, stats = run()
    assert parsed == [] and embedded == 0 and stats["files"]["misses"] == 0 and stats["vectors"] == {"hits": 3, "misses": 0, "cleaned": 0}
    assert {k: again[k] for k in ("components", "pairs")} == {k: first[k] for k in ("components", "pairs")}
    # a style sheet that changes makes its component anew, one that is new where it was missing too; a file that is gone is cleaned
    (root / "a/card.css").write_text(".card { color: green; margin: 0 }")
    os.utime(root / "a/card.css", (1, 1))
    (root / "b/card.css").write_text(".card { color: blue }")
    (root / "c/Other.tsx").unlink()
    changed, parsed, embedded, stats = run()
    assert parsed == ["parsed a/Card.tsx", "parsed b/Panel.tsx"] and stats["files"]["cleaned"] == 1 and stats["vectors"] == {"hits": 0, "misses": 2, "cleaned": 1}
    assert [c["has_styles"] for c in changed["components"]] == [True, True]
    assert "cached" in report.as_text(changed)
    # settings that change what is parsed end the cache
    settings = config.layered({"root": str(root), "threshold": 0.6, "cache": str(tmp_path / "cache"), "allow_ignores": False})
    _, parsed, _, _ = run()
    assert len(parsed) >= 3


def test_languages_and_remote_settings(tmp_path):
    from kinfold import messages
    from kinfold.operators import embed

    assert set(messages.LANGUAGES) == {"en", "es", "fr", "de", "ru", "zh"}
    assert all(set(messages.hints(x)) == set(messages.hints("en")) and (x == "en" or messages.hints(x) != messages.hints("en")) for x in messages.LANGUAGES)
    found = cli.config_of(cli.parser().parse_args(["scan", str(tmp_path), "--api-url", "http://h/v1", "--api-model", "m", "--api-timeout", "2", "--no-progress"]))
    assert found.remote == {"url": "http://h/v1", "model": "m", "timeout": 2.0} and not found.progress
    with pytest.raises(ValueError, match="needs a key"):
        embed.backend("remote", model="m")
    assert embed.backend("remote", model="m", key="k").endpoint().endswith("/v1/embeddings")
    assert embed.Remote("http://h/api/embeddings/", "m").endpoint() == "http://h/api/embeddings"
    with pytest.raises(FileNotFoundError):
        embed.fetch(str(tmp_path / "model"), "http://h")
    embed.fetch(str(tmp_path / "model"), "http://h", lambda a, p: open(p, "w").write(a) and None)
    assert (tmp_path / "model/model.onnx").read_text() == "http://h/model.onnx"


def test_benchmark_of_a_model(spark, project):
    settings = config.layered({"root": str(project), "threshold": 0.6})
    found = scan.scan(spark, settings).components
    groups = spark.createDataFrame([("g", "copy", "a/Card.tsx#Card"), ("g", "copy", "b/Panel.tsx#Panel")], "group_id string, label string, id string")
    hard = spark.createDataFrame([("a/Card.tsx#Card", "c/Other.tsx#Other", "no")], "a string, b string, reason string")
    row = benchmark.score_model(found, groups, hard, settings).first()
    assert row["best_f1"] == row["average_precision"] == row["mrr"] == 1 and row["hard_fp"] == 0 and row["score"] == pytest.approx(100)


def test_models_by_name():
    assert benchmark.resolve_model("e5")[0] == "intfloat/multilingual-e5-large" and benchmark.resolve_model("x/y") == ("x/y", "x/y", "remote")
    own = benchmark.model_config(config.layered({"remote": {"url": "u"}, "limit": 3}), "bge")
    assert own.remote == {"url": "u", "model": "baai/bge-m3"} and own.limit is None and len(benchmark.DEFAULT_MODELS) == 8


def test_streaming_counts_each_file_once(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    rows = lambda *r: spark.createDataFrame(list(r), "path string, size long, mtime string, source string").withColumn("mtime", F.to_timestamp("mtime"))
    one, two = "const A = () => <a/>;", "const B = () => <b/>; const C = () => <c/>;"
    for new in (rows(("/x.tsx", 1, "2024-01-01", one), ("/y.tsx", 1, "2024-01-01", one)), rows(("/x.tsx", 2, "2024-01-02", two), ("/y.tsx", 1, "2024-01-01", one))):
        new.write.mode("append").parquet(source)
        stream = spark.readStream.schema(incremental.FILES).parquet(source)
        incremental.watch(stream, state, str(tmp_path / "check")).awaitTermination()
    assert sorted((r["path"], r["name"]) for r in incremental.components(spark, state).collect()) == [("/x.tsx", "B"), ("/x.tsx", "C"), ("/y.tsx", "A")]
    incremental.process(spark, rows(("/x.tsx", 2, "2024-01-02", two)), 1, state)  # a batch that runs again
    assert incremental.components(spark, state).where("path = '/x.tsx'").count() == 2


def test_config_layers(tmp_path):
    path = str(tmp_path / "kinfold.json")
    found = config.layered({"exclude": ["x"], "weights": {"code": 1.0}, "threshold": 0.5}, {"exclude": ["y"], "threshold": None, "include": ["z"]})
    assert found.exclude[-2:] == ("x", "y") and found.weights["code"] == 1.0 and found.weights["style"] == 0.2 and found.threshold == 0.5 and found.include == ("z",)
    config.save(found, path)
    assert config.layered(config.read_file(path)) == found
    assert config.read_file(str(tmp_path / "none")) == {}
    (tmp_path / "bad").write_text("{")
    with pytest.raises(ValueError, match="not valid JSON"):
        config.read_file(str(tmp_path / "bad"))
    assert config.from_environment({"API_URL": "u", "API_TIMEOUT": "3", "MODEL": "remote"}) == {"model": "remote", "remote": {"url": "u", "timeout": 3.0}}


def test_arguments(tmp_path):
    args = cli.parser().parse_args(["scan", str(tmp_path), "--threshold", "0.7", "--no-ignores", "--exclude", "q", "--save-config"])
    found = cli.config_of(args)
    assert found.threshold == 0.7 and not found.allow_ignores and "q" in found.exclude
    assert config.load(str(tmp_path), env={}).threshold == 0.7
    assert report.grid([{"a": 1, "b": 0.5}], ["a", "b"]).split() == ["a", "b", "1", "0.5000"]


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_equal_sql(spark, sf_dir, duck, name):
    found = queries.QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in found.collect()]
    if name in queries.SQL:
        want = duck.execute(queries.SQL[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(found.columns)
        assert normal(rows, found.columns) == normal(want.fetchall(), names)
    else:
        assert rows


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
