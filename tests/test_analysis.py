import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.operators import evaluate, filters, labels, pairs, rules, score, select
from kinfold.sources import caches, files

SCHEMA = (
    "ord long, id string, name string, path string, source string, vector array<double>, wrapper boolean, target boolean, spreads int, has_styles boolean, css_in_js boolean, style_paths array<string>, style_vec array<double>, "
    + ", ".join(f"{c} array<string>" for c in rules.LISTS)
)


def rows(spark, *own):
    base = {c: [] for c in rules.LISTS} | {"tags": ["div"], "source": "", "wrapper": False, "target": False, "spreads": 0, "has_styles": False, "css_in_js": False, "style_paths": []}
    out = []
    for i, r in enumerate(own):
        r = base | {"ord": i, "name": f"N{i}", "id": f"N{i}#N{i}", "path": f"/p/d{i}/f.tsx", "vector": [1.0, 0.0]} | r
        r.setdefault("style_vec", r["vector"])
        out.append(tuple(r[c.split()[0]] for c in SCHEMA.split(", ")))
    return spark.createDataFrame(out, SCHEMA)


def reasons(found, threshold=0.1, **options):
    scored = pairs.similar_pairs(found, "ord", "vector", threshold)
    out = rules.joined_facts(scored, rules.facts(found)).select(rules.reason(**options).alias("r")).collect()
    return sorted(r["r"] or "" for r in out)


def test_pairs_above_the_threshold(spark):
    found = rows(spark, {}, {}, {})
    assert pairs.similar_pairs(found, "ord", "vector", 0.1).count() == 3
    assert pairs.similar_pairs(rows(spark, {}, {"vector": [0.0, 1.0]}), "ord", "vector", 1.0).count() == 0
    assert pairs.similar_pairs(rows(spark, {"vector": [0.0, 0.0]}, {"vector": [0.0, 0.0]}), "ord", "vector", 0.1).count() == 0
    assert pairs.similar_pairs(found.limit(0), "ord", "vector", 0.1).count() == 0


def test_blocks_equal_the_broadcast_form(spark, monkeypatch):
    rng = np.random.default_rng(0)
    data = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(60)], "ord long, vector array<double>")
    small = sorted((r["a"], r["b"], round(r["similarity"], 9)) for r in pairs.similar_pairs(data, "ord", "vector", 0.3).collect())
    totals, best = pairs.pair_totals(data, "ord", "vector").first(), sorted(map(tuple, pairs.best_matches(data, "ord", "vector").collect()))
    monkeypatch.setattr(pairs, "SMALL", 0)
    monkeypatch.setattr(pairs, "BLOCK", 13)
    assert sorted((r["a"], r["b"], round(r["similarity"], 9)) for r in pairs.similar_pairs(data, "ord", "vector", 0.3).collect()) == small
    again = pairs.pair_totals(data, "ord", "vector").first()
    assert again["checked"] == totals["checked"] == 60 * 59 // 2 and again["total"] == pytest.approx(totals["total"]) and again["top"] == pytest.approx(totals["top"])
    assert [i for i, _ in sorted(map(tuple, pairs.best_matches(data, "ord", "vector").collect()))] == [i for i, _ in best]


def test_suppression(spark):
    big = "\n".join("line" for _ in range(20))
    assert reasons(rows(spark, {}, {}), top=0.8) == ["over-max-threshold"]
    assert reasons(rows(spark, {"refs": ["N1"]}, {})) == ["component-composition"]
    assert reasons(rows(spark, {"wrapper": True, "refs": ["X"]}, {"wrapper": True, "refs": ["Y"]})) == ["wrapper-different-base"]
    assert reasons(rows(spark, {"wrapper": True}, {"wrapper": True})) == ["wrapper-specialization"]
    assert reasons(rows(spark, {"spreads": 1, "hooks": None, "texts": None}, {"spreads": 1, "logic": None})) == ["wrapper-specialization"]
    assert reasons(rows(spark, {"prop_names": ["p"], "texts": ["a", "b"], "logic": ["l"]}, {"texts": ["a", "b"]})) == [""]
    assert reasons(rows(spark, {"prop_names": ["p"], "logic": ["l"]}, {"tags": ["p"]})) == ["low-signal-pair"]
    assert reasons(rows(spark, {"prop_names": ["p"], "logic": ["l"], "source": big}, {"source": big})) == [""]
    assert reasons(rows(spark, {"path": "/a/x/f"}, {"path": "/a/x/g"}), least_distance=1) == ["near-path"]
    assert reasons(rows(spark, {"path": "/a/x/f"}, {"path": "/a/y/g"}), least_distance=1) == [""]


def test_wide_wrappers_and_signal(spark):
    found = rows(spark, {"prop_names": ["p"]}, {"logic": ["a", "a", "b", "c"], "texts": ["t"]}, {"hooks": None})
    assert [r[0] for r in found.orderBy("ord").select(rules.is_wrapper()).collect()] == [True, False, False]
    assert [r[0] for r in found.orderBy("ord").select(rules.signal_score()).collect()] == [1, 3, 0]


def test_compare_mode(spark):
    found = rows(spark, {"target": True}, {"target": True}, {}, {})
    got = {(r["a"], r["b"]) for r in pairs.compare_pairs(found, "ord", "vector", F.col("target"), 0.1).collect()}
    assert got == {(0, 2), (0, 3), (1, 2), (1, 3)}
    assert tuple(pairs.compare_counts(found, F.col("target")).first()) == (4, 2)
    assert reasons(found, compare=True).count("compare-filter") == 2


def labels_of(spark, x, y, sim, disabled=(), language="en"):
    found = rows(spark, x, y)
    pair = spark.createDataFrame([(0, 1, sim)], "a long, b long, similarity double")
    return labels.labelled(pair, found, 0.8, 0.9, disabled, language).first()


def test_labels(spark):
    side = {"wrapper": True, "logic": ["a", "b"], "literals": ["x", "y"], "source": "const a = 1;"}
    r = labels_of(spark, side, side | {"literals": ["x", "z"]}, 0.96)
    assert r["labels"] == [labels.WRAPPER, labels.LOGIC, labels.COPY, labels.PROP] and r["category"] == "almost-identical" and len(r["hints"]) == 4
    long = {"source": "a\nb\nc\nd\ne"}
    assert labels_of(spark, long, {"source": "x"}, 0.85)["labels"] == [labels.FORK]
    assert labels_of(spark, side, side, 0.99, labels.LABELS)["labels"] == []
    sheet = {"has_styles": True, "style_paths": ["/a.css"]}
    assert labels.STYLE not in labels_of(spark, sheet, sheet, 0.92)["labels"]
    assert labels.STYLE in labels_of(spark, sheet, sheet | {"css_in_js": True}, 0.92)["labels"]
    assert labels.STYLE in labels_of(spark, sheet, sheet | {"style_paths": ["/a.css", "/b.css"]}, 0.92)["labels"]
    assert labels.STYLE not in labels_of(spark, sheet | {"style_vec": [1.0, 0.0]}, {"style_vec": [0.0, 1.0]}, 0.5)["labels"]
    assert labels.PROP in labels_of(spark, {"prop_names": ["p"]}, {"prop_names": ["q"]}, 0.95)["labels"]
    assert labels.PROP not in labels_of(spark, {"prop_names": ["p"]}, {}, 0.94)["labels"]
    assert labels_of(spark, {"wrapper": True}, {"wrapper": True}, 0.5, language="es-MX")["hints"][0].startswith("Dos")


def greedy(edges, limit):
    used, out = {}, []
    for a, b, s in sorted(edges, key=lambda e: (-round(e[2], 4), e[0], e[1])):
        if used.get(a, 0) < limit and used.get(b, 0) < limit:
            out.append((a, b))
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
    return out


@pytest.mark.parametrize("seed, limit", [(0, 1), (1, 2), (2, 3)])
def test_limit_equals_the_sequential_selection(spark, seed, limit):
    rng = random.Random(seed)
    edges = [(a, b, rng.choice([0.5, 0.6, 0.7, rng.random()])) for a, b in itertools.combinations(range(14), 2) if rng.random() < 0.5]
    found = select.limit_pairs(spark.createDataFrame(edges, "a long, b long, similarity double"), limit).collect()
    assert [(r["a"], r["b"]) for r in found] == greedy(edges, limit)


def test_scorecard_and_coverage(spark):
    found = rows(spark, {}, {"vector": [0.6, 0.8]}, {"vector": [0.0, 1.0]})
    none = spark.createDataFrame([], "reason string, n long")
    card = score.scorecard(pairs.pair_totals(found, "ord", "vector"), pairs.best_matches(found, "ord", "vector"), none).first()
    assert (card["evaluated"], card["covered"], card["min_best"], card["max_best"], card["suppressed"]) == (3, 3, 0.6, 0.8, 0)
    one = rows(spark, {})
    card = score.scorecard(pairs.pair_totals(one, "ord", "vector"), pairs.best_matches(one, "ord", "vector"), none).first()
    assert (card["covered"], card["top"], card["mean"]) == (0, 0, 0)
    kept = spark.createDataFrame([(0, 1)], "a long, b long")
    assert tuple(score.coverage(kept, found).first()) == (2, 3, 67)


def measures(spark, vecs, positives, hard):
    found = spark.createDataFrame(list(enumerate(vecs)), "ord long, vector array<double>")
    dots = {(a, b): (float(np.dot(vecs[a], vecs[b])), float(np.dot(vecs[a], vecs[b]) / np.linalg.norm(vecs[a]) / np.linalg.norm(vecs[b]))) for a, b in itertools.combinations(range(len(vecs)), 2)}
    assert {(r["a"], r["b"]): pytest.approx(r["similarity"]) for r in pairs.similar_pairs(found, "ord", "vector", float("-inf"), raw=True).collect()} == {k: v[0] for k, v in dots.items()}
    scored = spark.createDataFrame([(a, b, *v, True, (a, b) in positives, (a, b) in hard) for (a, b), v in dots.items()], "a long, b long, score double, cosine double, eligible boolean, is_pos boolean, is_hard boolean")
    return scored


def test_evaluation(spark):
    scored = measures(spark, [[1.0, 0.0], [0.98, 0.02], [0.0, 1.0], [0.05, 0.95]], {(0, 1), (2, 3)}, {(0, 2), (1, 3)})
    assert evaluate.average_precision(scored).first()["average_precision"] == 1
    assert tuple(evaluate.rank_measures(scored).first()) == (1, 1, 1)
    best = evaluate.best_threshold(evaluate.threshold_sweep(scored, 2, 2)).first()
    assert best["f1"] == 1 and best["hard_fp"] == 0 and evaluate.separation(scored).first()["gap"] > 0
    scored = measures(spark, [[1.0, 0.0], [0.95, 0.05], [0.9, 0.1]], {(1, 2)}, {(0, 1)})
    assert evaluate.separation(scored).first()["gap"] < 0 and evaluate.best_threshold(evaluate.threshold_sweep(scored, 1, 1)).first()["f1"] > 0


def test_sweep_equals_a_rerun_at_each_threshold(spark):
    rng = random.Random(3)
    data = [(i, i + 1, s := round(rng.random(), 2), s - rng.choice([0, 1e-12]), rng.random() < 0.8, rng.random() < 0.3, rng.random() < 0.1) for i in range(80)]
    scored = spark.createDataFrame(data, "a long, b long, score double, cosine double, eligible boolean, is_pos boolean, is_hard boolean")
    total = sum(d[5] for d in data)
    found = {r["threshold"]: (r["tp"], r["fp"], r["hard_fp"]) for r in evaluate.threshold_sweep(scored, total, 1).collect()}
    assert found == {t: tuple(sum(1 for d in data if d[4] and d[3] >= t and ok(d)) for ok in (lambda d: d[5], lambda d: not d[5], lambda d: d[6])) for t in {d[2] for d in data}}


def test_suites(spark):
    suite = {"groups": [{"id": "g", "label": "l", "members": ["a.tsx#A", "b.tsx#B"]}], "hardNegatives": [{"a": "a.tsx#A", "b": "c#C"}]}
    groups, hard = files.suite_tables(spark, suite)
    assert groups.count() == 2 and hard.count() == 1
    for bad in ({"groups": [{"id": "g", "members": ["a"]}]}, {"groups": suite["groups"] * 2}, {"groups": suite["groups"], "hardNegatives": [{"a": "b.tsx#B", "b": "a.tsx#A"}]}, {"hardNegatives": [{"a": "x", "b": "x"}]}):
        with pytest.raises(ValueError):
            files.suite_tables(spark, bad)
    with pytest.raises(ValueError, match="unknown"):
        evaluate.check_references(groups, spark.createDataFrame([("a.tsx#A",)], "id string"))
    ref = spark.createDataFrame([("x#y.tsx#Z",)], "r string").select(files.component_ref(F.col("r")).alias("c")).first()["c"]
    assert (ref["path"], ref["name"]) == ("x#y.tsx", "Z")


def test_prefix_join_equals_brute_force(spark):
    rng = random.Random(9)
    data = [(i, [f"t{rng.randrange(12)}" for _ in range(rng.randint(0, 9))]) for i in range(60)]
    for least in (0.5, 0.8, 1.0):
        want = {(a, b) for (a, x), (b, y) in itertools.combinations(data, 2) if x and y and len(set(x) & set(y)) / max(len(set(x)), len(set(y))) >= least}
        found = {(r["a"], r["b"]) for r in pairs.overlap_pairs(spark.createDataFrame(data, "k long, t array<string>"), "k", "t", least).collect()}
        assert found == want


def test_filters(spark):
    found = rows(spark, {"name": "Icon"}, {"refs": ["Legacy"]}, {"name": "Keep"})
    assert [r["name"] for r in filters.kept(found, ("^Ic", "("), ("Legacy",)).collect()] == ["Keep"]
    marked = filters.mark_targets(found, ("d1/*",), "/p")
    assert [r["target"] for r in marked.orderBy("ord").collect()] == [False, True, False]


def test_caches(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert caches.read_cache(spark, path, "id string").count() == 0
    caches.write_cache(spark.createDataFrame([("a",)], "id string"), path)
    assert caches.read_cache(spark, path, "id string").count() == 1 and caches.read_cache(spark, path, "id string", version=9).count() == 0
    cache = spark.createDataFrame([("a", "m", "f", [1.0], [1.0], [1.0], [1.0]), ("b", "m", "f", [1.0], None, None, None)], "id string, model_key string, fingerprint string, code_vec array<double>, style_vec array<double>, structure_vec array<double>, holistic_vec array<double>")
    asked = spark.createDataFrame([("a", "m", "f"), ("b", "m", "f"), ("a", "m", "g")], "id string, model_key string, fingerprint string")
    assert sorted(map(tuple, caches.cached_vectors(asked, cache).select("id", "fingerprint", "complete").collect())) == [("a", "f", True), ("a", "g", False), ("b", "f", False)]
    stored = [("a", 1, 1.0, "c", [("s.css", 5, 5.0)]), ("b", 1, 1.0, "c", [("t.css", 5, 5.0)]), ("c", 1, 1.0, "old", [])]
    cached = spark.createDataFrame(stored, "path string, size long, mtime double, config string, deps array<struct<path:string,size:long,mtime:double>>")
    now = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 1.0), ("c", 1, 1.0), ("s.css", 5, 5.0), ("t.css", 6, 5.0)], "path string, size long, mtime double")
    assert [r["path"] for r in caches.valid_files(cached, now, "c").collect()] == ["a"]
    assert len(caches.config_fingerprint(True, (".css",))) == 40 and caches.model_key("mock") == "mock"
    assert caches.config_fingerprint(True, ("b", "a")) == caches.config_fingerprint(True, ("a", "b"))


def test_overlap_keeps_a_row_for_each_set(spark, monkeypatch):
    rng = random.Random(7)
    data = [(i, [f"t{rng.randrange(900)}" for _ in range(220)]) for i in range(20)] + [(20 + i, [f"u{i % 3}", *(f"c{j}" for j in range(i % 12))]) for i in range(30)]
    data += [(100 + i, data[i][1][: 200 + 2 * i]) for i in range(10)] + [(200 + i, data[i % 4][1]) for i in range(12)] + [(300, None), (301, [])]
    made, write = {}, pairs.materialize
    monkeypatch.setattr(pairs, "materialize", lambda df, name: made.setdefault(name, write(df, name)))
    monkeypatch.setattr(pairs, "discard", lambda *_: None)
    monkeypatch.setattr(pairs, "ITEMS", 500, raising=False)
    monkeypatch.setattr(pairs, "RANKED", 40, raising=False)
    monkeypatch.setattr(pairs, "MEMBERS", 2, raising=False)
    sets = [(k, set(t or ())) for k, t in data]
    for least in (0.9, 0.95):
        made.clear()
        want = {(min(a, b), max(a, b)): len(x & y) / max(len(x), len(y)) for (a, x), (b, y) in itertools.combinations(sets, 2) if x and y and len(x & y) / max(len(x), len(y)) >= least}
        found = pairs.overlap_pairs(spark.createDataFrame(data, "k long, t array<string>"), "k", "t", least).collect()
        assert len(found) == len(want) and {(r["a"], r["b"]): r["overlap"] for r in found} == want
        assert len(want) > 30 and all(df.count() <= len(data) for name, df in made.items() if name not in ("counts", "met", "keyed", "needed"))
