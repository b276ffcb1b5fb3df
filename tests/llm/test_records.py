import hashlib
import random

import pytest
from pyspark.sql import functions as F

from kinfold import checkpoints as scratch
from kinfold.llm import chat, decontam, mixing, spans, warc

from .conftest import sentences, words


def items_of(spark, rng, n=6):
    texts = [sentences(rng, 4, 8, 12) for _ in range(n)]
    return texts, spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_leaks_are_found_whole_edited_and_cut(spark):
    rng = random.Random(1)
    texts, items = items_of(spark, rng)
    edited = texts[1].split()
    for k in range(4, len(edited), 7):
        edited[k] = "changed"
    shorter = [w for k, w in enumerate(texts[2].split()) if k % 9]
    around = lambda t: f"{sentences(rng, 5)} {t} {sentences(rng, 5)}"
    docs = [around(texts[0].upper()), around(" ".join(edited)), around(" ".join(shorter)), around(" ".join(texts[3].split()[:28])), sentences(rng, 20), texts[4], "the " * 500]
    found = decontam.leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), items).collect()
    scores = {(r["doc_id"], r["item_id"]): r["score"] for r in found}
    assert set(scores) == {(0, 0), (1, 1), (2, 2), (3, 3), (5, 4)}
    assert scores[0, 0] == scores[5, 4] == 1 and scores[1, 1] < 1


def test_leaks_with_half_of_their_seeds_broken_are_found(spark):
    rng = random.Random(11)
    texts, items = items_of(spark, rng, 4)
    changed = lambda t, every: " ".join(f"new{k}" if k % every == every - 1 else w for k, w in enumerate(t.split()))
    half = lambda t: " ".join(t.split()[: (len(t.split()) + 1) // 2])
    copies = [changed(texts[0], 4), changed(texts[1], 5), changed(texts[2], 6), half(texts[3])]
    # the half that is left holds the item's frequent n-grams
    docs = [*(f"{sentences(rng, 5)} {c} {sentences(rng, 5)}" for c in copies), *[half(texts[3])[:-1] + "x"] * 3]
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, items).collect()}
    assert {(i, i) for i in range(4)} <= found
    assert decontam.clean(docs, items).where("doc_id < 4").count() == 0


def test_recall_against_alignment_of_every_pair(spark):
    """Items of 1 to 40 words, copied with a share of their words replaced, dropped or doubled: of the pairs that a full alignment
    scores SCORE or more, at least 95 % are found, and no others."""
    rng = random.Random(21)
    texts = [" ".join(f"w{rng.randrange(50_000)}" for _ in range(n)) for n in range(1, 41) for _ in range(5)]
    found_of, wanted_of, missed = 0, 0, {}
    for share in (0.1, 0.2, 0.3):
        docs = []
        for t in texts:
            w = t.split()
            for k in rng.sample(range(len(w)), round(share * len(w))):
                w[k] = rng.choice([f"x{rng.randrange(9999)}", "", f"{w[k]} y{rng.randrange(9999)}"])
            docs.append(" ".join(f"w{rng.randrange(50_000)}" for _ in range(30)) + " " + " ".join(w) + " " + " ".join(f"v{rng.randrange(500)}" for _ in range(30)))
        found = decontam.leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")).collect()
        chunk = lambda t: decontam.plain_words(decontam.Chunk(*decontam._flat([t]), 0, lower=True))
        xs, ys = [chunk(t) for t in texts], [chunk(t) for t in docs]
        wanted = set()
        for i, x in enumerate(xs):
            best, _ = decontam.align([x] * len(ys), ys)
            wanted |= {(d, i) for d, b in enumerate(best) if b >= decontam.SCORE * 2 * len(x)}
        got = {(r["doc_id"], r["item_id"]) for r in found}
        assert got <= wanted
        missed[share] = 1 - len(got) / len(wanted)
        found_of, wanted_of = found_of + len(got), wanted_of + len(wanted)
    assert max(missed.values()) <= 0.08 and found_of >= 0.95 * wanted_of, missed


def test_a_template_alone_is_no_leak(spark):
    rng = random.Random(22)
    template = "read the passage below with care and then choose the best of"
    items = [(i, f"{template} {words(rng, 8)}") for i in range(5000)]
    docs = [(i, f"{sentences(rng, 3)} {template} {sentences(rng, 3)}") for i in range(20)] + [(20, f"{sentences(rng, 3)} {items[7][1]} {sentences(rng, 2)}"), (21, f"so {items[9][1]}")]
    found = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found if r["score"] == 1} == {(20, 7), (21, 9)}
    assert {r["doc_id"] for r in found} == {20, 21}


def test_short_items_and_equal_texts(spark):
    items = spark.createDataFrame([(1, "Zyzzyva"), (2, "quokka sonnet"), (3, "Alpha beta, gamma delta epsilon zeta eta."), (4, "alpha beta gamma delta epsilon zeta eta"), (5, "..")], "item_id long, text string")
    docs = spark.createDataFrame([(0, "a zyzzyva b"), (1, "the quokka sonnet"), (2, "quokka and sonnet"), (3, "alpha beta gamma CHANGED epsilon zeta eta"), (4, "nothing of it")], "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]): round(r["score"], 2) for r in decontam.leaks(docs, items).collect()}
    assert found == {(0, 1): 1.0, (1, 2): 1.0, (3, 3): 0.79, (3, 4): 0.79}


def test_frequent_copies_of_an_item_are_all_found(spark):
    rng = random.Random(23)
    texts, items = items_of(spark, rng, 3)
    docs = [(i, f"{sentences(rng, 2)} {texts[0]}") for i in range(300)] + [(300 + i, sentences(rng, 4)) for i in range(300)]
    found = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(i, 0) for i in range(300)}


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rng = random.Random(2)
    texts, items = items_of(spark, rng)
    docs = spark.createDataFrame([(i, f"{sentences(rng, 3)} {t}") for i, t in enumerate(texts)], "doc_id long, text string")
    one = sorted(map(tuple, decontam.leaks(docs, items).collect()))
    monkeypatch.setattr(decontam, "BLOCK", 1)
    assert sorted(map(tuple, decontam.leaks(docs, items).collect())) == one and len(one) == len(texts)
    assert decontam.clean(docs, items).count() == 0


def test_alignment_equals_plain_dynamic_programming():
    import numpy as np

    rng = np.random.default_rng(0)
    xs = [rng.integers(1, 6, rng.integers(1, 12)).astype(np.uint64) for _ in range(40)]
    ys = [rng.integers(1, 6, rng.integers(1, 30)).astype(np.uint64) for _ in range(40)]
    best, _ = decontam.align(xs, ys)
    for x, y, b in zip(xs, ys, best, strict=True):
        h = np.zeros((len(x) + 1, len(y) + 1), int)
        for i in range(len(x)):
            for j in range(len(y)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if x[i] == y[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert h.max() == b


def test_whole_items_in_the_test_tables(spark, sf_dir):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    held = docs.crossJoin(items.select("item_id", F.col("text").alias("item"))).where(F.contains("text", F.col("item"))).select("doc_id", "item_id").collect()
    found = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, items).collect()}
    assert {tuple(r) for r in held} <= found and held


def test_leaks_of_odd_rows(odd, empty, spark):
    items = spark.createDataFrame([(1, None), (None, "a b c d"), (2, ""), (3, "one two"), (4, odd.where("doc_id = 1").first()["text"][:200])], "item_id long, text string")
    found = decontam.leaks(odd, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(0, 4), (1, 4), (2, 4), (6, 3), (7, 3)}
    assert decontam.leaks(empty, items).collect() == [] and decontam.leaks(odd, items.limit(0)).collect() == []
    assert decontam.clean(odd, items.limit(0)).count() == odd.count()
    kept = decontam.clean(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 7  # the row without an id holds it too


def test_repeated_passages_go_but_for_the_first(spark):
    rng = random.Random(3)
    passage = sentences(rng, 6, 9, 12)
    own = [sentences(rng, 6) for _ in range(8)]
    rows = [(0, own[0]), (1, f"{own[1]}\n{passage}\n{own[2]}"), (2, f"{own[3]} {passage} {own[4]}"), (3, passage), (4, f"{own[5]}\n{passage}\n{passage}"), (5, own[6])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in spans.deduplicated(docs, report=True).collect()}
    assert set(found) == {2, 3, 4} and found[2]["first_doc_ids"] == [1] and found[3]["text"].strip() == ""
    assert found[2]["text"].split() == (own[3] + " " + own[4]).split() and found[4]["text"].split() == own[5].split()
    whole = {r["doc_id"]: r["text"] for r in spans.deduplicated(docs).collect()}
    assert all(whole[i] == t for i, t in rows if i not in found)


def test_passages_that_begin_and_end_in_mid_sentence_go(spark):
    rng = random.Random(12)
    text = lambda n, size: " ".join(f"w{rng.randrange(3000)}" + "." * (k % size == size - 1) for k in range(n))
    passages = []
    for size in (12, 18, 23, 40):
        for _ in range(40):
            w, o = text(140, size).split(), rng.randrange(80)
            passages.append(" ".join(w[o : o + 51]))
    passages += ["one two " * 25 + "one", "same " * 51]  # periodic
    rows = [(i, f"{text(30, 9)} {p.strip()} {text(30, 7)}") for i, p in enumerate(passages * 2)]
    left = spans.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    size = {r["doc_id"]: len(r["text"].split()) for r in left}
    n = len(passages)
    assert all(size[i + n] <= len(rows[i + n][1].split()) - 20 for i in range(n))
    assert all(size[i] == len(rows[i][1].split()) for i in range(n - 2))


def test_a_passage_without_sentence_ends(spark):
    rng = random.Random(4)
    passage = words(rng, 90)
    rows = [(i, f"{words(rng, 13 + i)} {passage} {words(rng, 40)}") for i in range(3)]
    found = {r["doc_id"]: r for r in spans.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), report=True).collect()}
    assert set(found) == {1, 2}
    gone = [len(rows[i][1].split()) - len(found[i]["text"].split()) for i in (1, 2)]
    assert all(45 <= g <= 95 for g in gone)


def test_texts_that_share_a_doc_id_are_cut_apart(spark):
    rng = random.Random(31)
    passage, alone = sentences(rng, 6, 9, 12), sentences(rng, 8, 9, 12)
    rows = [(1, f"{passage} {sentences(rng, 3)}"), (2, alone), (2, f"{sentences(rng, 2)} {passage}"), (3, alone.upper()), (3, passage), (3, f"{passage} tail")]
    for order in (rows, rows[::-1]):
        left = [(r["doc_id"], r["text"]) for r in spans.deduplicated(spark.createDataFrame(order, "doc_id long, text string")).collect()]
        assert sorted((i, len(t.split())) for i, t in left) == sorted([(1, len(rows[0][1].split())), (2, len(alone.split())), (2, len(rows[2][1].split()) - len(passage.split())), (3, 0), (3, 0), (3, 1)])
    # both texts of the first doc_id hold it: one keeps it, whichever comes first
    both = [(1, f"{passage} one"), (1, f"{passage} two")]
    for order in (both, both[::-1]):
        left = {r["text"].split()[-1]: len(r["text"].split()) for r in spans.deduplicated(spark.createDataFrame(order, "doc_id long, text string")).collect()}
        assert sorted(left.values())[0] == 1 and sorted(left.values())[1] == len(passage.split()) + 1


@pytest.mark.parametrize("small", [0, 1000])
def test_spans_of_odd_rows(odd, empty, small, monkeypatch):
    monkeypatch.setattr(scratch, "SMALL", small)
    out = spans.deduplicated(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    rows = {(r["doc_id"], r["lang"]): r for r in out.collect()}
    before = {(r["doc_id"], r["lang"]): r for r in odd.collect()}
    for key in before:
        if key[0] in (None, 0, 3, 4, 5, 6, 7, 8, 9, 10):
            assert rows[key] == before[key]
    assert rows[1, "en"]["text"].strip() == "" and rows[1, "en"]["n_chars"] == len(rows[1, "en"]["text"])
    assert 0 < len(rows[2, "en"]["text"]) < len(before[2, "en"]["text"])
    assert spans.deduplicated(empty).collect() == [] and spans.deduplicated(empty, report=True).collect() == []


PAGES = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2\r\nX: y", "<p>x</p>"), (3, None, None), (4, "http://a/é%0D", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n"), (None, "n", "<p>x</p>"), (None, "n", "only here"), (6, "z", "z" * 300_000), (6, "z", "z" * 300_000), (7, "w", "z" * 300_000)]


def test_archive_round_trip(spark):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, sha256 int")
    path = scratch.new_path(spark, "archive")
    warc.write_archive(pages, path)
    digest = lambda t: warc.sha1_text((t or "").encode())
    top = {}
    for i, _, h in PAGES:
        if i is not None:
            top[h or ""] = max(top.get(h or "", i), i)
    want = [(i, len((h or "").encode()), digest(h), "response" if i is None or i == top[h or ""] else "revisit", None if i is None or i == top[h or ""] else top[h or ""]) for i, _, h in PAGES]
    found = [tuple(r) for r in warc.read_archive(spark, path).collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == stored.select("sha256").distinct().count() == len({h or "" for _, _, h in PAGES})
    for r in warc.records(spark, path).where("kind = 'response'").collect():
        fields, payload = warc.parse_record(bytes(r["record"]))
        assert fields["WARC-Payload-Digest"] == "sha1:" + warc.sha1_text(payload) and "X" not in fields
    least = scratch.new_path(spark, "archive")
    warc.write_archive(pages, least, least=100)
    assert warc.read_archive(spark, least).where("record_type = 'revisit'").count() == 2


def test_a_changed_payload_is_noticed(spark):
    path, address, both, gone = (scratch.new_path(spark, "archive") for _ in range(4))
    warc.write_archive(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string"), path)
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads").withColumn("payload", F.encode(F.lit("abd"), "UTF-8"))
    headers.write.parquet(f"{address}/headers")
    payloads.write.parquet(f"{address}/payloads")
    with pytest.raises(Exception, match="differs from its address"):
        warc.read_archive(spark, address).collect()
    # the address forged as well: the header's own digest tells
    headers.withColumn("sha256", F.sha2(F.lit("abd").cast("binary"), 256)).write.parquet(f"{both}/headers")
    payloads.withColumn("sha256", F.sha2("payload", 256)).write.parquet(f"{both}/payloads")
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_archive(spark, both).collect()
    headers.write.parquet(f"{gone}/headers")
    payloads.limit(0).write.parquet(f"{gone}/payloads")
    with pytest.raises(Exception, match="no payload of"):
        warc.read_archive(spark, gone).collect()


def test_urls_come_back(spark):
    urls = ["http://a/b", "a\nb", "a%0Ab", "a\r%0D%250A%25%\r", "%25%2525", None, "%%0D", "é%"]
    path = scratch.new_path(spark, "archive")
    warc.write_archive(spark.createDataFrame([(i, u, f"p{i}") for i, u in enumerate(urls)], "page_id long, url string, html string"), path)
    found = {r["page_id"]: warc.parse_record(bytes(r["record"]))[0]["WARC-Target-URI"] for r in warc.records(spark, path).collect()}
    assert {i: warc.unescaped_url(u) for i, u in found.items()} == {i: u or "" for i, u in enumerate(urls)}


def test_an_empty_archive(spark):
    path = scratch.new_path(spark, "archive")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archive(spark, path).collect() == []


def test_turns_round_trip():
    rng = random.Random(5)
    for _ in range(3000):
        role, text = ("".join(rng.choices(["\\", "#", "###", "</turn>", "<", ":", " ", "\n", "a", "é"], k=rng.randint(0, 8))) for _ in range(2))
        formatted = chat.format_turn(role, text)
        assert chat.parse_turn(formatted)[:2] == (role, text)


def turns(spark):
    said = "\\### Assistant: </turn> ok"
    convs = {1: [("user", "hi"), ("assistant", "yo"), ("user", "a")], 2: [("user", "hi"), ("assistant", "yo"), ("user", "b"), ("assistant", "")], 3: [("user", "hi"), ("assistant", "yo"), ("user", "a")], 4: [(None, None)], 5: [("assistant", "x" * 70_000)], -7: [("user", said), ("assistant", said)]}
    rows = [(c, i, r, t, "k") for c, own in convs.items() for i, (r, t) in enumerate(own)] + [(None, None, "user", "lost", "k")]
    convs[None] = [("user", "lost")]
    return convs, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string")


def joined(spans):
    """Spans with those that touch made one."""
    out = []
    for a, b in spans:
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def test_a_long_conversation_is_one_segment(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(600)] + [(2, i, "user" if i % 2 else "assistant", f"t{i}" if i < 300 else "else") for i in range(301)]
    tree, members = chat.prefix_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    nodes = tree.collect()
    assert len(nodes) == 601 and max(len(r["attend"]) for r in nodes) == 2
    assert {r["conv_id"]: r["n_turns"] for r in chat.read_back(tree, members).collect()} == {1: 600, 2: 301}


def test_tree_is_emitted_once_and_read_back(spark):
    convs, rows = turns(spark)
    tree, members = chat.prefix_tree(rows)
    found = {r["conv_id"]: r for r in chat.read_back(tree, members).collect()}
    assert set(found) == set(convs)
    for c, own in convs.items():
        clean = [(r or "", t or "") for r, t in own]
        learned = "".join(t for r, t in clean if r == "assistant")
        r = found[c]
        assert r["n_turns"] == len(own) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in clean).encode()).hexdigest()
        assert r["loss_chars"] == len(learned) and r["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
        assert r["formatted_chars"] == sum(len(chat.format_turn(*t)) for t in clean)
    nodes = sorted(tree.collect(), key=lambda r: r["offset"])
    assert len(nodes) == len({tuple((r or "", t or "") for r, t in own[: k + 1]) for own in convs.values() for k in range(len(own))})
    by, ahead = {r["node"]: r for r in nodes}, 0
    for r in nodes:  # offsets are dense, depth first, and a node attends to exactly its ancestors
        assert r["offset"] == ahead
        ahead += len(r["formatted"])
        chain, up = [], r["parent"]
        while up:
            chain.insert(0, (by[up]["offset"], by[up]["offset"] + len(by[up]["formatted"])))
            up = by[up]["parent"]
        assert joined((a["from"], a["to"]) for a in r["attend"]) == joined(chain) and r["position"] == sum(b - a for a, b in chain) and r["depth"] == len(chain) + 1
    for r in nodes:  # a subtree is one run
        end = r["offset"] + len(r["formatted"])
        inside = [n["offset"] for n in nodes if any(a["from"] <= r["offset"] and end <= a["to"] for a in n["attend"])]
        assert not inside or max(inside) <= r["offset"] + sum(len(n["formatted"]) for n in nodes if n["offset"] in inside or n is r)
    empty_tree = chat.prefix_tree(rows.limit(0))
    assert empty_tree[0].collect() == [] and chat.read_back(*empty_tree).collect() == []


def sequential_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    capped, left = {}, sum(sizes.values())
    while True:
        free = [n for n in names if n not in capped]
        rest = left - sum(capped.values())
        out = {n: rest * w[n] / sum(w[m] for m in free) for n in free}
        above = [n for n in free if out[n] > most * sizes[n]]
        if not above:
            return capped | out
        capped |= {n: float(most * sizes[n]) for n in above}


def test_mix_meets_targets(spark, monkeypatch):
    rng = random.Random(6)
    shape = {"a": 400, "b": 30, "c": 3, "d": 1, "é": 60, None: 5, "nil": 2}
    rows, i = [], 0
    for s, n in shape.items():
        for _ in range(n):
            rows.append((i, s, " ".join("w" * rng.randint(1, 3) for _ in range(0 if s == "nil" else rng.randint(0, 60)))))
            i += 1
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    monkeypatch.setattr(mixing, "CELL", 16)
    out = mixing.mix(docs)
    found = {r["doc_id"]: r for r in out.collect()}
    sizes = {s: sum(len(t.split()) for _, x, t in rows if x == s) for s in shape}
    want = sequential_targets(sizes)
    for s in shape:
        own = [found[k] for k, x, _ in rows if x == s]
        assert all(r["size"] == len(rows[r["doc_id"]][2].split()) and r["source_size"] == sizes[s] for r in own)
        assert abs(own[0]["target"] - want[s]) < 1e-6 and abs(sum(r["taken"] for r in own) - want[s]) < 1
    assert all(r["taken"] <= 3 * r["size"] and all(0 <= p <= 1 for p in r["positions"]) for r in found.values())
    monkeypatch.setattr(mixing, "CELL", 4096)
    assert {r["doc_id"]: r for r in mixing.mix(docs.repartition(9)).collect()} == found
    first = [r["positions"][0] for r in out.collect() if r["positions"]]
    assert first == sorted(first)


def test_training_order_has_every_copy_in_place(spark):
    rng = random.Random(16)
    rows = [(i, "abc"[min(i % 7, 2)], "w " * rng.randint(0, 30)) for i in range(300)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    copies = mixing.training_order(out).collect()
    taken = {r["doc_id"]: r["taken"] for r in out.collect()}
    assert [r["position"] for r in copies] == sorted(r["position"] for r in copies)
    for i in taken:
        own = [r for r in copies if r["doc_id"] == i]
        assert sum(r["words"] for r in own) == taken[i] and all(r["words"] > 0 for r in own)
        assert [r["copy"] for r in own] == list(range(len(own)))
    # cumulative words of a source follow its demand: at time t it has been given what its schedule asks for up to t
    facts = {r["source"]: r for r in out.collect()}
    for rank, s in enumerate("abc"):
        slope, given = mixing.SLOPE * (rank - 1), 0
        for r in copies:
            if r["source"] == s:
                t = r["position"]
                assert abs(facts[s]["target"] * (t * (1 - slope) + slope * t * t) - given) < 1e-6 * facts[s]["target"] + 1
                given += r["words"]


def test_positions_invert_the_integrated_schedule(spark):
    rows = [(d / 10, s) for d in range(11) for s in (-0.5, 0.0, 0.5)]
    out = spark.createDataFrame(rows, "done double, slope double").select("*", mixing.position(F.col("done"), F.lit(1.0), F.col("slope")).alias("t")).collect()
    assert all(abs(r["t"] * (1 - r["slope"]) + r["slope"] * r["t"] ** 2 - r["done"]) < 1e-12 for r in out)


def test_mix_of_odd_rows(odd, empty):
    found = mixing.mix(odd).collect()
    assert len(found) == odd.count() and all(r["taken"] <= 3 * r["size"] for r in found)
    assert mixing.mix(empty).collect() == []
    assert mixing.mix(odd.where("doc_id in (3, 4, 5)")).where("taken <> 0").count() == 0
