import random
import re

import numpy as np
import pyarrow as pa

from kinfold import checkpoints as scratch
from kinfold.llm import neardup
from kinfold.llm.textbatch import chunks

from .conftest import words


def brute(rows, percent=85, k=5):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(low))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((root(a), root(b)))
                label[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
    return " ".join(w)


def test_equals_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(12):
        base = words(rng, rng.choice([40, 120, 300]))
        rows += [base, base.upper(), base] + [edited(rng, base, rng.randint(1, 8)) for _ in range(12)]
    rows += [words(rng, rng.randint(0, 6)) for _ in range(30)] + [None, "", "a b", "A b"]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def brute_by_row(rows):
    """component_id of each row where rows that share a doc_id are one document."""
    single = brute(list(enumerate(t for _, t in rows)))
    label = {i: i for i, _ in rows}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, (_, r) in single.items():
        p, q = sorted((root(rows[k][0]), root(rows[r][0])))
        label[q] = p
    return sorted((i, single[k][0], root(i)) for k, (i, _) in enumerate(rows))


def test_texts_that_share_a_doc_id_are_one_document(spark):
    rng = random.Random(9)
    a, b, c = (words(rng, 80) for _ in range(3))
    rows = [(5, a), (5, b), (2, b + " xx yy"), (9, a.upper()), (7, c), (7, c), (7, None), (8, c + " zz"), (3, c), (4, "lone words"), (4, None)]
    rows += [(20, words(rng, 50)) for _ in range(30)] + [(21, rows[0][1] + " tail")]
    for order in (rows, rows[::-1], rows[5:] + rows[:5]):
        found = neardup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == brute_by_row(order)


def test_only_the_result_stays_in_the_shared_folder(spark, odd):
    import os

    folder = scratch.shared_dir(spark).removeprefix("file://") + "/kinfold"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    neardup.near_duplicates(odd).collect()
    assert len(set(os.listdir(folder)) - before) == 1


def test_members_that_no_star_holds_are_linked(spark):
    # the smallest id is far from all, the others form a chain; buckets are shared throughout
    rng = random.Random(3)
    base = words(rng, 200)
    chain = [base]
    for _ in range(40):
        chain.append(edited(rng, chain[-1], 2))
    rows = list(enumerate([chain[20], *chain[:20], *chain[21:]]))
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(rows)


def test_blocks_split_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "STAR", 4)
    rng = random.Random(5)
    base = words(rng, 60)
    rows = list(enumerate(edited(rng, base, rng.randint(0, 3)) for _ in range(60)))
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(rows)


def test_a_band_that_only_looks_equal_hides_no_pair():
    # the stored bytes of the first band are equal, its hashes are not: the pair meets in the second band's bucket only
    sig = bytes(neardup.SLOTS)

    def met(first_hashes):
        columns = {"v": [1, 2], "g": [1, 2], "n": [90, 90], "own": [0, 0], "i": [0, 0], "j": [0, 0], "band": [1, 1], "sig": [sig, sig]}
        return [(x, y.tolist()) for x, y in neardup._open_pairs(pa.table(columns | {"earlier": [[h] for h in first_hashes]}), 85)]

    assert met([5, 6]) == [(0, [1])]
    assert met([5, 5]) == []


def test_odd_rows(odd, empty):
    found = neardup.near_duplicates(odd).collect()
    assert len(found) == odd.count()
    by = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert by[1]["component_id"] == by[2]["component_id"] == 0 and by[0]["kept"] and not by[1]["kept"]
    assert by[3]["n_shingles"] == by[4]["n_shingles"] == by[5]["n_shingles"] == 0 and by[5]["kept"]
    assert (by[7]["n_shingles"], by[7]["component_id"]) == (1, 6)
    assert all(r["component_id"] is None and r["kept"] for r in found if r["doc_id"] is None)
    assert neardup.near_duplicates(empty).collect() == []


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 400).astype(np.uint64)
    y = np.concatenate([x[:360], rng.integers(0, 2**63, 40).astype(np.uint64)])
    sig = neardup.super_min_hash(np.concatenate([x, y, x[:3]]), np.array([0, 400, 800, 803, 803]))
    assert abs((sig[0] == sig[1]).mean() - 360 / 440) < 0.12
    assert (sig[2] < 2**32 - 1).all() and (sig[3] == 2**32 - 1).all()
    # each element deals every rank once: a lone element's ranks are a permutation
    alone = neardup.super_min_hash(x[:1], np.array([0, 1]))[0] >> np.uint32(24)
    assert sorted(alone.tolist()) == list(range(neardup.SLOTS))


def test_sets_do_not_depend_on_chunks():
    texts = pa.array(["a b c d e f g", "x y", None, "a b c d e a b c d e"])
    whole = [s.tolist() for c in chunks(texts) for s in [neardup.shingle_sets(c, 5)[0]]]
    parts = [v for c in chunks(texts, limit=1) for v in neardup.shingle_sets(c, 5)[0].tolist()]
    assert whole[0] == parts and len(parts) == 3 + 1 + 5
