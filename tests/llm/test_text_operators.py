import random
import re
from collections import Counter as Count

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinfold.llm import langid, quality, tokens, toxicity
from kinfold.llm.textbatch import chunks, windows

from .conftest import sentences, words

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_words_are_runs_outside_ascii_space():
    texts = ["ab  cd\x0bef ", "", None, "é\xa0z", "tail", "head"]
    for limit in (1, 4, 1 << 20):
        found = []
        for c in chunks(pa.array(texts), limit=limit):
            c.find_words()
            spans = [bytes(c.buf[a:b]).decode() for a, b in zip(c.start, c.end, strict=True)]
            found += [spans[a:b] for a, b in zip(c.wfirst, c.wfirst[1:], strict=False)]
        assert found == [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]


def test_windows_stay_in_their_document():
    for c in chunks(pa.array(["a b c", "b c", "a b"])):
        c.find_words()
        h, at, first = windows(c.word_hash(), c.wfirst, 2)
        assert first.tolist() == [0, 2, 3, 4] and at.tolist() == [0, 1, 3, 5]
        assert h[1] == h[2] and h[0] == h[3] != h[1]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def counts(texts, bpe=None):
    c = tokens.Counter(bpe or tokens.Bpe.load(PATH))
    return [int(n) for ch in chunks(pa.array(texts)) for n in c(ch)]


def test_tokens_equal_the_library(library):
    rng = random.Random(0)
    texts = ["".join(rng.choices("'sstrevlmdSx  \n\t1a.é🙂", k=rng.randint(0, 20))) for _ in range(5000)]
    texts += ["", "a" * 5000, " " * 3000, "ab" * 700, "<|endoftext|>", "x<|endoftext|>'s<|endoftext|> ", "it's we'll I'd", " \n\n  a  ", "½Ⅷ漢字　x"]
    texts += ["a" + chr(c) + " " + chr(c) * 2 + "1" for c in range(1, 0x3000)]
    assert counts(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_one_merge_at_a_time_gives_the_same(library):
    bpe = tokens.Bpe.load(PATH)
    bpe.unique = False
    texts = ["aaaaaaa banana mississippi", "ab" * 50, "hello hellooo"]
    assert counts(texts, bpe) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_token_counts_of_odd_rows(odd, empty, library):
    found = tokens.token_counts(odd, PATH).collect()
    texts = [r["text"] or "" for r in odd.collect()]
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in found) == sorted((len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for t in texts)
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in found)
    assert tokens.token_counts(empty, PATH).collect() == []


def test_language_of_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = langid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found) and sum(r["rejected"] for r in found) <= 0.02 * len(found)


def test_kneser_ney_probabilities_sum_to_one():
    import numpy as np

    ids = np.array([0, 0, 0, 1, 2, 1, 3, 0, 1, 2, 2, 0, 3, 1, 0], np.uint16)
    model = langid.Kneser.learn(langid.grams(ids, langid.ORDER), 3)
    for history in ([0, 0, 0], [1, 2, 1], [3, 3, 3]):
        key = np.array([(history[0] << 48) | (history[1] << 32) | (history[2] << 16) | z for z in range(5)], np.uint64)
        assert abs(model.prob(key, langid.ORDER).sum() - 1) < 1e-9


def plain_kneser_ney(text, order, letters):
    """p(symbol | history) by the textbook recursion, over dictionaries."""
    counts = {order: Count(tuple(text[i : i + order]) for i in range(len(text) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = Count(g[1:] for g in counts[k + 1])
    discount = {}
    for k, c in counts.items():
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discount[k] = min(max(once / max(once + 2 * twice, 1), 0.1), 0.95)

    def p(history, z):
        k = len(history) + 1
        lower = 1 / (letters + 2) if k == 1 else p(history[1:], z)
        same = {g: v for g, v in counts[k].items() if g[:-1] == history}
        if not same:
            return lower
        total = sum(same.values())
        return max(same.get((*history, z), 0) - discount[k], 0) / total + discount[k] * len(same) / total * lower

    return p


def test_kneser_ney_equals_the_plain_recursion():
    import numpy as np

    rng = random.Random(1)
    text = [0, 0, 0] + [rng.choice([0, 1, 1, 2, 3]) for _ in range(200)]
    model = langid.Kneser.learn(langid.grams(np.array(text, np.uint16), langid.ORDER), 3)
    plain = plain_kneser_ney(text, langid.ORDER, 3)
    for _ in range(300):
        g = [rng.randrange(5) for _ in range(langid.ORDER)]
        key = np.array([sum(x << 16 * (langid.ORDER - 1 - i) for i, x in enumerate(g))], np.uint64)
        assert abs(model.prob(key, langid.ORDER)[0] - plain(tuple(g[:-1]), g[-1])) < 1e-9


def test_shared_arrays_give_each_models_score():
    import numpy as np

    rng = random.Random(2)
    texts = [words(rng, 60, "abcd") for _ in range(20)] + [words(rng, 60, "cdef") for _ in range(20)]
    model = langid.learn(texts, ["p"] * 20 + ["q"] * 20)
    for lang, seed in (("p", "abcd"), ("q", "cdef")):
        for c in chunks(pa.array([words(rng, 8, seed), "zz q", "", "123"])):
            best, share, low, bad = model.judge(c)
            assert model.languages[best[0]] == lang and share[0] > 0.9
            assert best[2] == best[3] == -1 and bad[2] and bad[3]
            ce, _ = model.entropies(c)
            sym, first = langid.letters(c)
            ids = langid.symbol_ids(sym[: first[1] - (langid.ORDER - 1)], model.symbols)
            own = langid.Kneser.learn(np.concatenate([langid.grams(langid.symbol_ids(langid.letters(t)[0][: langid.letters(t)[1][1] - 3], model.symbols), 4) for x in texts[:20] for t in chunks(pa.array([x]))]), len(model.symbols))
            assert abs(ce[0, 0] + np.log(own.prob(langid.grams(ids, langid.ORDER), langid.ORDER)).mean()) < 1e-5


def test_a_rare_label_does_not_end_rejection():
    rng = random.Random(4)
    common = [words(rng, 60, "abcd") for _ in range(400)]
    alien = pa.array([words(rng, 60, "stuvwxyz") for _ in range(5)])
    for n in (1, 5, 20, 150):
        rare = [words(rng, 60, "efghijk") for _ in range(2 * n)]
        model = langid.learn(common + rare[:n], ["p"] * 400 + ["q"] * n)
        for c in chunks(alien):
            assert model.judge(c)[3].all()
        for c in chunks(pa.array(common[200:] + rare[n:] * (n > 1))):
            assert model.judge(c)[3].mean() <= 0.03


def test_rejection_keeps_to_its_rate_and_one_wrong_label_moves_no_limit():
    rng = random.Random(9)
    made = lambda n, seed: [words(rng, rng.randint(30, 60), seed) for _ in range(n)]
    texts, other = made(2800, "abcdefg"), made(2800, "efghijk")
    order = list(range(5600))
    rng.shuffle(order)
    both, langs = texts + other, ["p"] * 2800 + ["q"] * 2800
    model = langid.learn([both[i] for i in order], [langs[i] for i in order])
    fresh = made(3000, "abcdefg")
    bad = sum(int(model.judge(c)[3].sum()) for c in chunks(pa.array(fresh)))
    assert quality.binomial_upper(bad, 3000, 0.975) <= 2 * langid.RATE  # 2000 calibration rows, 3000 fresh ones
    for c in chunks(pa.array([words(rng, 40, "qrstuvwxyz") for _ in range(50)])):
        assert model.judge(c)[3].all()
    wrong = langid.learn(["zzzz qqqq xxxx " * 20 if i == 2700 else both[i] for i in order], [langs[i] for i in order])
    assert abs(wrong.limit[0] - model.limit[0]).max() < 0.5 * abs(model.limit[0]).max()


def test_a_language_of_long_texts_is_learned(spark):
    rng = random.Random(10)
    rows = [(i, words(rng, 12_000, "stuvwx"), "long") for i in range(24)] + [(100 + i, words(rng, 80, "abcd"), "short") for i in range(60)]
    found = langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in found} == {i: lang for i, _, lang in rows}


def test_language_of_odd_rows(odd, empty):
    found = langid.language_id(odd).collect()
    assert len(found) == odd.count()
    by = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert [by[i]["lang_pred"] for i in (3, 4, 5)] == ["und"] * 3 and by[3]["score"] == 0
    assert by[8]["lang_pred"] != "und"
    assert langid.language_id(empty).collect() == []
    nothing = odd.withColumn("lang", F.lit(None).cast("string"))
    assert langid.language_id(nothing).where("lang_pred <> 'und'").count() == 0
    assert langid.accepted(nothing).count() == odd.count() - 4  # only those without a letter go
    kept = langid.accepted(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} <= {r["doc_id"] for r in odd.collect()} - {3, 4, 5}


def slow_counts(t):
    t = t or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    c = Count(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(covered)


def test_quality_counts_equal_brute_force(spark, odd, empty, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rng = random.Random(4)
    line = words(rng, 9)
    more = [(20, f"{line}\n{line}\n\n{line} \n#", None), (21, " ".join([words(rng, 10)] * 5), None), (22, "a " * 30, None)]
    docs = odd.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"))
    found = quality.quality(docs, labels).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted(tuple(r[n] for n in names) for r in found) == sorted(slow_counts(r["text"]) for r in docs.collect())
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in found)
    assert not any(r["kept"] for r in found if r["base_failed"])
    assert quality.quality(empty, labels).collect() == []
    assert quality.quality(docs, labels.limit(0)).where("kept = base_failed").count() == 0


def test_binomial_bound_is_exact():
    for bad, n, level in ((0, 100, 0.05), (3, 50, 0.01), (10, 10, 0.05)):
        p = quality.binomial_upper(bad, n, level)
        if bad < n:
            from math import comb

            assert abs(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(bad + 1)) - level) < 1e-9
        else:
            assert p == 1


def test_cutoffs_keep_good_rows_and_reject_junk(spark):
    rng = random.Random(6)
    good = [(i, sentences(rng, 12, 12, 16)) for i in range(1800)]
    junk = [(2000 + i, " ".join(w + "###" for w in words(rng, 150).split())) for i in range(100)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in junk], "doc_id long, quality int")
    found = {r["doc_id"]: r["kept"] for r in quality.quality(docs, labels).collect()}
    assert sum(found[i] for i, _ in good) >= 0.98 * len(good)
    assert not any(found[i] for i, _ in junk)


def test_cutoffs_keep_to_their_risk():
    """Of simulated strata, no more than the level's share end with a cutoff that rejects more than RISK of good rows."""
    import numpy as np

    rng = np.random.default_rng(5)
    level = quality.DELTA / 3
    assert quality.needed_rows() == 408
    assert quality.last_standing([0, 0, 1], 407, quality.RISK, level) == -1 and quality.last_standing([0, 0, 9], 408, quality.RISK, level) == 1
    broken = used = 0
    for _ in range(400):
        good = rng.exponential(size=(1600, 2))
        part = rng.integers(0, quality.PROPOSE, 1600)
        ahead = [np.quantile(good[part == 0, k], [0.5, *quality.PATH]) for k in range(2)]
        steps = np.array(list(zip(*(quality.steps_of(q[0], q[1:]) for q in ahead), strict=True)))
        held = good[part != 0]
        last = quality.last_standing([int((held > s).any(axis=1).sum()) for s in steps], len(held), quality.RISK, level)
        if last >= 0:
            used += 1
            broken += 1 - (1 - np.exp(-steps[last, 0])) * (1 - np.exp(-steps[last, 1])) > quality.RISK
    assert used > 300 and quality.binomial_upper(int(broken), 400, 0.999) >= 0 and broken <= 400 * level + 3 * (400 * level) ** 0.5


def test_toxicity_of_held_out_rows(spark, odd, empty):
    rng = random.Random(8)
    rows = [(i, sentences(rng, 6) + (" you vile " + rng.choice(["scab", "wretch", "SCAB!"]) if i % 5 == 0 else "") + sentences(rng, 4), int(i % 5 == 0)) for i in range(900)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    found = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [r for r in rows if found[r[0]]["held_out"]]
    assert sum(found[r[0]]["predicted"] == r[2] for r in held) >= 0.95 * len(held)
    again = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs.repartition(7), labels.repartition(3)).collect()}
    assert again == {i: r["score"] for i, r in found.items()}
    strange = toxicity.toxicity(odd, labels).collect()
    assert len(strange) == odd.count() and all(0 <= r["score"] <= 1 for r in strange)
    assert toxicity.toxicity(empty, labels).collect() == []
    assert {r["score"] for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0.5}
