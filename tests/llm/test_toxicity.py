import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from sway.llm import toxicity
from sway.llm.langid import held_out
from sway.llm.toxicity import (AS_READ, CLASSES, DROPPED, DROPPED_READABLE, READINGS, REPEATED, Scorer, class_counts, class_of,
                               character_model, decode, fit_line, restored, score, train)


@pytest.fixture(scope="module")
def model():
    rnd = random.Random(1)
    words = "idiot stupid loser moron clown trash worthless the and of that with from this house water people".split()
    text = " ".join(rnd.choice(words) for _ in range(20000)).encode()
    counts = (class_counts([text]) + 0.1).reshape(CLASSES ** 2, CLASSES)
    return np.log(counts / counts.sum(axis=1, keepdims=True)).reshape(-1).tolist()


@pytest.mark.parametrize("seen,word", [
    ("1d10t", "idiot"), ("$tup1d", "stupid"), ("stuuuupid", "stupid"), ("l0$er,", "loser"), ("m*o*r*o*n", "moron"),
    ("cl0wn!!", "clown"), ("idiot***", "idiot"), ("tr@sh###", "trash"), ("(the)", "the"), ("i.d.i.o.t", "idiot"), ("water", "water")])
def test_restored_tokens(model, seen, word):
    assert restored(seen, model) == (word,)


def test_spaced_words(model):
    assert decode("s t u p i d", model, spaced=True) == "stupid"
    assert decode("m 0 r 0 n", model, spaced=True) == "moron"


def test_decoding_is_the_best_reading(model):
    def all_readings(token):
        before = ""
        choices = []
        for c in token:
            o = [(r, AS_READ) for r in READINGS.get(c, "")]
            o += [(c, 0.0)] if c.isalpha() else [("", DROPPED_READABLE if o else DROPPED)]
            if c == before:
                o.append(("", REPEATED))
            before = c
            choices.append(o)
        for path in product(*choices):
            word = "".join(p[0] for p in path)
            ks = [27, 27, *map(class_of, word)]
            s = sum(p[1] for p in path) + sum(model[(a * CLASSES + b) * CLASSES + k] for a, b, k in zip(ks, ks[1:], ks[2:]))
            yield s + (model[(ks[-2] * CLASSES + ks[-1]) * CLASSES + 27] if word else 0.0), word

    for token in ("1d10t", "tr@$h", "w@@ter", "1!1", "h0u5e", "aa--b", "0"):
        best = max(all_readings(token))
        read = decode(token, model)
        assert max(s for s, w in all_readings(token) if w == read) == pytest.approx(best[0])


def test_counts_of_classes():
    text = "Ab é, x"
    codes = [27, 0, 1, 27, 26, 27, 23, 27]
    want = np.zeros(CLASSES ** 3, int)
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        want[(a * CLASSES + b) * CLASSES + c] += 1
    assert (class_counts([text.encode()]) == want).all()


def test_character_model_counts_all_documents(spark):
    docs = spark.createDataFrame([("abc",), (None,), ("",), ("abd " * 50000,)], "text string").repartition(3)
    got = np.exp(np.array(character_model(docs))).reshape(CLASSES, CLASSES, CLASSES)
    assert got[0, 1, 3] == pytest.approx(50000.1 / (50001 + 2.8)) and got[0, 1, 2] == pytest.approx(1.1 / (50001 + 2.8))


def test_held_out_accuracy_and_edge_cases(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    held = held_out(F.col("doc_id"), 5, 0)
    scorer = train(docs.where(~held), labels, every=docs, sample=2000)
    got = score(docs.where(held).select("doc_id", "text"), scorer).join(labels, "doc_id").collect()
    hits = sum(r.score >= 0.5 and r.toxic == 1 for r in got)
    assert hits >= 0.75 * sum(r.toxic for r in got)
    assert sum(r.score >= 0.5 and r.toxic == 0 for r in got) <= 0.02 * len(got)
    rows = [(1, None), (2, ""), (3, "the and"), (4, "you 1d10t and l0$er, pathet1c tr@sh"), (4, "you 1d10t and l0$er, pathet1c tr@sh"),
            (None, "what a s t u p i d m 0 r 0 n"), (5, "the and of " * 30000), (6, "42 !! ***")]
    extra = spark.createDataFrame([(d, t, 0.5) for d, t in rows], "doc_id long, text string, score double")
    got = {r.doc_id: r.score for r in score(extra, scorer).collect()}
    assert got[1] == got[2] == got[6] and got[3] < 0.5 and got[5] < 0.5 and got[4] > 0.5
    assert all(0 <= s <= 1 for s in got.values())
    assert score(extra.limit(0), scorer).count() == 0


def test_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    clean = spark.createDataFrame([(1, 0), (None, 1)], "doc_id long, toxic int")
    for labels in (none, clean):
        scorer = train(docs, labels, every=docs)
        assert all(r.score < 0.01 for r in score(docs, scorer).collect())


def test_line_fit():
    w = fit_line([[1, 0], [1, 0], [1, 4], [1, 4]], [0, 1, 1, 1], [3, 1, 1, 1], ridge=1e-9)
    s = Scorer([], {}, w)
    assert s.score([1, 0]) == pytest.approx(0.25, abs=1e-3) and s.score([1, 4]) > 0.9


@pytest.mark.parametrize("text,word", [
    ("s" * 150 + "tupi" + "d" * 150, "stupid"), ("1" + "_" * 300 + "d10t", "idiot"), ("1d10t" + "." * 210 + "x", "idiot"),
    ("water,the-" * 30 + "1d10t,house", "idiot"), ("水火" * 150 + "m0r0n" + "木" * 9, "moron"), ("9" * 250 + "idiot", "idiot"),
    ("iiddiioott", "idiot"), ("stuupid", "stupid"), ("moorron", "moron"), ("worthless", "worthless"), ("1010", "lolo"),
    ("s t  u p i d", "stupid"), ("s\tt\n\nu p   i d", "stupid"), ("m  0  r  0  n", "moron"), ("a the o f", "the"), ("t h e", "the")])
def test_every_token_is_decoded(text, word):
    rnd = random.Random(1)
    words = "idiot stupid loser moron clown trash worthless the and of that with from this house water people lolo".split()
    counts = (class_counts([" ".join(rnd.choice(words) for _ in range(20000)).encode()]) + 0.1).reshape(CLASSES ** 2, CLASSES)
    model = np.log(counts / counts.sum(axis=1, keepdims=True)).reshape(-1).tolist()
    assert word in toxicity.words_of(text.upper(), model, {})
    assert Scorer(model, {f"={word}": 1.0}).evidence(text, {})[1] == 1.0


def test_parts_are_read_at_every_length(model):
    for n in (1, 10, 11, 12, 200):
        assert {"water", "idiot", "house"} <= set(restored(",".join(["water", "1d10t", "house"] * n), model))


def test_scores_against_a_plain_reading(spark, model):
    weights = {"=idiot": 3.0, "idi": 1.0, "=stupid": 2.0, "stup": 2.5, "loser": 4.0, "=house": -1.0}
    scorer = Scorer(model, weights, [-4.0, 1.0, 0.5, 0.25])
    texts = [None, "", "the house", "an 1d10t", "1d10t idiot IDIOT", "you $tup1d l0$ers, idiots", "s t u p i d idiot",
             "losers stupidity idiocy " * 500, "42 !!"]
    meant = [[], [], [], ["idiot"], ["idiot"], ["stupid", "losers", "idiots"], ["stupid", "idiot"],
             ["losers", "stupidity", "idiocy"], []]

    def probability(words):
        found = []
        for word in words:
            parts = [f"={word}"] + [word[:n] for n in (3, 4, 5, 6, 7, 8) if n <= len(word)]
            best = max(weights.get(p, 0.0) for p in parts)
            found += [best] if best > 0 else []
        found = sorted(found, reverse=True)
        first, second = (found + [0.0, 0.0])[:2]
        return 1 / (1 + np.exp(-(-4.0 + first + 0.5 * second + 0.25 * np.log(1 + len(found)))))

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in score(docs, scorer).collect()}
    for i, words in enumerate(meant):
        assert got[i] == pytest.approx(probability(words)), texts[i]


def test_copies_crowd_nothing_out(spark):
    # five texts of each label; one of them makes up most rows
    toxic = [(k, f"you idiot number {'abcde'[k]}", 1) for k in range(5)]
    clean = [(k + 5, f"the water number {'abcde'[k]}", 0) for k in range(5)]
    docs = spark.createDataFrame([r[:2] for r in toxic + clean + [toxic[0]] * 600 + [clean[0]] * 900], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in toxic + clean], "doc_id long, toxic int")
    few = train(docs.distinct(), labels, every=docs, sample=40, least=0.5)
    many = train(docs, labels, every=docs, sample=40, least=0.5)
    assert many.weights == few.weights and many.line == pytest.approx(few.line)
