import numpy as np
import pytest
from pyspark.sql import functions as F

from sway.llm.langid import ByteCNN, held_out, identify, train

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, train(docs.where(~held_out(F.col("doc_id"), 4, 2)), sample=800)


def test_held_out_accuracy(fitted):
    docs, model = fitted
    got = identify(docs.select("lang", held_out(F.col("doc_id"), 4, 2).alias("h"), "text"), model).where("h").collect()
    assert len(got) > 200
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_edge_cases(spark, fitted):
    _, model = fitted
    base = "The and attion to thanedble the, anea. Eriner thanea. "
    rows = [(1, None, "a"), (2, "", "a"), (3, "123 !? \n", "a"), (4, base * 4000, "a"), (None, base, "a"), (5, base, "a"),
            (5, base, "a"), (6, "x", "a"), (7, "日本語", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    got = identify(docs, model).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "lang_pred", "score"}
    by_id = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert all(by_id[k] == ("und", 0.0) for k in (1, 2, 3))
    assert by_id[4][0] == by_id[5][0] == by_id[None][0] == "en" and by_id[None] == by_id[5]
    assert by_id[7][0] in model.labels
    assert identify(docs.limit(0), model).count() == 0


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    model = train(docs)
    assert model.labels == [] and identify(docs, model).first().lang_pred == "und"


def test_whole_text_counts(fitted):
    _, model = fitted
    en, fr = b"the and of that is ing tion " * 60, "les que ément èaux ouré la ".encode() * 60
    p = model.document_probabilities([en, fr, en + fr])
    w = np.array([-(-len(en) // model.window), -(-len(fr) // model.window)])
    assert p[2] == pytest.approx((p[0] * w[0] + p[1] * w[1]) / w.sum(), abs=0.05)


def test_gradients():
    model = ByteCNN(["a", "b", "c"], window=12, embedding=3, filters=2, widths=(2, 3))
    model.start()
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    windows = np.random.default_rng(1).integers(0, 256, (5, 12), dtype=np.uint8)
    answers = np.array([0, 1, 2, 1, 0])
    loss = lambda: -np.log(model.probabilities(windows)[np.arange(5), answers]).mean()
    grads = model.step(windows, answers)
    for name in ("out", "out_bias", "w2", "w3", "b3"):
        flat = model.weights[name].reshape(-1)
        for i in range(0, len(flat), 3):
            keep, eps = flat[i], 1e-3
            flat[i] = keep + eps
            up = loss()
            flat[i] = keep - eps
            down = loss()
            flat[i] = keep
            assert (up - down) / (2 * eps) == pytest.approx(grads[name].reshape(-1)[i], abs=5e-3)


def test_scores_are_those_of_a_plain_convolution():
    model = ByteCNN(["a", "b", "c"], window=24, embedding=3, filters=4)
    model.start(seed=2)
    w = model.weights
    draw = np.random.default_rng(5)
    for k in model.widths:
        w[f"b{k}"] = draw.standard_normal(model.filters).astype(np.float32)

    def window_probabilities(window):
        hidden = []
        for k in model.widths:
            for f in range(model.filters):
                hidden.append(max(0.0, w[f"b{k}"][f] + max(
                    sum(float(w["embed"][window[at + j], e]) * float(w[f"w{k}"][j * model.embedding + e, f])
                        for j in range(k) for e in range(model.embedding))
                    for at in range(model.window - k + 1))))
        logits = [sum(h * float(w["out"][i, c]) for i, h in enumerate(hidden)) + float(w["out_bias"][c]) for c in range(3)]
        parts = [np.exp(x - max(logits)) for x in logits]
        return [x / sum(parts) for x in parts]

    texts = [bytes(draw.integers(1, 256, n, dtype=np.uint8)) for n in (1, 23, 24, 25, 100, 24 * 70 + 5)]
    got = model.document_probabilities(texts)
    for text, found in zip(texts, got):
        padded = [text[i:i + 24].ljust(24, b"\0") for i in range(0, len(text), 24)]
        held = [sum(b != 0 for b in x) for x in padded]
        each = [window_probabilities(x) for x in padded]
        want = [sum(p[c] * n for p, n in zip(each, held)) / sum(held) for c in range(3)]
        assert found == pytest.approx(want, abs=1e-5)


def test_repeated_rows_are_learned_like_others(spark):
    rows = [(i % 5, "der und die das ist" if i % 2 else "the and of that is", "de" if i % 2 else "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(docs, sample=100)
    got = {r.text: r.lang_pred for r in identify(docs.withColumn("again", F.col("text")), model, text="again").collect()}
    assert got == {"der und die das ist": "de", "the and of that is": "en"}
