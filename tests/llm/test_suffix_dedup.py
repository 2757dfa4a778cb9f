import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sway.llm.suffix_dedup import GRAM, anchors, gram_hashes, repeated_windows, suffix_dedup


def brute(docs, length):
    seen, out = set(), {}
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0, i))
    for i in order:
        text = (docs[i][1] or "").encode()
        gone = bytearray(len(text))
        for s in range(len(text) - length + 1):
            w = text[s:s + length]
            if w in seen:
                gone[s:s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(text, gone) if not g)
        out[i] = (len(text), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest(), kept)
    return out


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(40), text(60), "x" * 150, "ab" * 90, "shti " * 70]
    docs = []
    for i in range(70):
        parts = [text(rnd.randrange(0, 40))]
        for _ in range(rnd.randrange(3)):
            parts += [rnd.choice(passages), text(rnd.randrange(0, 10))]
        docs.append((rnd.randrange(1000), "".join(parts)))
    base = docs[3][1] + text(80)
    for _ in range(15):  # near copies
        at = rnd.randrange(len(base))
        docs.append((rnd.randrange(1000), base[:at] + word() + base[at + rnd.randrange(4):]))
    docs += [(2000, None), (2001, ""), (2002, "short"), (2003, "short"), (None, base), (None, base), (2004, base), (2004, base),
             (5, passages[0][:100]), (6, passages[0][:99]), (7, "\0" * 130), (8, "\0" * 131 + "z"), (2005, "abc " * 40000), (2006, base * 3)]
    return docs


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"hot": 3}), (3, {"length": 40, "hot": 20}), (4, {"length": 24})])
def test_against_brute_force(spark, tmp_path, seed, options):
    docs = corpus(seed)
    path = str(tmp_path / "d")
    spark.createDataFrame([(d, t, i, "x") for i, (d, t) in enumerate(docs)], "doc_id long, text string, place int, row string").coalesce(1).write.parquet(path)
    table = spark.read.parquet(path)
    order = [r.place for r in table.select("place").collect()]
    want = brute([docs[i] for i in order], options.get("length", 100))
    got = suffix_dedup(table, with_kept=True, **options).collect()
    assert len(got) == len(docs)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got) == sorted(
        (str(docs[order[i]][0]), *w[:4]) for i, w in want.items())
    assert sorted(bytes(r.kept) for r in got) == sorted(w[4] for w in want.values())


def test_small_batches(spark, monkeypatch):
    import sway.llm.suffix_dedup as m

    monkeypatch.setattr(m, "BATCH", 500)
    monkeypatch.setattr(m, "BROADCAST_ROWS", 0)
    docs = corpus(9)
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    want = brute(docs, 100)
    got = suffix_dedup(df).collect()
    assert sorted((str(r.doc_id), r.n_removed, r.kept_sha256) for r in got) == sorted(
        (str(docs[i][0]), w[1], w[3]) for i, w in want.items())


def test_empty_table(spark):
    assert suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup(spark.createDataFrame([], "doc_id long, text string"), length=10)


@pytest.mark.parametrize("step", [64, 1 << 17])
def test_anchors_cover_each_window_once(step):
    rnd = np.random.default_rng(3)
    texts = [rnd.integers(97, 100, n, dtype=np.uint8) for n in (0, 99, 100, 101, 400, 3, 250)] + [np.full(300, 97, np.uint8)]
    ends = np.cumsum([len(t) for t in texts])
    text, start, windows, hashes = anchors(np.concatenate(texts), ends, 100, step)
    seen = []
    for t, s, n, h in zip(text, start, windows, hashes):
        for w in range(s, s + n):
            seen.append((t, w))
            x = gram_hashes(np.ascontiguousarray(texts[t][w:w + 100]))
            top = x >> np.uint64(32)
            assert x[np.flatnonzero(top == top.min())[0]] == h
    assert sorted(seen) == [(t, w) for t, x in enumerate(texts) for w in range(len(x) - 99)]
    assert GRAM == 24


def test_suffix_array_classes():
    rnd = np.random.default_rng(5)
    contexts = [rnd.integers(97, 99, n, dtype=np.uint8) for n in (30, 45, 30, 12, 64)] + [np.full(40, 0, np.uint8)] * 2
    data = np.concatenate(contexts)
    lengths = np.array([len(c) for c in contexts])
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(data))
    for depth in (8, 9, 20, 30):
        seen, want = set(), []
        for p in np.flatnonzero(left >= depth):
            w = data[p:p + depth].tobytes()
            if w in seen:
                want.append(p)
            seen.add(w)
        assert list(repeated_windows(data, left, depth)) == want
