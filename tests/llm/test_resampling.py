import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import pytest

from sway.llm.resampling import head_vocabulary, resample

TEXT = "doc_id long, text string"


def features(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])], len(words)


def brute(rows, target, buckets=10_000, percent=25, least=20, seed=7):
    bucket = lambda f: crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in side for f in features(x)[0]) for side in ([x for _, x in rows], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for key, text in rows:
        found, words = features(text)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(found), weight, score, None, words])
    order = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(order[:percent * len(order) // 100], 1):
        r[4] = k
    return Counter(tuple(r[:5]) for r in out)


def corpus():
    rows = []
    for i in range(300):
        rows.append((i, " ".join(f"{'Wört' if k % 3 else 'the'}{(i * k) % (40 + i % 7)}" for k in range(i % 60))))
    rows += [(None, "null key " * 15), (None, "null key " * 15), (5, None), (6, ""), (7, "...!"), (8, "the " * 50000),
             (9, "A-b_c, D\x00e f7 İ \U0001f600x"), (400, "the the " * 20), (400, "the the " * 20), (400, "the the " * 21)]
    return rows


TARGET = ["the wört1 the0 wört2 " * 10, "the null key", None, ""]


@pytest.mark.parametrize("frequent", [2.0 ** -15, 0.01, 1.0])
def test_against_brute_force(spark, tmp_path, frequent):
    spark.createDataFrame(corpus(), TEXT).repartition(5).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d")).selectExpr("*", "'x' weight", "1 rank", "2 n_features")
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = resample(docs, target, frequent=frequent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == brute(corpus(), TARGET)


def test_the_head_is_bounded(spark):
    docs = spark.createDataFrame(corpus(), TEXT)
    for frequent in (0.2, 0.01):
        head = head_vocabulary(docs, 100, frequent)
        assert 0 < len(head["words"]) <= 1 / frequent and len(head["pairs"]) <= 1 / frequent
        assert b"the" in head["words"] and head["words"][b"the"][1] == crc32(b"the")


def test_empty_tables(spark):
    none = spark.createDataFrame([], TEXT)
    docs = spark.createDataFrame([(1, "w " * 20), (2, "x " * 20)], TEXT)
    assert resample(none, docs).count() == 0
    assert Counter(map(tuple, resample(docs, none, percent=50).collect())) == brute(
        [(1, "w " * 20), (2, "x " * 20)], [], percent=50)
    assert resample(none, none).count() == 0
