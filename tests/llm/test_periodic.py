import hashlib
import random
from zlib import crc32

import numpy as np
import pytest

from sway.llm.periodic import extensions, grammar, mirrored, periodic_runs, runs_of
from sway.llm.queries import looped

TEXT = "doc_id long, text string"


def brute(words, least):
    """(start, length, period) of all runs, by comparing words at every distance."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i + p - start >= max(least, 2 * p):
                found.setdefault((start, i + p - start), p)
            i += 1
    return sorted((s, n, p) for (s, n), p in found.items())


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def sample(rng, longest=70):
    words = [rng.randrange(rng.choice([1, 2, 2, 3, 30])) for _ in range(rng.randint(0, longest))]
    if words and rng.random() < 0.4:
        a = rng.randrange(len(words))
        p = rng.randint(1, max(1, (len(words) - a) // 2))
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
    return words


@pytest.mark.parametrize("least", [2, 3, 4, 12])
def test_runs_against_brute_force(least):
    rng = random.Random(least)
    for _ in range(150):
        texts = [sample(rng) for _ in range(rng.randint(1, 6))]
        got = [[] for _ in texts]
        for text, *run in zip(*runs_of(np.array(sum(texts, []), np.int64), [len(t) for t in texts], least)):
            got[text].append(tuple(map(int, run)))
        assert got == [brute(t, least) for t in texts]


def test_extensions_on_the_grammar():
    rng = random.Random(3)
    for _ in range(40):
        words = np.array(sample(rng, 120) + [99], np.int64)
        words = np.unique(words, return_inverse=True)[1]
        n = len(words)
        pairs = [(a, b) for a in range(n) for b in range(a + 1, n + 1)]
        if not pairs:
            continue
        a, b = np.array(pairs).T
        levels = grammar(words)
        for lv, w in ((levels, words), (mirrored(levels), words[::-1])):
            for x, y, got in zip(a, b, extensions(lv, a, b)):
                k = 0
                while y + k < n and w[x + k] == w[y + k]:
                    k += 1
                assert got == k


def test_grammar_spells_the_words():
    words = np.array(sample(random.Random(8), 400) * 3 + [7] * 50, np.int64)
    levels = grammar(np.unique(words, return_inverse=True)[1])
    assert len(levels[-1].symbols) == 2  # one symbol, and the mark of the end
    for low, high in zip(levels, levels[1:]):
        spelled = {}
        for k, s in enumerate(high.symbols[:-1]):
            part = tuple(low.symbols[low.first[k]:low.first[k + 1]])
            assert spelled.setdefault(s, part) == part
        assert len(set(spelled.values())) == len(spelled)


def test_operator(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{x}" for x in sample(rng, 200)) for _ in range(60)]
    texts += [None, "", " \t\n", "a " * 30000, "x y " * 6, "x y " * 5 + "x", "é\x0bé\x0c" * 9, "a\xa0b " * 12,
              ("word " * 3 + "other\n") * 4]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(1, "z " * 12)] * 2
    docs = spark.createDataFrame(rows, TEXT).selectExpr("*", "1 n_words", "2 runs", "3 collapsed")
    got = sorted(((r.doc_id is None, r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed)
                  for r in periodic_runs(docs).collect()), key=str)
    expected = []
    for key, t in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        runs = [(0, len(words), 1)] if len(words) > 9999 else brute(words, 12)
        expected.append((key is None, key, len(words), runs, collapsed(words, runs)))
    assert got == sorted(expected, key=str)
    assert periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(docs, least=1)


def test_looped_texts(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"v{rng.randrange(50)}" for _ in range(rng.randint(0, 90)))) for i in range(400)] + [(None, "a b"), (7, None)]
    got = looped(spark.createDataFrame(rows, TEXT)).collect()
    changed = 0
    for (key, text), r in zip(rows, got):
        words = (text or "").split()
        n, h = len(words), crc32(str(key).encode())
        if key is not None and h % 10 == 0 and n:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            changed += 1
            assert r.text.split() == words
        else:
            assert r.text == text
    assert changed > 20


def test_query_digests(spark, tmp_path):
    from sway.llm.queries import op12_periodic_runs

    spark.createDataFrame([(0, "a b " * 8), (1, None), (2, "q " * 12 + "r " * 14)], TEXT).write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r.doc_id: tuple(r)[1:] for r in op12_periodic_runs(spark, str(tmp_path)).collect()}
    assert got[0] == (1, 0, 16, 2, 8000, sha("0,16,2\n"), sha("a b"))
    assert got[1] == (0, None, None, None, None, sha(""), sha(""))
    assert got[2] == (2, 12, 14, 1, 14000, sha("0,12,1\n12,14,1\n"), sha("q r"))
