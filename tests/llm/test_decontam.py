import random
import re

import numpy as np
import pytest

from sway.llm.decontam import FMIndex, Phrases, find, spans, suffix_array, without

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, bench, width=10):
    out = {}
    for row, (_, text) in enumerate(docs):
        words, hit, items = WORD.findall(lower(text)), set(), set()
        for item, t in bench:
            ws = WORD.findall(lower(t))
            for at in range(max(1, len(ws) - width + 1) if ws else 0):
                w = ws[at:at + width]
                for s in range(len(words) - len(w) + 1):
                    if words[s:s + len(w)] == w:
                        hit.update(range(s, s + len(w)))
                        items.add("" if item is None else str(item))
        out[row] = (len(words), sorted(hit), sorted(items))
    return out


def tables(seed=3):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["the", "Of", "É", "日本"]
    bench = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([12, 15, 30])))) for i in range(12)]
    bench += [(50, "solo"), (51, "two words"), (52, None), (53, ""), (54, "!?"), (None, bench[0][1]), (55, bench[1][1]),
              (55, "again again again again again again again again again again again")]
    docs = []
    for i in range(60):
        words = [rnd.choice(vocab + ["other", "x-y", "9"]) for _ in range(rnd.randrange(0, 120))]
        for _ in range(rnd.randrange(3)):
            ws = rnd.choice([b[1] for b in bench if b[1]]).split()
            a = rnd.randrange(len(ws))
            words[len(words) // 2:len(words) // 2] = ws[a:a + rnd.choice([5, 10, 11, 40])]
        docs.append((i, rnd.choice([" ", ", ", "\n"]).join(words).upper() if i % 5 == 0 else " ".join(words)))
    docs += [(100, None), (101, ""), (102, "..."), (None, bench[0][1]), (103, bench[2][1]), (103, bench[2][1]),
             (104, "again " * 3000), (105, ("other " * 50 + "solo two words ") * 200)]
    return docs, bench


@pytest.mark.parametrize("options", [{}, {"shard_words": 37}, {"block_bytes": 300, "shard_words": 500}])
def test_against_brute_force(spark, options):
    docs, bench = tables()
    d = spark.createDataFrame([(i, k, t, "x") for i, (k, t) in enumerate(docs)], "row int, doc_id long, text string, spans string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    want = brute(docs, bench)
    got = find(d, b, **options).collect()
    assert len(got) == len(docs)
    for r in got:
        n, hit, items = want[r.row]
        assert (r.n_words, sorted(set().union(*(range(s["start"], s["end"]) for s in r.spans))), sorted(r["items"])) == (n, hit, items)
        assert all(x["end"] < y["start"] for x, y in zip(r.spans, r.spans[1:]))


def test_clean_text(spark):
    docs, bench = tables(8)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    out = find(d, b, clean=True).collect()
    by_text = brute(docs, bench)
    for (r, (_, text), k) in zip(out, docs, range(len(docs))):
        if not by_text[k][1]:
            assert r.text == text
        else:
            kept = [w for i, w in enumerate(WORD.findall(lower(text))) if i not in set(by_text[k][1])]
            assert WORD.findall(lower(r.text)) == kept
    assert without("A, bb (c) d.".encode(), [(1, 3)]) == "A, ) d."


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert find(d, some).count() == 0
    r = find(some.withColumnRenamed("item_id", "doc_id"), b).first()
    assert (r.n_words, r.spans, r["items"]) == (2, [], [])


def test_index_parts():
    rnd = np.random.default_rng(4)
    for n in (1, 2, 50, 300):
        symbols = np.append(rnd.integers(0, 5, n), 0)
        ends = {p: i for i, p in enumerate(np.flatnonzero(symbols == 0))}

        def key(p):
            out = []
            for q in range(p, len(symbols)):
                out.append((0, ends[q]) if symbols[q] == 0 else (1, symbols[q]))
                if symbols[q] == 0:
                    return out

        sa = suffix_array(symbols)
        assert list(sa) == sorted(range(n + 1), key=key)
        index = FMIndex(symbols, 4, sample=7)
        assert sorted(index.locate(np.arange(n + 1))) == list(range(n + 1))
        assert list(index.locate(np.arange(n + 1))) == list(sa)
    assert spans(np.array([True, False, True, True])) == [(0, 1), (2, 4)]
    assert Phrases.of([], 10).windows.shape == (0, 10)
