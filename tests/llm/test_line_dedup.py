import random

import pytest
from pyspark.sql import functions as F

from sway.llm.line_dedup import key_rows, near, near_lines, possible


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed(rnd, s, edits, letters):
    s = list(s)
    for _ in range(edits):
        at = rnd.randrange(len(s) + 1)
        kind = rnd.randrange(3)
        if kind == 0:
            s.insert(at, rnd.choice(letters))
        elif s and at < len(s):
            if kind == 1:
                s[at] = rnd.choice(letters)
            else:
                del s[at]
    return "".join(s)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_bit_parallel_distance(spark, threshold):
    rnd = random.Random(threshold)
    pairs = [("", ""), ("a", ""), ("", "abc"), ("ab", "ba"), ("日本語x", "日本x"), ("aaaa", "aaaaaa"), ("😀b", "b")]
    for _ in range(500):
        a = "".join(rnd.choice("abé") for _ in range(rnd.randrange(14)))
        pairs.append((a, changed(rnd, a, rnd.randrange(6), "abé")))
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.withColumn("near", near(F.col("a"), F.col("b"), threshold)).collect():
        assert r.near == (distance(r.a, r.b) <= threshold), (r.a, r.b)


def documents():
    rnd = random.Random(9)
    letters = "abcd é"
    bases = ["".join(rnd.choice(letters) for _ in range(rnd.choice([10, 11, 12, 17, 40, 90]))) for _ in range(25)]
    docs = []
    for i in range(60):
        lines = [changed(rnd, rnd.choice(bases), rnd.choice([0, 0, 1, 2, 3]), letters) for _ in range(rnd.randrange(6))]
        docs.append((i, "\n".join(lines + rnd.choice([[], [""], ["  ", "short"], ["shore"]]))))
    # a family of many near lines, and one very common line
    docs += [(100 + i, f"template line number {i:03d} of this family\nvery common line of all") for i in range(150)]
    docs += [(300, None), (301, ""), (302, "\n\n"), (None, bases[0]), (None, bases[0]), (303, bases[1]), (303, bases[1]),
             (304, "w" * 70000), (305, "w" * 70001 + "\r")]
    return docs


def brute(docs, threshold, per):
    lines = [(d, i, k, l) for i, (d, t) in enumerate(docs) if t is not None for k, l in enumerate(t.split("\n"))
             if any(ord(c) > 32 for c in l)]
    texts = sorted({l for *_, l in lines})
    near_by = {l: set() for l in texts}
    for i, a in enumerate(texts):
        for b in texts[i + 1:]:
            edits = min(threshold, min(len(a), len(b)) // per)
            if edits and abs(len(a) - len(b)) <= edits and (
                    distance(a, b) <= edits if len(a) < 1000 else a.strip() in b.strip() or b in a):
                near_by[a].add(b)
                near_by[b].add(a)
    group = {}
    for l in texts:
        if l not in group:
            todo = [l]
            while todo:
                x = todo.pop()
                if x not in group:
                    group[x] = l
                    todo += near_by[x]
    first = {}
    for d, i, k, l in sorted(lines, key=lambda x: (x[0] is None, x[0] or 0, x[1], x[2])):
        first.setdefault(group[l], (i, k))
    return [(i, k, group[l], len(near_by[l]), first[group[l]] == (i, k)) for _, i, k, l in lines]


@pytest.mark.parametrize("threshold,block,per", [(2, 64, 5), (1, 7, 10), (3, 64, 5), (2, 64, 3), (2, 5, 4)])
def test_against_brute_force(spark, tmp_path, threshold, block, per):
    docs = documents()
    rnd = random.Random(per)
    # short lines of all lengths around those at which the number of edits changes
    docs += [(400 + i, "\n".join("".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 16))) for _ in range(4))) for i in range(30)]
    docs += [(500, "Read more"), (501, "Read more."), (502, "a\nab\nabc")]
    spark.createDataFrame([(d, t, 1, "k") for d, t in docs], "doc_id long, text string, n int, key string").coalesce(1).write.parquet(str(tmp_path / "d"))
    table = spark.read.parquet(str(tmp_path / "d"))
    got = near_lines(table, threshold=threshold, per=per, block=block).collect()
    order = {r.row: i for i, r in enumerate(table.select(F.monotonically_increasing_id().alias("row")).collect())}
    want = brute(docs, threshold, per)
    assert sorted((order[r.row], r.line_no, r.links, r.kept) for r in got) == sorted((i, k, n, f) for i, k, _, n, f in want)
    name = {(i, k): g for i, k, g, *_ in want}
    pairs = {(r.class_id, name[order[r.row], r.line_no]) for r in got}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_empty_table(spark):
    assert near_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        near_lines(spark.createDataFrame([], "doc_id long, text string"), threshold=3, per=3)


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([], "a string, b string").select(near(F.col("a"), F.col("b"), 2))
    assert "Python" not in df._jdf.queryExecution().toString()


def test_keys_of_near_lines_meet_and_are_few(spark):
    rnd = random.Random(4)
    bases = ["".join(rnd.choice("abé日😀 ") for _ in range(n)) for n in range(5, 45) for _ in range(4)]
    bases += ["".join(rnd.choice("ab ") for _ in range(n)) for n in range(5, 45) for _ in range(4)]
    pairs = [(a, changed(rnd, a, min(2, len(a) // 5), "abé日")) for a in bases]
    pairs = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    lines = lambda k: spark.createDataFrame([(i, p[k]) for i, p in enumerate(pairs)], "id long, line string").withColumn("n", F.length("line"))
    index, probe = key_rows(lines(0), 2, 5, False), key_rows(lines(1), 2, 5, True)
    want = {i for i, (a, b) in enumerate(pairs) if distance(a, b) <= min(2, len(a) // 5)}
    assert want <= {r.id for r in index.join(probe, ["id", "key"]).collect()} and len(want) > 250
    # lengths share their places: at most 9 of 12 are left
    assert probe.groupBy("id").count().agg(F.max("count")).first()[0] <= 9


def test_first_look_leaves_near_pairs(spark):
    rnd = random.Random(6)
    pairs = [("日本語x", "日本x"), ("😀b" * 4, "b😀" * 4), ("a" * 1200, "b" * 1200)]
    for _ in range(600):
        a = "".join(rnd.choice("abé😀") for _ in range(rnd.randrange(1, 30)))
        pairs.append((a, changed(rnd, a, rnd.randrange(6), "abé😀")))
    words = [(f"a line of words, with number {i} in it", f"a line of terms, with number {i + 1} in it") for i in range(0, 90, 10)]
    df = spark.createDataFrame(pairs + words, "a string, b string")
    for t in (1, 2, 3):
        for r in df.withColumn("may", possible(F.col("a"), F.col("b"), F.length("a"), t)).collect():
            assert r.may or distance(r.a, r.b) > t
            assert not r.may or (r.a, r.b) not in words
