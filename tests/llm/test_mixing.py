import re
from hashlib import md5

import pytest

from pyspark.sql import functions as F

from sway.llm.mixing import SCHEDULES, mix, mixed, ranged, time_of


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    open_, target, rest = set(names), {}, 1.5 * sum(sizes.values())
    while True:  # cap by cap, the excess reshared
        heft = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / heft >= 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
        open_ -= over
        if not open_:
            return target, names
    return target | {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}, names


def rows():
    out = []
    for i in range(400):
        source = [None, "a", "B", "é", "zz", "hot"][0 if i % 17 == 0 else min(5, i % 9)]
        out.append((i, " ".join(["w"] * (i * 7 % 23)), source))
    out += [(3, "x y", "a"), (3, "x y", "a"), (None, "x", "a"), (None, None, None), (900, "", "empty"),
            (901, "v " * 30000, "long"), (902, " \x0b\f", "hot")]
    return out


def test_against_brute_force(spark, tmp_path):
    spark.createDataFrame(rows(), "doc_id long, text string, source string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d")).selectExpr("*", "1 size", "2 target")
    got = mix(docs.drop("size", "target")).collect()
    assert len(got) == len(rows())
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows():
        sizes[s] = sizes.get(s, 0) + words(t)
    target, names = brute_targets(sizes)
    source_of = {}
    for d, t, s in rows():
        source_of.setdefault((d, words(t)), s)
    taken = {}
    for r in got:
        s = source_of[r.doc_id, r.size]
        assert r.source_size == sizes[s]
        assert r.target == pytest.approx(target[s])
        assert r.taken <= 2 * r.size and r.taken == r.size * len(r.positions)
        assert all(0 <= p <= 1 for p in r.positions) and list(r.positions) == sorted(r.positions)
        taken[s] = taken.get(s, 0) + r.taken
    longest = {s: max(words(t) for _, t, x in rows() if x == s) for s in names}
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1 for s in names)
    # the hashed order decides who is taken first in a source
    order = sorted((int(md5(str(r.doc_id).encode()).hexdigest()[:8], 16) % 4096, r.positions)
                   for r in got if source_of[r.doc_id, r.size] == "hot" and r.size)
    assert [len(p) for _, p in order] == sorted((len(p) for _, p in order), reverse=True)


def test_mixed_rows(spark, tmp_path):
    spark.createDataFrame(rows(), "doc_id long, text string, source string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    out = mixed(docs)
    assert out.columns == docs.columns
    copies = sum(len(r.positions) for r in mix(docs).collect())
    assert out.count() == copies
    assert [r.doc_id for r in out.collect()] == [r.doc_id for r in mixed(docs).collect()]


def test_empty_and_wordless_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(docs).count() == 0 and mixed(docs).count() == 0
    bare = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mix(bare).collect()] == [(0, 0.0, 0)] * 2


@pytest.mark.parametrize("schedule", SCHEDULES)
def test_time_inverts_the_integral(spark, schedule):
    def integral(t):
        steps = 20000
        weight = lambda u: next(w0 + (w1 - w0) * (u - t0) / (t1 - t0)
                                for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]) if u <= t1)
        return sum(weight((k + 0.5) * t / steps) for k in range(steps)) * t / steps

    from pyspark.sql import functions as F

    whole = integral(1.0)
    for r in spark.range(0, 11).select((F.col("id") / 10).alias("x")).withColumn("t", time_of(F.col("x"), schedule)).collect():
        assert integral(r.t) / whole == pytest.approx(r.x, abs=1e-4)


def test_a_hot_key_spreads_over_ranges(spark, tmp_path):
    docs = spark.range(6000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 7 ELSE id END AS doc_id",
        "repeat('w ', cast(id % 11 AS int)) AS text", "'hot' AS source")
    docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    order = ["doc_id", "text", "row"]
    rows = ranged(docs.withColumn("row", F.monotonically_increasing_id()), order, 500)
    counts = [r["count"] for r in rows.groupBy("range").count().collect()]
    assert sum(counts) == 6000 and len(counts) >= 10 and max(counts) <= 1500
    # range by range, the order goes on
    got = [tuple(r) for r in rows.orderBy("range", *order).select(*order).collect()]
    assert got == [tuple(r) for r in rows.orderBy(*order).select(*order).collect()]
    one = sorted(map(str, mix(docs, range_rows=10 ** 9).collect()))
    assert sorted(map(str, mix(docs, range_rows=500).collect())) == one
