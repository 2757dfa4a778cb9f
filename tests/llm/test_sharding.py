from collections import Counter

import pytest

from sway.llm.sharding import fill, is_prime, lookup_table, place


def test_slots_are_even_and_few_move():
    names = [f"n{i}" for i in range(20)]
    table = fill(names, 6553)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = fill(names[:-1], 6553)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 19)
    assert moved < 0.25 * 6553
    assert fill(["only"], 2) == [0, 0]


def test_fill_by_hand():
    # turn by turn over explicit permutations
    from sway.llm.sharding import _number

    names, slots = ["a", "b", "c"], 13
    prefs = [[(_number(n, "offset") % slots + j * (_number(n, "skip") % (slots - 1) + 1)) % slots for j in range(slots)]
             for n in names]
    owner = {}
    while len(owner) < slots:
        for i, p in enumerate(prefs):
            free = [s for s in p if s not in owner]
            if free:
                owner[free[0]] = i
    assert [owner[s] for s in range(slots)] == fill(names, slots)


def test_bad_arguments(spark):
    for bad in ((["a"], 8), (["a", "a"], 7), ([], 7), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            fill(*bad)
    assert is_prime(6553)
    with pytest.raises(ValueError):
        place(spark.range(1).selectExpr("id doc_id", "'' text"), ["a"], 2097169)


def test_place(spark):
    rows = [(1, "a", "x"), (1, "b", "x"), (None, "t", "x"), (None, "t", "y"), (None, None, None), (2, "w " * 100000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = place(docs, ["a", "b", "c"], 101)
    assert got.columns == ["doc_id", "text", "slot", "shard"]
    got = got.collect()
    assert len(got) == 6
    table = {r.slot: r.shard for r in lookup_table(spark, ["a", "b", "c"], 101).collect()}
    assert all(table[r.slot] == r.shard for r in got)
    assert len({r.slot for r in got if r.doc_id == 1}) == 1 and len({r.slot for r in got if r.text == "t"}) == 1
    assert place(docs.limit(0), ["a"], 2).count() == 0


def test_native_plan(spark):
    docs = spark.range(10).selectExpr("id doc_id", "'' text")
    plan = place(docs, ["a", "b"], 101)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "ExistingRDD" not in plan
