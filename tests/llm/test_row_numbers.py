"""Results don't depend on how files are split from one scan to the next."""

import pytest

from sway.llm import common, mixing, simhash, suffix_dedup

PARTS = "spark.sql.files.minPartitionNum"


@pytest.fixture
def docs(spark, tmp_path, monkeypatch):
    """Six files; after each table that an operator writes they are split otherwise."""
    kept, turn = common.saved, []

    def moving(df, name):
        out = kept(df, name)
        turn.append(name)
        spark.conf.set(PARTS, "1" if len(turn) % 2 else "64")
        return out

    for module in (common, mixing, simhash, suffix_dedup):
        monkeypatch.setattr(module, "saved", moving)
    base = " ".join(f"w{i * i % 97}" for i in range(60))
    rows = [(i, (base if i % 3 == 0 else f"{i} " * 70) + f" end {i}", "ab"[i % 2]) for i in range(60)]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6).write.parquet(path)
    spark.conf.set(PARTS, "64")
    yield spark.read.parquet(path)
    spark.conf.unset(PARTS)


def test_suffix_dedup(spark, docs):
    found = suffix_dedup.suffix_dedup(docs)
    for parts in ("1", "64"):
        spark.conf.set(PARTS, parts)
        got = {r.doc_id: r.n_removed for r in found.collect()}
        assert len(got) == 60 and got[0] == 0 and all(got[i] >= 100 for i in range(3, 60, 3))


def test_simhash_dedup(spark, docs):
    kept = simhash.simhash_dedup(docs)
    ids = None
    for parts in ("1", "64"):
        spark.conf.set(PARTS, parts)
        got = sorted(r.doc_id for r in kept.collect())
        ids = ids or got
        assert got == ids and 0 in got and got == sorted(
            {r.component_id for r in simhash.simhash_components(docs).collect()})


def test_mixed(spark, docs):
    want = {r.doc_id: len(r.positions) for r in mixing.mix(docs).collect() if r.positions}
    out = mixing.mixed(docs)
    for parts in ("1", "64"):
        spark.conf.set(PARTS, parts)
        got = [r.doc_id for r in out.collect()]
        assert {d: got.count(d) for d in set(got)} == want
