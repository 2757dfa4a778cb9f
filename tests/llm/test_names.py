"""Extra columns, whatever their names, pass through."""

import pytest

from sway.llm import decontam, mixing, sharding, simhash
from sway.llm.common import fresh

NAMES = ("__row", "__ROW_", "__slot", "__shard", "__position", "__positions", "__words", "fp", "row", "place")


@pytest.fixture
def docs(spark, tmp_path):
    rows = [(i, f"words of text number {i % 4} and more", "en", "s", i) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.selectExpr("*", *[f"doc_id * 10 + {k} `{n}`" for k, n in enumerate(NAMES)]).write.parquet(str(tmp_path / "d"))
    return spark.read.parquet(str(tmp_path / "d"))


def check(docs, out, added=()):
    assert out.columns == [*docs.columns, *added]
    rows = out.collect()
    assert rows and all(r[n] == r.doc_id * 10 + k for r in rows for k, n in enumerate(NAMES))
    return rows


def test_names_are_fresh(docs):
    row, slot = fresh(docs, "__row", "__slot")
    assert row not in docs.columns and slot not in docs.columns and row.lower() != "__row_"


def test_operators_keep_clashing_columns(spark, docs):
    assert len(check(docs, simhash.simhash_dedup(docs))) == 4
    check(docs, mixing.mixed(docs))
    assert len(check(docs, sharding.place(docs, ["a", "b"], 7), ["slot", "shard"])) == 12
    benchmark = spark.createDataFrame([(1, "no such words")], "item_id long, text string")
    found = decontam.find(docs, benchmark, own=("n", "s", "i"))
    assert set(NAMES) <= set(found.columns) and found.count() == 12


def test_pipeline_stages_keep_clashing_columns(spark, docs):
    import corpus_pipeline

    extra = docs.selectExpr("*", "'l' `__lang`", "1.5D `__score`", "'i' `__items`", "'s' `__spans`")
    out = corpus_pipeline.language_id(spark, extra, "/root/testdata/sf0.001")
    out = corpus_pipeline.decontamination(spark, out, "/root/testdata/sf0.001")
    assert out.columns == extra.columns
    assert {(r["__lang"], r["__score"], r["__items"], r["__spans"]) for r in out.collect()} == {("l", 1.5, "i", "s")}
