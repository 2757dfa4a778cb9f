import pytest
from pyspark.sql import functions as F

from sway.llm import exact_dedup as module
from sway.llm.exact_dedup import exact_dedup


def rows():
    out = [(i, f"text {i % 7}") for i in range(60)]
    out += [(100, None), (101, ""), (102, " "), (None, "text 1"), (None, "lonely"), (None, "lonely"), (103, "v " * 50000),
            (104, "v " * 50000), (105, "dup"), (105, "dup"), (106, "É"), (107, "É")]
    return out


def brute():
    groups = {}
    for d, t in rows():
        groups.setdefault(t or "", []).append(d)
    out = []
    for d, t in rows():
        ids = groups[t or ""]
        known = [i for i in ids if i is not None]
        out.append((d is None, d or 0, max(known) if known else None, len(ids)))
    return sorted(out, key=str)


def check(got):
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.keep, r.group_size) for r in got), key=str) == brute()
    assert sum(r.kept for r in got) == len({t or "" for _, t in rows()})
    assert all(r.doc_id == r.keep for r in got if r.kept)


def write(spark, path):
    spark.createDataFrame(rows(), "doc_id long, text string").selectExpr("*", "1 as digest", "2 as file").repartition(5).write.parquet(path)


def test_batches_of_a_stream(spark, tmp_path):
    write(spark, str(tmp_path / "docs"))
    check(exact_dedup(spark, str(tmp_path / "docs"), files_per_batch=2).collect())


def test_batches_by_bytes(spark, tmp_path):
    write(spark, str(tmp_path / "docs"))
    check(exact_dedup(spark, str(tmp_path / "docs"), bytes_per_batch=1).collect())


def test_colliding_digests_are_told_apart_by_bytes(spark, tmp_path):
    write(spark, str(tmp_path / "docs"))
    weak = lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 1))
    check(exact_dedup(spark, str(tmp_path / "docs"), digest=weak, files_per_batch=3).collect())


def test_single_file_and_empty_table(spark, tmp_path):
    import pandas as pd

    pd.DataFrame({"doc_id": [1, 2, 3], "text": ["a", "b", "a"]}).to_parquet(tmp_path / "one.parquet")
    got = {r.doc_id: (r.keep, r.group_size, r.kept) for r in exact_dedup(spark, str(tmp_path / "one.parquet")).collect()}
    assert got == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True)}
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none"))
    assert exact_dedup(spark, str(tmp_path / "none")).count() == 0


def test_a_state_that_is_not_there_is_an_error(spark, tmp_path, monkeypatch):
    write(spark, str(tmp_path / "docs"))

    def gone(spark, *args):
        return spark.read.parquet(str(tmp_path / "no state"))

    monkeypatch.setattr(module, "digest_state", gone)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        exact_dedup(spark, str(tmp_path / "docs"))


def test_a_stream_that_missed_rows_is_an_error(spark, tmp_path, monkeypatch):
    write(spark, str(tmp_path / "docs"))
    whole = module.digest_state

    def short(*args):
        return whole(*args).where("stays.key is null or stays.key <> 104")

    def none(*args):
        return whole(*args).limit(0)

    def other(*args):
        return whole(*args).withColumn("digest", F.when(F.col("copies") == 1, F.lit(b"x")).otherwise(F.col("digest")))

    def elsewhere(*args):
        return whole(*args).withColumn("stays", F.col("stays").withField("line", F.col("stays.line") + 1000))

    for wrong in (short, none, other, elsewhere):
        monkeypatch.setattr(module, "digest_state", wrong)
        with pytest.raises(Exception, match="the state|not in the state"):
            exact_dedup(spark, str(tmp_path / "docs")).collect()


def test_a_pattern_is_streamed(spark, tmp_path):
    write(spark, str(tmp_path / "docs"))
    check(exact_dedup(spark, str(tmp_path / "doc[s]")).collect())
