from pyspark.sql import functions as F

from sway.operators.ordering import with_positions, write_ordered


def test_positions_and_files(spark, tmp_path):
    df = spark.range(5000).select("id", (F.col("id") % 7).alias("k"), F.md5(F.col("id").cast("string")).alias("h"))
    by = [F.desc("k"), F.col("h")]
    out = write_ordered(df, by, str(tmp_path / "o"), ranges=6)
    got = {r.id: r.position for r in with_positions(out).collect()}
    order = sorted(df.collect(), key=lambda r: (-r.k, r.h))
    assert got == {r.id: k for k, r in enumerate(order)}
    # the files, one after the other, hold the order
    import pyarrow.parquet as pq

    ids = []
    for f in sorted((tmp_path / "o").glob("part-*.parquet")):
        ids += pq.read_table(f).column("id").to_pylist()
    assert ids == [r.id for r in order]
    assert with_positions(out).columns == ["id", "k", "h", "position"]


def test_empty_and_equal_rows(spark, tmp_path):
    none = spark.createDataFrame([], "k int")
    assert with_positions(write_ordered(none, [F.col("k")], str(tmp_path / "e"))).count() == 0
    same = spark.range(100).select(F.lit(1).alias("k"))
    got = with_positions(write_ordered(same, [F.col("k")], str(tmp_path / "s"), ranges=4)).collect()
    assert sorted(r.position for r in got) == list(range(100))
