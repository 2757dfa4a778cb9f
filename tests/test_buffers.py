import random

import pytest
from pyspark.sql import functions as F

from sway.operators import packing as PK
from sway.operators.buffers import greedy_buffers
from sway.operators.scratch import scratch_path

TEXTS = "k long, text string"


def filled(lengths, bound):
    """Buffers filled one text after the other."""
    out, buffer, held = [], 0, 0
    for n in lengths:
        if held >= bound:
            buffer, held = buffer + 1, 0
        out.append(buffer)
        held += n
    return out


@pytest.mark.parametrize("bound, kinds", [(7, (0, 1, 30)), (50.5, (0, 0, 3, 400)), (200, (1, 12)), (1, (0, 1))])
def test_greedy_buffers_against_a_loop(spark, bound, kinds):
    rng = random.Random(int(bound))
    lengths = [rng.randint(0, k) for k in rng.choices(kinds, k=250)] + [0, 0]
    rows = [(i, n if n or i % 2 else None) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "k long, n long").repartition(5)
    got = {r.k: r.buffer for r in greedy_buffers(df, "k", F.col("n"), bound, ranges=3).collect()}
    assert got == dict(enumerate(filled(lengths, bound)))


def test_greedy_buffers_of_few_rows(spark):
    def of(lengths, bound):
        df = spark.createDataFrame(list(enumerate(lengths)), "k long, n long")
        return [r.buffer for r in greedy_buffers(df, "k", F.col("n"), bound).orderBy("k").collect()]

    assert of([], 5) == []
    assert of([0, 0, 0], 5) == [0, 0, 0]
    assert of([5, 0, 0], 5) == [0, 1, 1]
    assert of([4, 0, 1, 0], 5) == [0, 0, 0, 1]
    assert of([100, 100, 1], 5) == [0, 1, 2]
    with pytest.raises(ValueError):
        of([1], 0)


def test_greedy_packing_equals_the_loop(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcdef", k=rng.randint(0, 60))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), TEXTS)
    got = PK.pack(PK.tokenize(df, max_len=None), "k", "input_ids", 16, "|", order="key", buffers="greedy",
                  num_of_sequences=5, chars_per_token=2.0).collect()
    want = []
    numbers = filled(map(len, texts), 16 * 2.0 * 5)
    for b in range(max(numbers) + 1):
        tokens = [t for k, text in enumerate(texts) if numbers[k] == b for t in [*text.split(), "|"]]
        want += [(b, c, tokens[16 * c:16 * c + 16]) for c in range(len(tokens) // 16)]
    assert sorted((r.shard, r.chunk_id, r.input_ids) for r in got) == want
    with pytest.raises(ValueError):
        PK.pack(df, "k", "text", 16, "|", 1, buffers="other")


def test_pieces_hold_the_tokens(spark):
    texts = ["", " ", "a", "word " * 999, "x" * 5000, "a b c\n" * 300, "<|eot_id|>" * 200 + " t<|x|>u", None, " \n" * 400]
    df = spark.createDataFrame(list(enumerate(texts)), TEXTS)
    pieces = PK.text_pieces(df, "k", piece_chars=64).orderBy("k", "part").collect()
    for k, text in enumerate(texts):
        own = [r for r in pieces if r.k == k]
        assert "".join(r.piece for r in own) == (text or "") and [r.part for r in own] == list(range(len(own)))
        assert [r.last for r in own] == [False] * (len(own) - 1) + [True] * (text is not None)
    whole = {r.k: r.input_ids for r in PK.tokenize(df, max_len=None).collect()}
    parts = PK.tokenize(PK.text_pieces(df, "k", piece_chars=64), "piece", max_len=None).orderBy("k", "part").collect()
    for k, text in enumerate(texts):
        assert text is None or sum((r.input_ids for r in parts if r.k == k), []) == whole[k]


def test_packing_pieces_gives_the_same_chunks(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choices(["ab", "c", "<|eot_id|>d"], k=rng.randint(0, 300))) for _ in range(60)] + ["", None, "tok " * 40_000]
    df = spark.createDataFrame(list(enumerate(texts)), TEXTS)
    chunks = lambda p: sorted((r.shard, r.chunk_id, r.input_ids, r.labels) for r in p.collect())
    a = PK.pack_texts(df, "k", "text", 128, "|", 4, piece_chars=1000)
    assert chunks(a) == chunks(PK.pack(PK.tokenize(df, max_len=None), "k", "input_ids", 128, "|", 4))


def test_pieces_are_bounded(spark):
    df = spark.range(1).select(F.col("id").alias("k"), F.repeat(F.lit("some words "), 1_000_000).alias("text"))
    pieces = PK.text_pieces(df, "k", piece_chars=1 << 16)
    most, n = pieces.agg(F.max(F.length("piece")), F.count("*")).first()
    assert most <= (1 << 16) + 6 and n >= 160


def test_shuffled_files(spark):
    import pyarrow.parquet as pq

    path = scratch_path(spark, "shuffled")
    out = PK.write_shuffled(spark.range(2000).withColumn("x", F.col("id") * 2), "id", path, seed=5, ranges=6)
    order = [r.id for r in PK.seeded_order(spark.range(2000), "id", 5).orderBy("order_key", "id").collect()]
    assert [r.id for r in out.orderBy("position").collect()] == order
    import glob

    files = sorted(glob.glob(f"{path.removeprefix('file:')}/part-*.parquet"))
    assert len(files) > 1 and sum((pq.read_table(f).column("id").to_pylist() for f in files), []) == order
