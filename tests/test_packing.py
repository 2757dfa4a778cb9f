"""Packing, splitting and ranking against naive Python versions."""

import hashlib
import random

from pyspark.sql import functions as F

from sway.operators import packing as PK


def _tok_df(spark, docs):
    return spark.createDataFrame([(k, v) for k, v in docs.items()], "k long, ids array<string>")


def naive_pack(docs, L, sep, order):
    stream = []
    for k in order:
        stream.extend(docs[k] + [sep])
    return [stream[i:i + L] for i in range(0, len(stream), L) if len(stream[i:i + L]) == L]


def test_pack_paper_case(spark):
    df = _tok_df(spark, {1: ["a", "b", "c"], 2: ["d", "e", "f", "g"]})
    out = PK.pack(df, "k", "ids", seq_length=4, sep="E", shards=1, order="key").orderBy("chunk_id").collect()
    assert [r.input_ids for r in out] == [["a", "b", "c", "E"], ["d", "e", "f", "g"]]  # 9 ids -> 2 chunks, 1 dropped
    assert all(r.labels == r.input_ids for r in out)


def test_pack_matches_naive_packer_per_shard(spark):
    rnd = random.Random(7)
    docs = {k: [f"t{k}_{i}" for i in range(rnd.randint(0, 40))] for k in range(60)}
    L, shards, seed = 16, 3, 11
    df = _tok_df(spark, docs)
    got = PK.pack(df, "k", "ids", seq_length=L, sep="<s>", shards=shards, seed=seed).collect()
    tags = df.select("k", PK.shard_of("k", shards, seed).alias("s"), PK.order_key("k", seed).alias("o")).collect()
    expected = []
    for s in range(shards):
        order = [t.k for t in sorted((t for t in tags if t.s == s), key=lambda t: (t.o, t.k))]
        expected += [(s, tuple(c)) for c in naive_pack(docs, L, "<s>", order)]
    assert sorted((r.shard, tuple(r.input_ids)) for r in got) == sorted(expected)
    # invariants: every chunk exactly L, packed tokens <= input tokens + separators
    assert all(len(r.input_ids) == L for r in got)
    assert len(got) * L <= sum(len(v) + 1 for v in docs.values())


def test_split_challenge_paper_case(spark):
    df = spark.createDataFrame([([1, 9, 7, 7, 9, 2, 3],), ([1, 2, 9, 3],), ([9, 9],)], "ids array<int>")
    plain, chal = PK.split_challenge("ids", 9)
    got = [(r.p, r.c) for r in df.select(plain.alias("p"), chal.alias("c")).collect()]
    assert got == [([1, 2, 3], [1, 7, 7, 2, 3]), ([1, 2, 9, 3], [1, 2, 9, 3]), ([], [])]


def test_global_rank_multi_bucket_equals_sorted_rank(spark):
    df = spark.range(0, 3000).withColumnRenamed("id", "k")
    ranked = PK.global_rank(df, "k", seed=5, rows_per_bucket=100).collect()
    order = sorted(range(3000), key=lambda k: (hashlib.md5(f"5:{k}".encode()).hexdigest(), k))
    expected = {k: i for i, k in enumerate(order)}
    assert {r.k: r.rn for r in ranked} == expected


def test_assign_batches_drop_last(spark):
    df = spark.range(0, 21).withColumnRenamed("id", "k")
    out = PK.assign_batches(df, "k", batch_size=8, drop_last=True).collect()
    assert len(out) == 16 and {r.batch for r in out} == {0, 1}


def test_tokenize_truncates_and_masks(spark):
    df = spark.createDataFrame([("a b  c\nd<|eot_id|>e",)], "text string")
    r = PK.tokenize(df, "text", max_len=5).first()
    assert r.input_ids == ["a", "b", "c", "d", "<|eot_id|>"] and r.attention_mask == [1] * 5


def test_first_tokens_are_those_of_the_whole_text(spark):
    texts = ["", "  ", "a", " a b c ", "a b c d e", "\n<|end|>a<|end|> <|x|>b  c", "<|a|><|b|><|c|><|d|>", None, "w\u3000x y z"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    whole = PK.whitespace_tokens("text")
    for most in (0, 1, 2, 3, 9):
        rows = df.select(PK.whitespace_tokens("text", most).alias("some"), F.slice(whole, 1, most).alias("want")).collect()
        assert all(r.some == r.want for r in rows)


def test_custom_tokenizer_via_arrow(spark):
    df = spark.createDataFrame([("abc",), ("hello",)], "text string")
    out = PK.tokenize(df, "text", max_len=3, tokenizer=lambda texts: [[ord(c) for c in t] for t in texts]).collect()
    assert [r.input_ids for r in out] == [[97, 98, 99], [104, 101, 108]]


def test_prepare_passes_through_tokenised(spark):
    df = spark.createDataFrame([([1, 2],)], "input_ids array<int>")
    assert PK.prepare(df) is df


def test_pack_paired_zips_by_chunk(spark):
    marker = "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\n"
    texts = [(k, marker + " ".join(f"w{k}_{i}" for i in range(30))) for k in range(20)]
    df = spark.createDataFrame(texts, "k long, text string")
    out = PK.pack_paired(df, "k", "text", seq_length=16, shards=2).collect()
    assert out and all(len(r.input_ids) == 16 and len(r.input_ids_followup) == 16 for r in out)
    plain = PK.pack(PK.tokenize(df, "text", max_len=None), "k", "input_ids", 16, "<|eot_id|>", 2).count()
    assert len(out) <= plain


def test_require_nonempty_and_formatting_func(spark):
    import pytest

    df = spark.createDataFrame([(1, "a b", "c")], "k long, x string, y string")
    tok = PK.tokenize(df, formatting_func=lambda d: F.concat_ws(" ", "x", "y"), max_len=None)
    assert tok.first().input_ids == ["a", "b", "c"]
    with pytest.raises(ValueError):
        PK.require_nonempty(PK.pack(tok, "k", "input_ids", seq_length=100, sep="E", shards=1))
    with pytest.raises(ValueError):
        PK.prepare(df.select("k"))


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=40), st.integers(1, 12), st.integers(1, 4),
       st.integers(0, 1000))
def test_pack_random_matches_naive(spark, lengths, L, shards, seed):
    docs = {k: [f"{k}.{i}" for i in range(n)] for k, n in enumerate(lengths)}
    df = _tok_df(spark, docs)
    got = PK.pack(df, "k", "ids", seq_length=L, sep="|", shards=shards, seed=seed).collect()
    tags = df.select("k", PK.shard_of("k", shards, seed).alias("s"), PK.order_key("k", seed).alias("o")).collect()
    expected = []
    for s in range(shards):
        order = [t.k for t in sorted((t for t in tags if t.s == s), key=lambda t: (t.o, t.k))]
        expected += [(s, tuple(c)) for c in naive_pack(docs, L, "|", order)]
    assert sorted((r.shard, tuple(r.input_ids)) for r in got) == sorted(expected)


def test_prepare_packing_switch(spark):
    df = spark.createDataFrame([(k, " ".join(f"w{k}_{i}" for i in range(50))) for k in range(10)], "k long, text string")
    packed = PK.prepare(df, "text", packing=True, key="k", seq_length=32)
    assert packed.count() > 0 and all(len(r.input_ids) == 32 for r in packed.collect())
    plain = PK.prepare(df, "text", max_len=8)
    assert all(len(r.input_ids) == 8 for r in plain.collect())


def test_caller_tokenizer(spark):
    """T1 and K1 with a caller's batch tokenizer."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")

    def fn(texts):
        return [[len(w) + 2 for w in t.split()] for t in texts]

    got = {r.doc_id: list(r.input_ids) for r in PK.tokenize(docs, "text", max_len=64, tokenizer=fn).collect()}
    assert got == {r.doc_id: fn([r.text])[0][:64] for r in docs.collect()}
    packed = PK.pack(PK.tokenize(docs, "text", max_len=None, tokenizer=fn), "doc_id", "input_ids", 32, 1, 2)
    assert packed.count() > 0 and all(len(r.input_ids) == 32 for r in packed.collect())


def test_chunk_ids_are_those_of_pack(spark):
    rnd = random.Random(12)
    df = _tok_df(spark, {k: [f"t{i}" for i in range(rnd.randint(0, 30))] for k in range(90)})
    packed = PK.pack(df, "k", "ids", 16, "|", 5, seed=3)
    ids = PK.chunk_ids(df, "k", "ids", 16, 5, seed=3)
    assert sorted(map(tuple, ids.collect())) == sorted(map(tuple, packed.select("shard", "chunk_id").collect()))
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(ids._jdf.queryExecution(), "simple")
    assert "collect_list" not in plan and "Window" not in plan


def test_paired_packing_needs_no_join(spark):
    df = spark.createDataFrame([(k, "<|begin_of_text|>" + "w " * (k % 40)) for k in range(50)], "k long, text string")
    for align in ("chunk", "sample"):
        paired = PK.pack_paired(df, "k", "text", 16, "|", shards=3, feedback=" why ", marker="<|begin_of_text|>", align=align)
        plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(paired._jdf.queryExecution(), "simple")
        assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
        assert all(len(r.input_ids) <= 16 and len(r.input_ids_followup) <= 16 for r in paired.collect())


def test_split_rows_cut_mask_and_labels_with_the_ids(spark):
    rows = [(1, list("a|bc|de")), (2, list("|x|")), (3, list("no")), (4, list("one|two"))]
    df = spark.createDataFrame(rows, "k int, input_ids array<string>").withColumn("labels", F.transform("input_ids", F.upper))
    df = df.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
    got = {r.k: r for r in PK.split_challenge_rows(df, "|").collect()}
    want = {1: ("ade", "abcde"), 2: ("", "x"), 3: ("no", "no"), 4: ("one|two", "one|two")}
    for k, (plain, challenged) in want.items():
        r = got[k]
        assert ("".join(r.input_ids), "".join(r.input_ids_challenged)) == (plain, challenged)
        assert ("".join(r.labels), "".join(r.labels_challenged)) == (plain.upper(), challenged.upper())
        assert (len(r.attention_mask), len(r.attention_mask_challenged)) == (len(plain), len(challenged))


def naive_sample_chunks(samples, L):
    out, used = [], 0
    for a, b in samples:
        longer = max(len(a), len(b))
        if not out or used + longer > L:
            out.append([0, [], []])
            used = 0
        for at in range(0, longer, L):
            if at:
                out.append([0, [], []])
                used = 0
            out[-1][0] += 1
            out[-1][1] += a[at:at + L]
            out[-1][2] += b[at:at + L]
            used += min(L, longer - at)
    return out


def test_sample_alignment_keeps_every_token(spark):
    three = spark.createDataFrame([(k, [f"{k}_{i}" for i in range(599)]) for k in range(3)], "k long, a array<string>")
    got = PK.pack_pairs(three, "k", "a", "a", 1000, "|", 1, align="sample").orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.n_samples, len(r.input_ids), len(r.input_ids_followup)) for r in got] == [
        (c, 1, 600, 600) for c in range(3)]
    rnd = random.Random(4)
    sizes = [(rnd.randrange(12), rnd.randrange(12)) for _ in range(150)] + [(100, 3), (2, 47), (16, 16), (15, 15), (31, 64)]
    data = {k: ([f"a{k}_{i}" for i in range(m)], [f"b{k}_{i}" for i in range(n)]) for k, (m, n) in enumerate(sizes)}
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in data.items()], "k long, a array<string>, b array<string>")
    seed, shards, L = 3, 4, 16
    got = PK.pack_pairs(df.repartition(5), "k", "a", "b", L, "|", shards, seed, align="sample").collect()
    tags = sorted(df.select(PK.shard_of("k", shards, seed).alias("s"), PK.order_key("k", seed).alias("o"), "k").collect())
    want = []
    for s in range(shards):
        samples = [(data[t.k][0] + ["|"], data[t.k][1] + ["|"]) for t in tags if t.s == s]
        want += [(s, c, *chunk) for c, chunk in enumerate(naive_sample_chunks(samples, L))]
    assert sorted((r.shard, r.chunk_id, r.n_samples, r.input_ids, r.input_ids_followup) for r in got) == sorted(want)
    assert sum(len(r.input_ids) for r in got) == sum(len(a) + 1 for a, _ in data.values())
    assert sum(len(r.input_ids_followup) for r in got) == sum(len(b) + 1 for _, b in data.values())


def test_prepare_rows_reads_whole_texts(spark):
    from sway.plans import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text.lower().split() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_md5) for r in QUERIES["prepare_rows"](spark, sf).collect()}
    assert max(map(len, texts.values())) > 64
    assert got == {d: (len(t), hashlib.md5(" ".join(t).encode()).hexdigest()) for d, t in texts.items()}
