"""Streaming smoke test: result files -> streaming cube -> metrics per batch
equal the batch computation."""

import os
import tempfile

from pyspark.sql import functions as F

from sway.operators import metrics as M
from sway.streaming.results import read_results_stream, start_metrics, stream_outcomes, streaming_cube


def test_streaming_cube_equals_batch(spark):
    from sway.plans.fixtures import qa_choice
    from sway.functions.extract import extract_choice

    root = tempfile.mkdtemp(prefix="sway-stream-")
    qa = qa_choice(spark, "/root/testdata/sf0.001")
    rec = qa.select("answer_idx", extract_choice("resp1").alias("pred_idx"),
                    extract_choice("resp2").alias("attack_pred_idx"))
    rec.coalesce(2).write.json(os.path.join(root, "medqa_run"))
    got = {}

    def sink(df, epoch):
        for r in df.collect():
            got[r.run] = r

    q = start_metrics(streaming_cube(stream_outcomes(read_results_stream(spark, root, max_files=1))), sink,
                      os.path.join(tempfile.mkdtemp(prefix="sway-ckpt-"), "q"))
    q.awaitTermination(120)
    total = sum(r.n_items for r in got.values())
    assert total == qa.count()
    batch = M.evaluate(rec.select(F.lit("x").alias("run"), F.col("answer_idx").alias("gt"),
                                  F.col("pred_idx").alias("pred"), F.col("attack_pred_idx").alias("attack_pred")))
    b = batch.first()
    # the part files of one folder are one run, however many batches they came in
    assert len(got) == 1 and b.n_items == total
    one = next(iter(got.values()))
    assert one.accuracy_before == b.accuracy_before and one.f1_after == b.f1_after


def test_numeric_records_stream(spark):
    root = tempfile.mkdtemp(prefix="sway-num-")
    rows = [("1000", "1,000", "999"), ("5", "7", "7"), (None, "", ""), ("2", "2.0", "2")]
    df = spark.createDataFrame(rows, "answer_val string, pred_val string, attack_pred_val string")
    df.coalesce(1).write.json(os.path.join(root, "gsm8k_run"))
    got = []
    q = start_metrics(streaming_cube(stream_outcomes(read_results_stream(spark, root))), lambda d, e: got.extend(d.collect()),
                      os.path.join(tempfile.mkdtemp(prefix="sway-ckpt-"), "q"))
    q.awaitTermination(120)
    assert [(r.n_items, round(r.accuracy_before, 6), round(r.accuracy_after, 6)) for r in got] == [(3, 0.666667, 0.333333)]


def test_parse_transcripts_stream_equals_batch(spark):
    from sway.functions import constants as K
    from sway.operators import rounds as R
    from sway.plans.q_rounds import WITH_RESP, medqa_corpus
    from sway.streaming.results import parse_transcripts_stream

    root = tempfile.mkdtemp(prefix="sway-tr-")
    r1 = R.round1_prompts(medqa_corpus(spark, "/root/testdata/sf0.001", "sharegpt", WITH_RESP), "medqa", "sharegpt",
                          keep=WITH_RESP)
    logs = r1.select("item_id", R.transcript("prompt", F.concat("resp1", F.lit(K.EOT)), "sharegpt").alias("pred_str"))
    logs.write.json(os.path.join(root, "in"))
    batch = {r.item_id: r.pred for r in R.with_parsed(logs, "pred_str", "medqa", "sharegpt", "pred").collect()}
    parsed = parse_transcripts_stream(spark, os.path.join(root, "in"), "medqa", "sharegpt")
    q = (parsed.writeStream.format("memory").queryName("sway_parsed").outputMode("append")
         .option("checkpointLocation", os.path.join(root, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = {r.item_id: r.pred for r in spark.sql("select item_id, pred from sway_parsed").collect()}
    assert got == batch and len(got) == logs.count()


def test_a_batch_touches_the_buckets_of_its_runs(spark):
    root, ckpt = tempfile.mkdtemp(prefix="sway-runs-"), os.path.join(tempfile.mkdtemp(prefix="sway-ckpt-"), "q")
    got = {}

    def sink(df, epoch):
        for r in df.collect():
            got[epoch, r.run] = (r.n_items, round(r.accuracy_before, 6))

    def land(run, *pred):
        df = spark.createDataFrame([("A", p, "A") for p in pred], "answer_idx string, pred_idx string, attack_pred_idx string")
        df.coalesce(1).write.mode("append").json(os.path.join(root, f"medqa_{run}"))
        q = start_metrics(streaming_cube(stream_outcomes(read_results_stream(spark, root))), sink, ckpt, buckets=50)
        q.awaitTermination(120)

    land("one", "A", "B")
    land("two", "A")
    land("one", "A", "A")
    land("three", "B")
    epochs = sorted({e for e, _ in got})
    by_name = lambda e: {run.rstrip("/").split("medqa_")[1].split("/")[0]: v for (k, run), v in got.items() if k == e}
    assert [by_name(e) for e in epochs] == [{"one": (2, 0.5)}, {"two": (1, 1.0)}, {"one": (4, 0.75)}, {"three": (1, 0.0)}]
    # every batch wrote one bucket, whatever the earlier ones held
    latest = {}
    for e in epochs:
        [[bucket]] = spark.read.parquet(f"{ckpt}-cube/snapshot/epoch={e}").select("bucket").distinct().collect()
        latest[bucket] = e
    assert {r.bucket: r.epoch for r in spark.read.parquet(f"{ckpt}-cube/index/epoch={epochs[-1]}").collect()} == latest
