"""The three stage jobs end to end in a private folder."""

import os
import tempfile

from pyspark.sql import functions as F

from sway import jobs
from sway.operators import metrics as M
from sway.operators import rounds as R
from sway.operators.formatting import reformat
from sway.plans.fixtures import raw_choice_map
from sway.functions.text import format_sent
from sway.sources import io

SF = "/root/testdata/sf0.001"


def test_format_infer_analyze(spark):
    root = tempfile.mkdtemp(prefix="sway-jobs-")
    raw = raw_choice_map(spark, SF)
    raw.select("question", "answer", "options", "answer_idx").write.json(os.path.join(root, "raw", "test.jsonl"))

    # format: rejects are set aside, not fatal
    path = jobs.format_job(spark, "medqa", os.path.join(root, "raw", "test.jsonl"), "test", "alpaca",
                           os.path.join(root, "corpus"))
    corpus = io.read_corpus(spark, os.path.join(root, "corpus"), "test", "alpaca")
    expected, rejects = reformat(raw, "medqa", "alpaca", keep=())
    assert sorted(map(tuple, corpus.collect())) == sorted(map(tuple, expected.collect()))
    assert path.endswith("test_alpaca_sft.jsonl")

    # infer with recorded responses keyed by content
    keyed = R.with_item_key(corpus, ["instruction", "input", "output"])
    resp = keyed.join(raw.select(format_sent("question", "?").alias("instruction"), "resp1", "resp2"), "instruction")
    resp.selectExpr("item_id", "stack(2, 1, resp1, 2, resp2) as (round, response)").write.json(
        os.path.join(root, "responses"))
    out = jobs.infer_job(spark, "medqa", os.path.join(root, "corpus"), "test", "alpaca",
                         os.path.join(root, "outputs", "medqa", "random", "alpaca", "m", "ckpt"),
                         responses_path=os.path.join(root, "responses"), identity="random")
    records = spark.read.json(out)
    assert records.count() == corpus.count()

    # analyze: one row per run, numbers agree with a direct evaluation
    paths = jobs.analyze_job(spark, os.path.join(root, "outputs"), os.path.join(root, "reports"))
    board = spark.read.parquet(paths["metrics"]).collect()
    assert len(board) == 1 and board[0].dataset == "medqa" and board[0].n_items == corpus.count()
    direct = M.evaluate(records.select(F.lit("x").alias("run"), F.col("answer_idx").alias("gt"),
                                       F.col("pred_idx").alias("pred"),
                                       F.col("attack_pred_idx").alias("attack_pred"))).first()
    assert board[0].accuracy_after == direct.accuracy_after
    assert board[0].dims.dataset == "medqa"
    lines = [r.value for r in spark.read.text(paths["report"]).collect()]
    assert lines[0] == "Before questioning:" and lines[1] == "" and lines[2].startswith("accuracy: ")
    assert lines[6].startswith("confusion_matrix: ") and " -> " in lines[6] and "Latex table:" in lines
    assert lines[-3].startswith("latex:  ") and lines[-2:] == ["", ""]
    cells = spark.read.parquet(paths["confusion"])
    assert sum(" -> " in x for x in lines) == cells.count()
    assert spark.read.json(os.path.join(root, "outputs", "medqa", "random", "alpaca", "m", "ckpt", "test_unmatched")).count() == 0


def test_unscorable_records_are_rejected(spark):
    """Span records, records without gold and numeric records without gold are
    counted, not scored as perfect."""
    root = tempfile.mkdtemp(prefix="sway-rej-")
    spark.createDataFrame([("x", "y")] * 10, "pred_ans string, answer string").write.json(f"{root}/outputs/squad_v2/a")
    spark.createDataFrame([("", "")] * 4, "pred_val string, attack_pred_val string").write.json(f"{root}/outputs/gsm8k/b")
    spark.createDataFrame([("A", "B", "A"), ("A", "", "A")], "answer_idx string, pred_idx string, attack_pred_idx string").write.json(
        f"{root}/outputs/medqa/c")
    paths = jobs.analyze_job(spark, f"{root}/outputs", f"{root}/reports")
    board = spark.read.parquet(paths["metrics"]).collect()
    assert [(r.dataset, r.n_items, r.accuracy_before) for r in board] == [("medqa", 2, 0.0)]
    rejects = {(r.dataset, r.reason): r.n for r in spark.read.json(paths["rejects"]).collect()}
    assert rejects == {("unknown", "unknown dataset"): 10, ("gsm8k", "missing gold"): 4, ("medqa", "unparsed answer"): 1}


def test_repeated_items_and_responses(spark):
    import pytest

    corpus = spark.createDataFrame([("q", "A: x, B: y.", "A: x.")] * 2 + [("r", "A: x, B: y.", "B: y.")],
                                   "instruction string, input string, output string")
    keyed = R.with_item_key(corpus, corpus.columns)
    ids = [r.item_id for r in keyed.collect()]
    assert len(set(ids)) == 3 and sum(":" in i for i in ids) == 1
    responses = keyed.select("item_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("round"), F.lit("A: x").alias("response"))
    rec = R.two_round(keyed, "medqa", "alpaca", responses=responses, keys=("item_id",))
    assert rec.count() == 3
    twice = responses.unionByName(responses.filter("round = 1").limit(1))
    assert R.duplicate_responses(twice, ("item_id",)).count() == 1
    missing = responses.filter(F.col("item_id") != ids[0])
    assert {r["round"]: r.n for r in R.unmatched_prompts(keyed, missing, ("item_id",)).collect()} == {1: 1, 2: 1}
    root = tempfile.mkdtemp(prefix="sway-dup-")
    io.write_corpus(corpus, root, "test", "alpaca")
    twice.write.json(f"{root}/responses")
    with pytest.raises(ValueError):
        jobs.infer_job(spark, "medqa", root, "test", "alpaca", f"{root}/out", responses_path=f"{root}/responses")


def test_train_data_job(spark):
    root = tempfile.mkdtemp(prefix="sway-train-")
    raw = raw_choice_map(spark, SF)
    raw.select("question", "answer", "options", "answer_idx").write.json(os.path.join(root, "raw", "train.jsonl"))
    jobs.format_job(spark, "medqa", os.path.join(root, "raw", "train.jsonl"), "train", "sharegpt",
                    os.path.join(root, "corpus"))
    n = io.read_corpus(spark, os.path.join(root, "corpus"), "train", "sharegpt").count()
    plain = jobs.train_data_job(spark, os.path.join(root, "corpus"), "train", "sharegpt", os.path.join(root, "a"),
                                challenged=True, max_seq_length=64)
    rows = spark.read.parquet(plain["path"])
    assert rows.count() == n and plain["total_steps"] == 10 * -(-n // 8)
    first = rows.orderBy("rn").first()
    assert first.input_ids[0] == "<|begin_of_text|>" and len(first.input_ids) <= 64 and first.batch == 0
    assert len(first.labels) == len(first.attention_mask) == len(first.input_ids)
    assert len(first.input_ids_challenged) == len(first.labels_challenged) == len(first.attention_mask_challenged)
    packed = jobs.train_data_job(spark, os.path.join(root, "corpus"), "train", "sharegpt", os.path.join(root, "b"),
                                 challenged=True, packing=True)
    chunks = spark.read.parquet(packed["path"]).collect()
    assert chunks and all(len(c.input_ids) == 1024 == len(c.input_ids_followup) for c in chunks)
    assert packed["unmarked"] == 0
