"""Sources and sinks: round trips through files in a private folder."""

import json
import os
import tempfile

from sway.operators import metrics as M
from sway.operators.formatting import choice_map_to_alpaca, reformat
from sway.sources import io


def test_choice_map_keeps_json_key_order(spark):
    d = tempfile.mkdtemp(prefix="sway-src-")
    with open(os.path.join(d, "test.jsonl"), "w") as f:
        f.write(json.dumps({"question": "which one", "answer": "zeta", "options": {"C": "zeta", "A": "alpha"},
                            "answer_idx": "C"}) + "\n")
    df = io.read_choice_map(spark, os.path.join(d, "test.jsonl"))
    r = choice_map_to_alpaca(df).first()
    assert (r.instruction, r.input, r.output) == ("Which one?", "C: zeta, A: alpha.", "C: zeta.")


def test_corpus_round_trip(spark):
    from sway.plans.fixtures import raw_numeric

    d = tempfile.mkdtemp(prefix="sway-corpus-")
    corpus, _ = reformat(raw_numeric(spark, "/root/testdata/sf0.001"), "gsm8k", "sharegpt")
    io.write_corpus(corpus, d, "train", "sharegpt")
    back = io.read_corpus(spark, d, "train", "sharegpt")
    assert sorted(map(str, back.collect())) == sorted(map(str, corpus.select("conversations").collect()))


def test_results_discovery_and_report(spark):
    from sway.plans.fixtures import qa_choice
    from pyspark.sql import functions as F

    root = tempfile.mkdtemp(prefix="sway-results-")
    qa = qa_choice(spark, "/root/testdata/sf0.001")
    rec = qa.select(F.col("answer_idx"), F.lit("A").alias("pred_idx"), F.lit("B").alias("attack_pred_idx"),
                    F.when(F.col("item_id") % 2 == 0, "medqa").otherwise("gsm8k_x").alias("dataset"),
                    F.lit("test").alias("split"))
    io.write_predictions(rec, os.path.join(root, "outputs"))
    res = io.read_results(spark, os.path.join(root, "outputs"))
    assert res.count() == qa.count()
    assert {tuple(r) for r in res.select("dataset", "split").distinct().collect()} == {("medqa", "test"), ("gsm8k_x", "test")}
    assert res.filter("dataset = 'medqa'").count() == rec.filter("dataset = 'medqa'").count()
    board = M.leaderboard(res.select(F.col("path").alias("run"), F.col("answer_idx").alias("gt"),
                                     F.col("pred_idx").alias("pred"), F.col("attack_pred_idx").alias("attack_pred")))
    rep = M.report_long(board)
    out = os.path.join(root, "report")
    io.write_report(rep, out)
    lines = [r.line for r in io.render_report(rep).orderBy("run", "ordinal").collect()]
    assert lines[0].startswith("Before questioning:\n\naccuracy: ")
    assert any(line.startswith("Latex table:\n\nlatex: ") for line in lines)


def test_turns_to_sharegpt_orders_and_maps_roles(spark):
    turns = spark.createDataFrame([(1, 2, "user", "c"), (1, 0, "system", "a"), (1, 1, "assistant", "b")],
                                  "conv_id long, turn long, role string, text string")
    conv = io.turns_to_sharegpt(turns).first().conversations
    assert [(m["from"], m["value"]) for m in conv] == [("system", "a"), ("gpt", "b"), ("human", "c")]


def test_reformat_dispatch_errors_and_strict(spark):
    import pytest

    from sway.operators.formatting import IntegrityError
    from sway.plans.fixtures import raw_choice_map

    raw = raw_choice_map(spark, "/root/testdata/sf0.001")
    with pytest.raises(ValueError):
        reformat(raw, "unknown", "alpaca")
    with pytest.raises(NotImplementedError):
        reformat(raw, "medqa", "xml")
    with pytest.raises(IntegrityError):
        reformat(raw, "medqa", "alpaca", strict=True)
    corpus, rejects = reformat(raw, "medqa", "alpaca")
    assert corpus.count() + rejects.count() == raw.count()


def test_chat_pieces_concatenate_to_rendered_chat(spark):
    from pyspark.sql import functions as F

    from sway.functions.prompts import render_chat
    from sway.operators import packing as PK

    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    whole = {r.conv_id: r.t for r in io.turns_to_sharegpt(turns).select(
        "conv_id", render_chat("conversations").alias("t")).collect()}
    pieces = io.chat_pieces(turns).collect()
    joined = {}
    for r in sorted(pieces, key=lambda r: (r.conv_id, r.turn)):
        joined[r.conv_id] = joined.get(r.conv_id, "") + r.piece
    assert joined == whole
    # token boundaries: tokens of the pieces, concatenated, equal the tokens of the whole text
    tp = PK.tokenize(io.chat_pieces(turns).withColumnRenamed("piece", "text"), "text", max_len=None).collect()
    toks = {}
    for r in sorted(tp, key=lambda r: (r.conv_id, r.turn)):
        toks.setdefault(r.conv_id, []).extend(r.input_ids)
    wt = PK.tokenize(spark.createDataFrame(list(whole.items()), "conv_id long, text string"), "text",
                     max_len=None).collect()
    assert {r.conv_id: list(r.input_ids) for r in wt} == toks


def test_choice_lists_and_numeric_sources(spark):
    from sway.plans.fixtures import raw_choice_lists, raw_numeric

    d = tempfile.mkdtemp(prefix="sway-lists-")
    lists = raw_choice_lists(spark, "/root/testdata/sf0.001").select("fact1", "question_stem", "choices", "answerKey")
    numbers = raw_numeric(spark, "/root/testdata/sf0.001").select("question", "answer")
    for fmt in ("parquet", "json"):
        lists.write.format(fmt).save(f"{d}/lists-{fmt}")
        numbers.write.format(fmt).save(f"{d}/numbers-{fmt}")
        for back, src in ((io.read_choice_lists(spark, f"{d}/lists-{fmt}", fmt), lists),
                          (io.read_numeric_qa(spark, f"{d}/numbers-{fmt}", fmt), numbers)):
            assert back.columns == src.columns
            assert sorted(map(str, back.collect())) == sorted(map(str, src.collect()))


def test_result_values_survive_the_partition_path(spark):
    d = tempfile.mkdtemp(prefix="sway-parts-")
    rec = spark.createDataFrame([("A", "A", "B", "med qa/x", "train=1"), ("B", "A", "B", "gsm8k", "dev")],
                                "answer_idx string, pred_idx string, attack_pred_idx string, dataset string, split string")
    io.write_predictions(rec, d)
    back = io.read_results(spark, d).select(*rec.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rec.collect()))


def test_small_rates_print_as_plain_decimals(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0.0001,), (1e-7,), (1.0,), (0.0,), (1 / 3,), (0.25,)], "v double")
    got = [r[0] for r in df.select(io.plain_decimal("v")).collect()]
    assert got == ["0.0001", "0.0000001", "1.0", "0.0", "0.3333333333333333", "0.25"]
    board = M.leaderboard(spark.createDataFrame([("r", "A", "A", "B")] + [("r", "A", "A", "A")] * 9999,
                                                "run string, gt string, pred string, attack_pred string"))
    lines = [r.line for r in io.render_report(M.report_long(board)).collect()]
    assert any(x.endswith("incorrect_flipping_rate: 0.0001") for x in lines)
    assert F is not None


def test_report_text_layout(spark):
    res = spark.createDataFrame([("r", "A", "A", "B"), ("r", "B", "A", "A")], "run string, gt string, pred string, attack_pred string")
    cells = M.confusion_long(M.phase_cube(M.outcome_cube(res)))
    d = tempfile.mkdtemp(prefix="sway-report-")
    io.write_report(M.report_long(M.leaderboard(res), confusion=cells), d)
    text = "".join(r.value + "\n" for r in spark.read.text(d, wholetext=False).select("value").collect())
    assert text.startswith("Before questioning:\n\naccuracy: 0.5\n")
    assert "confusion_matrix: A -> A = 1\nconfusion_matrix: B -> A = 1\n" not in text  # B is never predicted before
    assert "confusion_matrix: A -> A = 1\n\n\nAfter questioning:\n\naccuracy: 0.0\n" in text
    assert "confusion_matrix: A -> B = 1\nconfusion_matrix: B -> A = 1\n\n\nFlipping:\n\n" in text
    assert text.endswith("\n\n\n")
