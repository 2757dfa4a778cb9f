"""Broken records, sinks that replace only what they write, and generation that goes on."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sway import jobs
from sway.operators import rounds as R
from sway.operators.formatting import IntegrityError, check_choice_lists, check_choice_map, check_numeric
from sway.plans.fixtures import raw_choice_map
from sway.sources import io
from sway.sources import schemas as SC

SF = "/root/testdata/sf0.001"
GOOD = {"question": "q", "answer": "x", "options": {"B": "y", "A": "x"}, "answer_idx": "A"}


def lines(tmp_path, *rows, name="in.jsonl"):
    path = tmp_path / name
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(path)


def test_broken_lines_are_set_aside(spark, tmp_path):
    bad = ['{"question": "cut', "not json", "null", "[1, 2]", '"text"', '{"options": 3}']
    path = lines(tmp_path, GOOD, "", *bad, "   ", {**GOOD, "extra": [1]}, {"question": "only"})
    sound, broken = io.read_choice_map(spark, path, with_broken=True)
    got = sound.select("question", F.map_keys("options").alias("keys")).collect()
    assert [r.question for r in got] == ["q", "q", "only"] and got[0]["keys"] == ["B", "A"]
    broken = broken.collect()
    assert [r.record for r in broken] == bad
    assert all(r.path.endswith("in.jsonl") and r.reason for r in broken)
    with pytest.raises(Exception):  # noqa: B017 - without the second table the job fails
        io.read_choice_map(spark, path).collect()
    assert io.read_choice_map(spark, lines(tmp_path, GOOD, name="ok.jsonl")).count() == 1


def test_all_json_readers_set_broken_lines_aside(spark, tmp_path):
    path = lines(tmp_path, {"question": "q", "answer": "#### 1"}, "{")
    for read in (io.read_choice_lists, io.read_numeric_qa):
        sound, broken = read(spark, path, "json", with_broken=True)
        assert (sound.count(), broken.count()) == (1, 1)
    os.makedirs(tmp_path / "c")
    lines(tmp_path / "c", {"instruction": "i", "input": "", "output": "o"}, "oops", name="train_alpaca_sft.jsonl")
    sound, broken = io.read_corpus(spark, str(tmp_path / "c"), "train", "alpaca", with_broken=True)
    assert sound.first().output == "o" and broken.first().record == "oops"
    root = tmp_path / "r" / "dataset=medqa" / "split=test"
    os.makedirs(root)
    lines(root, {"question": "q", "pred_idx": "A"}, "{]", name="part-0.json")
    sound, broken = io.read_results(spark, str(tmp_path / "r"), with_broken=True)
    r = sound.first()
    assert (r.dataset, r.split, r.pred_idx) == ("medqa", "test", "A") and r.path.endswith("part-0.json")
    assert sound.columns == io.read_results(spark, str(tmp_path / "r")).columns
    assert broken.first().record == "{]" and broken.first().path == r.path


def test_parquet_has_no_broken_lines(spark, tmp_path):
    spark.createDataFrame([("q", "#### 1")], SC.NUMERIC_QA).write.parquet(str(tmp_path / "n"))
    sound, broken = io.read_numeric_qa(spark, str(tmp_path / "n"), with_broken=True)
    assert sound.count() == 1 and broken.count() == 0 and broken.columns == ["path", "reason", "record"]


def test_records_without_a_part_are_rejected(spark):
    full = ("q", "x", {"A": "x"}, "A")
    rows = [full, ("q", None, {"A": None}, "A"), (None, "x", {"A": "x"}, "A"), ("q", "x", None, "A"), ("q", "x", {"A": "x"}, None),
            (None, None, None, None)]
    valid, rejects = check_choice_map(spark.createDataFrame(rows, SC.CHOICE_MAP))
    assert (valid.count(), rejects.count()) == (1, 5)
    lists = [("f", "q", (["x"], ["A"]), "A"), ("f", "q", (["x"], ["A"]), None), ("f", "q", None, "A"), (None, "q", (["x"], ["A"]), "A"),
             ("f", None, (["x"], ["A"]), "A"), ("f", "q", (None, ["A"]), "A")]
    valid, rejects = check_choice_lists(spark.createDataFrame(lists, SC.CHOICE_LISTS))
    assert (valid.count(), rejects.count()) == (1, 5)
    valid, rejects = check_numeric(spark.createDataFrame([("q", "1"), (None, "1"), ("q", None)], SC.NUMERIC_QA))
    assert (valid.count(), rejects.count()) == (1, 2)


def test_format_job_counts_broken_lines(spark, tmp_path):
    path = lines(tmp_path, GOOD, {**GOOD, "answer": "z"}, "{broken")
    out = str(tmp_path / "corpora")
    jobs.format_job(spark, "medqa", path, "train", "alpaca", out)
    assert io.read_corpus(spark, out, "train", "alpaca").count() == 1
    assert spark.read.json(f"{out}/train_alpaca_rejects.jsonl").count() == 1
    assert spark.read.json(f"{out}/train_alpaca_broken.jsonl").first().record == "{broken"
    with pytest.raises(IntegrityError):
        jobs.format_job(spark, "medqa", path, "train", "alpaca", out, strict=True)


def test_writers_replace_what_they_write(spark, tmp_path):
    root = str(tmp_path / "p")

    def write(rows, **kw):
        io.write_predictions(spark.createDataFrame(rows, "dataset string, split string, question string"), root, **kw)

    write([("medqa", "test", "old"), ("medqa", "train", "kept")])
    write([("openbookqa", "test", "other")])
    write([("medqa", "test", "new")])
    read = lambda: sorted((r.dataset, r.split, r.question) for r in io.read_results(spark, root).collect())
    assert read() == [("medqa", "test", "new"), ("medqa", "train", "kept"), ("openbookqa", "test", "other")]
    write([("medqa", "test", "more")], mode="append")
    assert len(read()) == 4


def counted(folder, calls=None):
    """A generator that writes down what it was asked, and fails after some calls."""
    folder = str(folder)

    def generate(prompts):
        import uuid

        if calls is not None and len(os.listdir(folder)) >= calls:
            raise RuntimeError("stopped")
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            json.dump(list(prompts), f)
        return [f"answer to {p}" for p in prompts]

    return generate


def asked(folder):
    return sorted(p for name in os.listdir(folder) for p in json.load(open(f"{folder}/{name}")))


def test_generation_goes_on_where_it_was(spark, tmp_path):
    prompts = spark.createDataFrame([("r" if i % 5 else None, i, f"p{i}") for i in range(60)], "run string, item_id long, prompt string")
    store = str(tmp_path / "store")
    folders = [tmp_path / f"asked{k}" for k in range(4)]
    for f in folders:
        f.mkdir()
    with pytest.raises(Exception):  # noqa: B017
        R.resume_generation(prompts, counted(folders[0], calls=20), store, rows_per_batch=7)
    kept = spark.read.parquet(f"{store}/round=1").count()
    assert 0 < kept < 60
    out = R.resume_generation(prompts, counted(folders[1]), store, rows_per_batch=7)
    assert len(asked(folders[1])) == 60 - kept
    assert sorted((r.item_id, r.prompt, r.response) for r in out.collect()) == [(i, f"p{i}", f"answer to p{i}") for i in range(60)]
    # nothing is missing; then one prompt changes; then another round
    R.resume_generation(prompts, counted(folders[2]), store).count()
    assert asked(folders[2]) == []
    changed = prompts.withColumn("prompt", F.when(F.col("item_id") == 3, "new").otherwise(F.col("prompt")))
    out = R.resume_generation(changed, counted(folders[2]), store)
    assert asked(folders[2]) == ["new"] and out.where("item_id = 3").first().response == "answer to new"
    R.resume_generation(prompts.limit(4), counted(folders[3]), store, round_no=2)
    assert len(asked(folders[3])) == 4
    assert R.resume_generation(prompts.limit(0), counted(folders[3]), store).count() == 0


def test_two_rounds_with_a_store_equal_those_without(spark, tmp_path):
    from sway.operators.formatting import reformat

    corpus, _ = reformat(raw_choice_map(spark, SF), "medqa", "alpaca")

    def answer(prompts):
        return [f"The correct answer is {'ABCD'[len(p) % 4]}." for p in prompts]

    plain = R.two_round(corpus, "medqa", "alpaca", generator=answer)
    kept = R.two_round(corpus, "medqa", "alpaca", generator=answer, store=str(tmp_path / "s"))
    assert kept.columns == plain.columns
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(kept) == rows(plain)
    again = R.two_round(corpus, "medqa", "alpaca", generator=lambda p: 1 / 0, store=str(tmp_path / "s"))
    assert rows(again) == rows(plain)


def test_rendered_texts_are_not_joined(spark):
    from sway.operators.formatting import reformat
    from sway.plans.fixtures import qa_number

    qn = qa_number(spark, SF)
    corpus, _ = reformat(qn.select("item_id", "run", "question", "answer"), "gsm8k", "sharegpt")
    recorded = qn.selectExpr("run", "item_id", "stack(2, 1, resp1, 2, resp2) as (round, response)")
    plan = R.two_round(corpus, "gsm8k", "sharegpt", responses=recorded)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and "start_header_id" in plan[:plan.index("Join")]
    assert "start_header_id" not in plan[plan.index("Join"):]


def test_batches_have_few_files_however_many_tasks_write(spark, tmp_path):
    prompts = spark.range(400).selectExpr("'r' as run", "id as item_id", "concat('p', id) as prompt").repartition(40)
    out = R.resume_generation(prompts, lambda texts: [p.upper() for p in texts], str(tmp_path / "s"), rows_per_batch=50)
    assert sorted(r.response for r in out.collect()) == sorted(f"P{i}" for i in range(400))
    files = [f for _, _, names in os.walk(tmp_path / "s") for f in names if f.endswith(".parquet")]
    assert len(files) <= 8 * -(-spark.sparkContext.defaultParallelism // 2) + 1


def test_responses_beside_the_batches_are_known(spark, tmp_path):
    prompts = spark.range(6).selectExpr("'r' as run", "id as item_id", "concat('p', id) as prompt")
    kept = prompts.where("item_id < 2").selectExpr("run", "item_id", "md5(prompt) as prompt_md5", "'kept' as response")
    kept.write.parquet(str(tmp_path / "s" / "round=1"))
    for _ in range(2):
        out = R.resume_generation(prompts, lambda texts: [p.upper() for p in texts], str(tmp_path / "s"), rows_per_batch=2)
        assert sorted(r.response for r in out.collect()) == ["P2", "P3", "P4", "P5", "kept", "kept"]
