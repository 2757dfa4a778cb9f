"""Rendering: exact template bytes, chat layout, challenge insertion,
identity choice and round trips through the parser."""

from pyspark.sql import functions as F

from sway.functions import constants as K
from sway.functions.prompts import (
    add_feedback,
    challenge_prefix,
    render_alpaca,
    render_chat,
    render_user_prompt,
    wrap_first_turn,
)
from sway.operators import rounds as R


def test_alpaca_templates_exact(spark):
    df = spark.createDataFrame([("I {x}", "In", "Out")], "i string, n string, o string")
    r = df.select(render_alpaca("i", "n", "o", "<E>", "train").alias("t"),
                  render_alpaca("i", "n", "o", None, "infer").alias("u")).first()
    assert r.t == K.ALPACA_TRAIN.format(instruction="I {x}", input="In", response="Out") + "<E>"
    assert r.t.startswith("\n           ### Instruction:\n           I {x}\n\n")
    assert r.u == "\n            ### Instruction:\n            I {x}\n\n            ### Input:\n            In\n\n" \
                  "            ### Response:\n            Out"


def test_chat_layout_and_generation_prompt(spark):
    df = spark.sql("select array(named_struct('from', 'human', 'value', ' Hi? '), "
                   "named_struct('from', 'gpt', 'value', 'Yes.\\n')) as c")
    r = df.select(render_chat("c").alias("a"), render_chat("c", True).alias("b")).first()
    assert r.a == ("<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\nHi?<|eot_id|>"
                   "<|start_header_id|>assistant<|end_header_id|>\n\nYes.<|eot_id|>")
    assert r.b == r.a + "<|start_header_id|>assistant<|end_header_id|>\n\n"
    w = df.select(render_chat(wrap_first_turn("c", "<E>")).alias("w")).first().w
    assert w.startswith(K.USER_MARKER + "<E>" + K.TRAIN_FEEDBACK + "<E> Hi?<|eot_id|>")  # inner space kept


def test_add_feedback_every_occurrence(spark):
    m = K.USER_MARKER
    df = spark.createDataFrame([(m + "a" + m + "b",), ("no marker",)], "t string")
    out = [r.o for r in df.select(add_feedback("t", "FB ").alias("o")).collect()]
    assert out == [m + "FB a" + m + "FB b", "no marker"]


def test_identity_choice_is_seeded_and_from_pool(spark):
    df = spark.range(200).withColumnRenamed("id", "item_id")
    a = [r.p for r in df.select(challenge_prefix("random", "medqa", "item_id", 1).alias("p")).collect()]
    b = [r.p for r in df.select(challenge_prefix("random", "medqa", "item_id", 1).alias("p")).collect()]
    assert a == b
    assert {p.split(",")[0] for p in a} == {"I am a anesthesiologist", "I am a dermatologist"}
    fixed = df.select(challenge_prefix(["general", "practitioner"]).alias("p")).first().p
    assert fixed.startswith("I am a general practitioner, and I think")
    assert df.select(challenge_prefix(None).alias("p")).first().p == K.CHALLENGE


def test_parse_of_rendered_round_trip(spark):
    """parse(render(x)) = x: a response appended to a rendered prompt parses back."""
    df = spark.createDataFrame([("Q? A: x, B: y.", "The correct answer is B: y.")], "q string, resp string")
    tr = R.transcript(render_user_prompt(F.col("q")), F.concat("resp", F.lit(K.EOT)), "sharegpt")
    assert df.select(R.parse_answer(tr, "medqa", "sharegpt").alias("p")).first().p == "B"
    alp = R.transcript(render_alpaca("q", F.lit("A: x"), F.lit(""), K.DEFAULT_EOS, "infer"), F.col("resp"), "alpaca")
    assert df.select(R.parse_answer(alp, "medqa", "alpaca").alias("p")).first().p == "B"


def test_two_round_with_generator(spark):
    corpus = spark.createDataFrame(
        [(1, "run", "Which?", "A: red, B: blue.", "B: Blue."), (2, "run", "Other?", "A: x, B: y.", "A: X.")],
        "item_id long, run string, instruction string, input string, output string")

    def gen(prompts):
        return ["The correct answer is A" if "previous response" not in p else "The correct answer is B"
                for p in prompts]

    rec = R.two_round(corpus, "medqa", "alpaca", generator=gen).orderBy("item_id").collect()
    assert [(r.pred_idx, r.attack_pred_idx, r.answer_idx) for r in rec] == [("A", "B", "B"), ("A", "B", "A")]
    assert "Your previous response:\n            A: red\n\n" + K.TASK_SUFFIX["medqa"] in rec[0].attack_pred_str
