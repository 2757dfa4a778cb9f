"""File round trips (SRC1-SRC5, SNK1-SNK3) and resumed generation (R4): what a sink
wrote below the shared folder is read back by its source."""

from __future__ import annotations

from pyspark.sql import functions as F

from sway.functions.text import join_options
from sway.operators import formatting as P
from sway.operators import metrics as M
from sway.operators import rounds as R
from sway.operators.scratch import scratch_path
from sway.plans import sqlgen as S
from sway.plans.fixtures import qa_choice, raw_choice_lists, raw_choice_map, raw_numeric
from sway.plans.q_format import LISTS_CTE, MAP_CTE, NUM_CTE
from sway.plans.q_metrics import _report_sql, choice_results
from sway.plans.q_rounds import CORPUS_CTE, medqa_corpus
from sway.plans.registry import register
from sway.sources import io

#: of the written lines, every BROKEN-th loses its end, and a blank one follows every BLANK-th
BROKEN, BLANK, CUT = 19, 23, 4


def written_lines(df, columns):
    """The records of ``df`` as JSON lines in a folder of their own, some of them broken."""
    path = scratch_path(df.sparkSession, "lines")
    line = F.to_json(F.struct(*columns))
    line = F.when(F.col("item_id") % BROKEN == 0, F.left(line, F.length(line) - CUT)).otherwise(line)
    lines = F.array_append(F.array(line), F.when(F.col("item_id") % BLANK == 0, "  "))
    df.select(F.explode(F.array_compact(lines)).alias("value")).write.text(path)
    return path


def _both(sound, broken, *columns):
    broken = broken.select(F.lit("broken").alias("status"), *[F.lit(None).cast("string").alias(c) for c in columns],
                           F.md5("record").alias("record_md5"))
    return sound.select(F.lit("record").alias("status"), *columns, F.lit(None).cast("string").alias("record_md5")).unionByName(broken)


def _both_sql(cte: str, source: str, columns: dict[str, str], json: str) -> str:
    return f"""with {cte}
select 'record' as status, {', '.join(f'{e} as {c}' for c, e in columns.items())}, null::varchar as record_md5 from {source} where item_id % {BROKEN} <> 0
union all select 'broken', {', '.join(['null'] * len(columns))}, md5(left(j, length(j) - {CUT})) from (
  select {json} as j from {source} where item_id % {BROKEN} = 0) z"""


_MAP_JSON = ("""'{"question":"' || question || '","answer":"' || answer || '","options":{"A":"' || opt_a || '","B":"' || opt_b """
             """|| '","C":"' || opt_c || '","D":"' || opt_d || '"},"answer_idx":"' || answer_idx || '"}'""")
_MAP_ALL = f"{MAP_CTE}, f as (select raw.*, opt_a, opt_b, opt_c, opt_d from raw join qa using (item_id))"


@register("choice_map_files", _both_sql(_MAP_ALL, "f", {"question": "question", "answer": "answer", "answer_idx": "answer_idx",
                                                        "options": "opts"}, _MAP_JSON))
def q_choice_map_files(spark, sf_dir):
    """SRC1, with its broken lines."""
    path = written_lines(raw_choice_map(spark, sf_dir), ["question", "answer", "options", "answer_idx"])
    sound, broken = io.read_choice_map(spark, path, with_broken=True)
    return _both(sound.withColumn("options", join_options("options")), broken, "question", "answer", "answer_idx", "options")


_LISTS_JSON = ("""'{"fact1":"' || fact1 || '","question_stem":"' || question_stem || '","choices":{"text":["' || t_a || '","' || t_b """
               """|| '","' || t_c || '","' || t_d || '"],"label":["A","B","C","D"]},"answerKey":"' || answer_key || '"}'""")


@register("choice_lists_files", _both_sql(LISTS_CTE, "raw", {
    "fact1": "fact1", "question_stem": "question_stem", "labels": "'A,B,C,D'",
    "texts": "t_a || '|' || t_b || '|' || t_c || '|' || t_d", "answerKey": "answer_key"}, _LISTS_JSON))
def q_choice_lists_files(spark, sf_dir):
    """SRC2, with its broken lines."""
    path = written_lines(raw_choice_lists(spark, sf_dir), ["fact1", "question_stem", "choices", "answerKey"])
    sound, broken = io.read_choice_lists(spark, path, "json", with_broken=True)
    sound = sound.withColumns({"labels": F.array_join("choices.label", ","), "texts": F.array_join("choices.text", "|")})
    return _both(sound, broken, "fact1", "question_stem", "labels", "texts", "answerKey")


@register("numeric_files", _both_sql(NUM_CTE, "qn", {"question": "question", "answer": "answer"},
                                     """'{"question":"' || question || '","answer":"' || answer || '"}'"""))
def q_numeric_files(spark, sf_dir):
    """SRC3, with its broken lines."""
    path = written_lines(raw_numeric(spark, sf_dir), ["question", "answer"])
    return _both(*io.read_numeric_qa(spark, path, "json", with_broken=True), "question", "answer")


@register("corpus_files", f"""with {MAP_CTE}
select {S.format_sent('question', '?')} as instruction, {S.format_sent('opts', '.')} as input,
  {S.format_sent("answer_idx || ': ' || answer", '.')} as output from raw where answer = gold and item_id % {BROKEN} <> 0""")
def q_corpus_files(spark, sf_dir):
    """SRC1 -> P8 -> P1 -> SNK1 -> SRC4."""
    path = written_lines(raw_choice_map(spark, sf_dir), ["question", "answer", "options", "answer_idx"])
    corpus, _ = P.reformat(io.read_choice_map(spark, path, with_broken=True)[0], "medqa", "alpaca", keep=())
    root = scratch_path(spark, "corpus")
    io.write_corpus(corpus, root, "train", "alpaca")
    return io.read_corpus(spark, root, "train", "alpaca")


@register("prediction_files", f"""with {MAP_CTE},
w(dataset, split, parity) as (values ('medqa', 'test', 0), ('medqa', 'train 0/2', 0), ('openbookqa', 'test', 1))
select dataset, split, question, answer_idx, resp1 as pred_str from qa, w where item_id % 2 = parity""")
def q_prediction_files(spark, sf_dir):
    """SNK2 -> SRC5: two datasets and two splits in one folder; a split that is written again
    replaces itself alone."""
    root = scratch_path(spark, "predictions")
    rows = qa_choice(spark, sf_dir).select("item_id", "question", "answer_idx", F.col("resp1").alias("pred_str"))

    def write(dataset, split, parity):
        own = rows.where(F.col("item_id") % 2 == parity).drop("item_id")
        io.write_predictions(own.select("*", F.lit(dataset).alias("dataset"), F.lit(split).alias("split")), root)

    for dataset, split, parity in (("medqa", "test", 1), ("medqa", "train 0/2", 0), ("openbookqa", "test", 1), ("medqa", "test", 0)):
        write(dataset, split, parity)
    return io.read_results(spark, root).select("dataset", "split", "question", "answer_idx", "pred_str")


@register("report_files", f"select run, key, value, text from ({_report_sql()}) z")
def q_report_files(spark, sf_dir):
    """SNK3: the entries of the written text reports."""
    path = scratch_path(spark, "reports")
    io.write_report(M.report_long(M.leaderboard(choice_results(spark, sf_dir))), path)
    lines = spark.read.text(path).where("instr(value, ': ') > 0")
    key, rest = F.substring_index("value", ": ", 1), F.expr("substr(value, instr(value, ': ') + 2)")
    number = F.when(key != "latex", rest).cast("double")
    return lines.select(F.col("run"), key.alias("key"), F.round(number, 6).alias("value"), F.when(key == "latex", rest).alias("text"))


def letter_of_digest(prompts: list[str]) -> list[str]:
    """A generator that can be told in advance: the answer follows from the prompt's digest."""
    from hashlib import md5

    return [f"The correct answer is {'ABCD'[int(md5(p.encode()).hexdigest()[:2], 16) % 4]}." for p in prompts]


@register("resumed_generation", f"""with {CORPUS_CTE},
g as (select item_id, run, prompt, md5(prompt) as d from r1a)
select item_id, run, d as prompt_md5,
  case when item_id % 3 = 0 then 'kept from the first run' else 'The correct answer is ' ||
    substr('ABCD', (('0x' || substr(d, 1, 2))::BIGINT % 4 + 1)::INTEGER, 1) || '.' end as response from g""")
def q_resumed_generation(spark, sf_dir):
    """A first run that reached a third of the items, and a second that goes on."""
    prompts = R.round1_prompts(medqa_corpus(spark, sf_dir, "alpaca"), "medqa", "alpaca").select("item_id", "run", "prompt")
    store = scratch_path(spark, "responses")
    R.resume_generation(prompts.where(F.col("item_id") % 3 == 0), lambda batch: ["kept from the first run"] * len(batch), store)
    done = R.resume_generation(prompts, letter_of_digest, store, rows_per_batch=20_000)
    return done.select("item_id", "run", F.md5("prompt").alias("prompt_md5"), "response")
