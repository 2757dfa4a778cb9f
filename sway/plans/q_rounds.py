"""Prompt-round, extraction and two-round queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sway.functions import constants as K
from sway.functions.extract import extract_choice, extract_number, extract_span, recall_by_key, recall_option
from sway.functions.prompts import challenge_prefix
from sway.functions.text import gold_number
from sway.operators import formatting as P
from sway.operators import metrics as M
from sway.operators import rounds as R
from sway.plans import sqlgen as S
from sway.plans.fixtures import QA_CHOICE_SQL, QA_NUMBER_SQL, duck, qa_choice, qa_number, raw_choice_map, raw_numeric
from sway.plans.q_format import MAP_CTE
from sway.plans.q_metrics import metrics_ctes, written_cube
from sway.plans.registry import register, table

EOS = K.DEFAULT_EOS
NL2 = "\n\n"
SEED = K.DEFAULT_SEED


def responses(qa: DataFrame) -> DataFrame:
    """Recorded responses ``(run, item_id, round, response)``."""
    return qa.selectExpr("run", "item_id", "stack(2, 1, resp1, 2, resp2) as (round, response)")


KEEP = ("item_id", "run")
WITH_RESP = ("item_id", "run", "resp1", "resp2")


def medqa_corpus(spark, sf_dir, fmt, keep=KEEP):
    corpus, _ = P.reformat(raw_choice_map(spark, sf_dir), "medqa", fmt, keep=keep)
    return corpus


def gsm8k_corpus(spark, sf_dir, fmt, keep=KEEP):
    corpus, _ = P.reformat(raw_numeric(spark, sf_dir), "gsm8k", fmt, keep=keep)
    return corpus


# ------------------------------------------------------------- oracle CTEs
SUFFIX_CHOICE = K.TASK_SUFFIX["medqa"]
SUFFIX_NUM = K.TASK_SUFFIX["gsm8k"]

CORPUS_CTE = f"""{MAP_CTE},
corpus as (select item_id, run, {S.format_sent('question', '?')} as instruction, {S.format_sent('opts', '.')} as input,
             {S.format_sent("answer_idx || ': ' || answer", '.')} as output from raw where answer = gold),
chat as (select item_id, run, instruction || ' ' || input as question, output as gold from corpus),
r1a as (select c.item_id, c.run, c.instruction, c.input, c.output,
          {S.fill(K.ALPACA_INFER, instruction='c.instruction', input=f"c.input || {S.lit(NL2 + SUFFIX_CHOICE)}", response="''")}
            || {S.lit(EOS)} as prompt,
          q.resp1, q.resp2
        from corpus c join qa q on c.item_id = q.item_id),
r1c as (select c.item_id, c.run, c.question, c.gold,
          {S.user_prompt(f"c.question || {S.lit(NL2 + SUFFIX_CHOICE)}")} as prompt, q.resp1, q.resp2
        from chat c join qa q on c.item_id = q.item_id)"""


def _prefix_sql(key: str) -> str:
    pool = K.IDENTITY_POOLS["medqa"]
    head, tail = K.CHALLENGE_WITH_IDENTITY.split("{identity}")
    who = f"list_value({', '.join(S.lit(x) for x in pool)})[{S.seeded_pick(key, len(pool), SEED)} + 1]"
    return f"({S.lit(head)} || {who} || {S.lit(tail)})"


# ------------------------------------------------------------- round one
@register("round1_prompts", f"with {CORPUS_CTE} select item_id, run, prompt from r1a")
def q_round1_prompts(spark, sf_dir):
    return R.round1_prompts(medqa_corpus(spark, sf_dir, "alpaca"), "medqa", "alpaca").select("item_id", "run", "prompt")


@register("chat_generation_prompt", f"with {CORPUS_CTE} select item_id, run, prompt from r1c")
def q_chat_generation_prompt(spark, sf_dir):
    return R.round1_prompts(medqa_corpus(spark, sf_dir, "sharegpt"), "medqa", "sharegpt").select("item_id", "run",
                                                                                                  "prompt")


@register("extract_choice_alpaca", f"""with {CORPUS_CTE},
t as (select item_id, run, '<|begin_of_text|>' || prompt || resp1 as tr from r1a)
select item_id, run, {S.choice(S.response_of_alpaca('tr'))} as pred_idx from t""")
def q_extract_choice_alpaca(spark, sf_dir):
    r1 = R.round1_prompts(medqa_corpus(spark, sf_dir, "alpaca", WITH_RESP), "medqa", "alpaca",
                          keep=WITH_RESP)
    t = r1.withColumn("tr", R.transcript("prompt", "resp1", "alpaca"))
    return R.with_parsed(t, "tr", "medqa", "alpaca", "pred_idx").select("item_id", "run", "pred_idx")


@register("extract_choice_chat", f"""with {CORPUS_CTE},
t as (select item_id, run, prompt || resp2 || '<|eot_id|>' as tr from r1c)
select item_id, run, {S.choice(S.response_of_chat('tr'))} as pred_idx from t""")
def q_extract_choice_chat(spark, sf_dir):
    r1 = R.round1_prompts(medqa_corpus(spark, sf_dir, "sharegpt", WITH_RESP), "medqa", "sharegpt",
                          keep=WITH_RESP)
    t = r1.withColumn("tr", R.transcript("prompt", F.concat("resp2", F.lit(K.EOT)), "sharegpt"))
    return R.with_parsed(t, "tr", "medqa", "sharegpt", "pred_idx").select("item_id", "run", "pred_idx")


@register("extract_span", f"""with {CORPUS_CTE}
select item_id, {S.span('resp1')} as span1, {S.span('resp2')} as span2,
  {S.span(S.response_of_alpaca("'<|begin_of_text|>' || prompt || resp1"))} as span_alpaca from r1a""")
def q_extract_span(spark, sf_dir):
    r1 = R.round1_prompts(medqa_corpus(spark, sf_dir, "alpaca", WITH_RESP), "medqa", "alpaca",
                          keep=WITH_RESP)
    t = r1
    t = R.with_parsed(t.withColumn("tr", R.transcript("prompt", "resp1", "alpaca")), "tr", "squad_v2", "alpaca",
                      "span_alpaca")
    return t.select("item_id", extract_span("resp1").alias("span1"), extract_span("resp2").alias("span2"),
                    "span_alpaca")


NUM_CTE = f"""qn as ({duck(QA_NUMBER_SQL, orders='orders')}),
nc as (select item_id, run, {S.format_sent('question', '?')} as instruction, answer from qn),
nt as (select nc.item_id, nc.run, nc.answer, qn.resp1, qn.resp2,
         {S.user_prompt(f"nc.instruction || {S.lit(NL2 + SUFFIX_NUM)}")} as prompt from nc join qn on nc.item_id = qn.item_id)"""


@register("extract_number", f"""with {NUM_CTE}
select item_id, {S.number('resp1')} as pred_val, {S.number('resp2')} as attack_pred_val,
  {S.number(S.response_of_chat("prompt || resp1 || '<|eot_id|>'"))} as pred_val_chat from nt""")
def q_extract_number(spark, sf_dir):
    r1 = R.round1_prompts(gsm8k_corpus(spark, sf_dir, "sharegpt", WITH_RESP), "gsm8k", "sharegpt",
                          keep=WITH_RESP)
    t = r1
    t = t.withColumn("tr", R.transcript("prompt", F.concat("resp1", F.lit(K.EOT)), "sharegpt"))
    t = R.with_parsed(t, "tr", "gsm8k", "sharegpt", "pred_val_chat")
    return t.select("item_id", extract_number("resp1").alias("pred_val"), extract_number("resp2").alias("attack_pred_val"),
                    "pred_val_chat")


def _norm_sql(a: str, p: str, q: str) -> str:
    num = "'^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$'"
    ca, cp, cq = (f"replace({x}, ',', '')" for x in (a, p, q))

    def dec(x):
        return f"(case when position('.' in {x}) > 0 then length(split_part({x}, '.', 2)) else 0 end)"

    ok = f"(regexp_matches({ca}, {num}) and regexp_matches({cp}, {num}) and regexp_matches({cq}, {num}))"
    fmt = f"('%.' || greatest({dec(ca)}, {dec(cp)}, {dec(cq)}) || 'f')"
    return ", ".join(f"case when {ok} then printf({fmt}, cast({x} as double)) else {x} end as {name}"
                     for x, name in ((ca, "gt"), (cp, "pred"), (cq, "attack_pred")))


NUMRES_CTE = f"""{NUM_CTE},
nr as (select item_id, run, trim(split_part(answer, '####', 2)) as answer_val, {S.number('resp1')} as pred_val,
         {S.number('resp2')} as attack_pred_val from nt),
nn as (select item_id, run, {_norm_sql('answer_val', 'pred_val', 'attack_pred_val')} from nr)"""


def numeric_results(spark, sf_dir) -> DataFrame:
    # extracted values first, in their own projection: the canonicalisation
    # reads each of them several times
    vals = qa_number(spark, sf_dir).select(
        "item_id", "run", gold_number("answer").alias("answer_val"), extract_number("resp1").alias("pred_val"),
        extract_number("resp2").alias("attack_pred_val"))
    return R.numeric_results(vals, keep=("item_id", "run"))


@register("normalise_numbers", f"with {NUMRES_CTE} select item_id, run, gt, pred, attack_pred from nn")
def q_normalise_numbers(spark, sf_dir):
    return numeric_results(spark, sf_dir)


@register("numeric_evaluate", f"""with {NUMRES_CTE},
cube as (select run, gt, pred, attack_pred, count(*) as n from nn group by all),
ph as (select run, 'before' as phase, gt, pred, n from cube union all select run, 'after', gt, attack_pred, n from cube),
ph2 as (select run, phase, gt, pred, sum(n) as n from ph group by all),
cls as (select run, phase, label, sum(tp) as tp, sum(pr) as pr, sum(sp) as sp from (
  select run, phase, gt as label, case when gt = pred then n else 0 end as tp, 0 as pr, n as sp from ph2
  union all select run, phase, pred, 0, n, 0 from ph2) u group by all)
select run, phase, round(sum(tp)::double / sum(sp), 6) as accuracy,
  round(avg(coalesce(tp::double / nullif(pr, 0), 0)), 6) as precision,
  round(avg(coalesce(tp::double / nullif(sp, 0), 0)), 6) as recall,
  round(avg(coalesce(2 * tp::double / nullif(pr + sp, 0), 0)), 6) as f1, count(*) as n_labels
from cls group by run, phase""")
def q_numeric_evaluate(spark, sf_dir):
    pm = M.phase_metrics(M.class_stats(M.outcome_cube(numeric_results(spark, sf_dir))))
    cols = ["accuracy", "precision", "recall", "f1"]
    return pm.select("run", "phase", *[F.round(c, 6).alias(c) for c in cols], "n_labels")


_NUM_PH = f"""with {NUMRES_CTE},
ph as (select run, 'before' as phase, gt, pred, count(*) as n from nn group by all
       union all select run, 'after', gt, attack_pred, count(*) from nn group by all)"""


@register("numeric_predicted_labels", f"{_NUM_PH} select distinct run, phase, pred as label from ph")
def q_numeric_predicted_labels(spark, sf_dir):
    """A8 with as many labels as items: every distinct predicted number."""
    return M.predicted_labels(M.phase_cube(M.outcome_cube(numeric_results(spark, sf_dir))))


@register("numeric_confusion", f"""{_NUM_PH},
labs as (select distinct run, phase, pred as label from ph)
select run, phase, gt, pred, n::BIGINT as n from ph
where exists (select 1 from labs where labs.run = ph.run and labs.phase = ph.phase and labs.label = ph.gt)""")
def q_numeric_confusion(spark, sf_dir):
    """A7 with as many labels as items: the non-zero cells of every run."""
    return M.confusion_long(M.phase_cube(written_cube(numeric_results(spark, sf_dir))))


def mixed_records(qa: DataFrame) -> DataFrame:
    """Result records as a folder of runs holds them: some of a dataset without a
    two-round score, some without a gold answer or a prediction."""
    k = F.col("item_id")
    folder = F.when(k % 5 == 0, "squad_v2").when(k % 5 == 1, "gsm8k").otherwise("medqa")
    none = F.lit(None).cast("string")
    numeric = folder == "gsm8k"
    gold = F.when(k % 7 != 0, F.when(numeric, k.cast("string")).otherwise(F.col("answer_idx")))
    first, second = extract_choice("resp1"), F.when(k % 11 != 0, extract_choice("resp2"))
    pick = lambda c, on: F.when(on, c).otherwise(none)
    return qa.select(
        F.concat(F.lit("/runs/"), folder, F.lit("/"), F.col("run"), F.lit(".jsonl")).alias("path"),
        pick(gold, ~numeric).alias("answer_idx"), pick(first, ~numeric).alias("pred_idx"), pick(second, ~numeric).alias("attack_pred_idx"),
        pick(gold, numeric).alias("answer_val"), pick(first, numeric).alias("pred_val"), pick(second, numeric).alias("attack_pred_val"))


@register("outcome_rejects", f"""with qa as ({duck(QA_CHOICE_SQL, orders='orders')}),
r as (select run, item_id, case item_id % 5 when 0 then 'squad_v2' when 1 then 'gsm8k' else 'medqa' end as folder,
        {S.choice('resp1')} as first, case when item_id % 11 <> 0 then {S.choice('resp2')} end as second from qa),
j as (select '/runs/' || folder || '/' || run || '.jsonl' as run, case when folder = 'squad_v2' then 'unknown' else folder end as dataset,
        case when folder = 'squad_v2' then 'unknown dataset' when item_id % 7 = 0 then 'missing gold'
             when second is null then 'missing prediction' when first = '' or second = '' then 'unparsed answer' end as reason from r)
select run, dataset, reason, count(*) as n from j where reason is not null group by run, dataset, reason""")
def q_outcome_rejects(spark, sf_dir):
    """Records that can't be scored, by reason, and those scored as unparsed."""
    return R.outcome_rejects(mixed_records(qa_choice(spark, sf_dir)))


# ------------------------------------------------------------- round two
@register("recall_option", f"""with {CORPUS_CTE},
p as (select a.item_id, a.input, c.question, {S.choice('a.resp1')} as pred from r1a a join r1c c on a.item_id = c.item_id)
select item_id, pred, {S.recall('input', 'pred')} as recall_alpaca,
  {S.recall('question', 'pred', from_first_a=True)} as recall_chat from p""")
def q_recall_option(spark, sf_dir):
    c = medqa_corpus(spark, sf_dir, "alpaca", WITH_RESP)
    t = c.withColumn("pred", extract_choice("resp1"))
    question = F.concat(F.col("instruction"), F.lit(" "), F.col("input"))
    return t.select("item_id", "pred", recall_option("input", "pred").alias("recall_alpaca"),
                    recall_option(question, "pred", from_first_a=True).alias("recall_chat"))


@register("recall_option_compat", f"""with {CORPUS_CTE},
p as (select a.item_id, a.input, c.question, {S.choice('a.resp1')} as pred from r1a a join r1c c on a.item_id = c.item_id)
select item_id, pred, {S.recall('input', 'pred', compat=True)} as recall_alpaca,
  {S.recall('question', 'pred', from_first_a=True, compat=True)} as recall_chat from p""")
def q_recall_option_compat(spark, sf_dir):
    """F14 as the reference does it: an unparsed answer recalls option A."""
    t = medqa_corpus(spark, sf_dir, "alpaca", WITH_RESP).withColumn("pred", extract_choice("resp1"))
    question = F.concat(F.col("instruction"), F.lit(" "), F.col("input"))
    return t.select("item_id", "pred", recall_option("input", "pred", compat=True).alias("recall_alpaca"),
                    recall_option(question, "pred", from_first_a=True, compat=True).alias("recall_chat"))


@register("recall_by_key", f"""with qa as ({duck(QA_CHOICE_SQL, orders='orders')}), p as (select *, {S.choice('resp1')} as pred from qa)
select item_id, pred, case pred when 'A' then opt_a when 'B' then opt_b when 'C' then opt_c when 'D' then opt_d else '' end as recalled
from p""")
def q_recall_by_key(spark, sf_dir):
    """F14 for structured options: by label, the text uncut."""
    raw = raw_choice_map(spark, sf_dir).withColumn("pred", extract_choice("resp1"))
    return raw.select("item_id", "pred", recall_by_key("options", "pred").alias("recalled"))


@register("identity_choice", f"""with qa as ({duck(QA_CHOICE_SQL, orders='orders')})
select item_id, {_prefix_sql('item_id')} as prefix from qa""")
def q_identity_choice(spark, sf_dir):
    qa = qa_choice(spark, sf_dir)
    return qa.select("item_id", challenge_prefix("random", "medqa", "item_id", SEED).alias("prefix"))


def r2a_sql(extra: str = "", compat: bool = False) -> str:
    return f"""with {CORPUS_CTE},
p as (select *, {S.choice(S.response_of_alpaca("'<|begin_of_text|>' || prompt || resp1"))} as pred from r1a),
q as (select *, {S.recall('input', 'pred', compat=compat)} as rec from p)
select item_id, run, {extra} {_prefix_sql('item_id')} || chr(10) ||
  {S.fill(K.ALPACA_CHALLENGE, instruction='instruction', input='input',
          previous_response=f"case when rec <> '' then rec || {S.lit(NL2 + SUFFIX_CHOICE)} else '' end",
          response="''")} || {S.lit(EOS)} as prompt2 from q"""


R2A_SQL = r2a_sql()


@register("round2_prompts", R2A_SQL)
def q_round2_prompts(spark, sf_dir):
    r1 = R.round1_prompts(medqa_corpus(spark, sf_dir, "alpaca", WITH_RESP), "medqa", "alpaca", keep=WITH_RESP)
    t = r1
    t = R.with_parsed(t.withColumn("tr", R.transcript("prompt", "resp1", "alpaca")), "tr", "medqa", "alpaca", "pred")
    return t.select("item_id", "run", R.round2_prompt(t, "medqa", "alpaca", identity="random", seed=SEED).alias("prompt2"))


R2C_SQL = f"""with {CORPUS_CTE},
p as (select *, {S.choice(S.response_of_chat('prompt || resp1'))} as pred from r1c),
q as (select *, {S.recall('question', 'pred', from_first_a=True)} as rec from p)
select item_id, run, {S.user_prompt(f"{S.lit(K.CHALLENGE)} || {S.lit(NL2)} || question || {S.lit(NL2 + K.PREVIOUS_RESPONSE_LABEL)} || rec || {S.lit(NL2 + SUFFIX_CHOICE)}")} as prompt2 from q"""


@register("round2_prompts_chat", R2C_SQL)
def q_round2_prompts_chat(spark, sf_dir):
    r1 = R.round1_prompts(medqa_corpus(spark, sf_dir, "sharegpt", WITH_RESP), "medqa", "sharegpt", keep=WITH_RESP)
    t = r1
    t = R.with_parsed(t.withColumn("tr", R.transcript("prompt", "resp1", "sharegpt")), "tr", "medqa", "sharegpt",
                      "pred")
    return t.select("item_id", "run", R.round2_prompt(t, "medqa", "sharegpt", identity=None).alias("prompt2"))


def _two_round_sql(compat: bool = False) -> str:
    inner = r2a_sql("instruction, input, output, resp1, resp2,", compat)
    return f"""with r2 as ({inner}),
t as (select *, '<|begin_of_text|>' || prompt2 || resp2 as attack_pred_str from r2),
u as (select t.*, {S.choice(S.response_of_alpaca('attack_pred_str'))} as attack_pred_idx from t)
select item_id, run, instruction as question, input as options,
  {S.strip("split_part(output, ':', 2)")} as answer, {S.strip("split_part(output, ':', 1)")} as answer_idx,
  attack_pred_str, attack_pred_idx from u"""


@register("two_round", _two_round_sql())
def q_two_round(spark, sf_dir):
    qa = qa_choice(spark, sf_dir)
    rec = R.two_round(medqa_corpus(spark, sf_dir, "alpaca"), "medqa", "alpaca", responses=responses(qa),
                      identity="random", seed=SEED)
    return rec.select("item_id", "run", "question", "options", "answer", "answer_idx", "attack_pred_str",
                      "attack_pred_idx")


@register("two_round_compat", _two_round_sql(compat=True))
def q_two_round_compat(spark, sf_dir):
    """R9 with the reference's recall: an unparsed answer quotes option A."""
    qa = qa_choice(spark, sf_dir)
    rec = R.two_round(medqa_corpus(spark, sf_dir, "alpaca"), "medqa", "alpaca", responses=responses(qa),
                      identity="random", seed=SEED, compat=True)
    return rec.select("item_id", "run", "question", "options", "answer", "answer_idx", "attack_pred_str",
                      "attack_pred_idx")


@register("two_round_duplicates", f"""with {CORPUS_CTE},
p as (select *, {S.choice(S.response_of_alpaca("'<|begin_of_text|>' || prompt || resp1"))} as pred from r1a),
d as (select p.*, unnest(range(case when item_id % 9 = 0 then 3 else 1 end)) as copy from p)
select instruction as question, output, copy::INTEGER as copy, pred as pred_idx from d""")
def q_two_round_duplicates(spark, sf_dir):
    """R9 over a corpus without ids in which every ninth item stands three times:
    the content key and the number of the copy name one record each, so responses
    attach one to one."""
    corpus = medqa_corpus(spark, sf_dir, "alpaca", WITH_RESP)
    times = F.when(F.col("item_id") % 9 == 0, 2).otherwise(0)
    corpus = corpus.withColumn("copy", F.explode(F.sequence(F.lit(0), times)))
    keyed = R.with_item_key(corpus.drop("item_id"), ["instruction", "input", "output"])
    recorded = keyed.selectExpr("item_id", "stack(2, 1, resp1, 2, resp2) as (round, response)")
    rec = R.two_round(keyed.drop("resp1", "resp2", "copy"), "medqa", "alpaca", responses=recorded, keys=("item_id",))
    copy = F.coalesce(F.nullif(F.split_part("item_id", F.lit(":"), F.lit(2)), F.lit("")).cast("int"), F.lit(0))
    return rec.select("question", F.concat_ws(": ", "answer_idx", "answer").alias("output"), copy.alias("copy"), "pred_idx")


# --------------------------------------------------------- extraction from the supplied texts
def _texts_sql(keys: str, source: str) -> str:
    return (f"select {keys}, {S.choice('text', 'The')} as choice, {S.span('text', 'The')} as span, "
            f"{S.number('text', '###')} as number from {source}")


def _extracted(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, extract_choice("text", "The").alias("choice"), extract_span("text", "The").alias("span"),
                     extract_number("text", "###").alias("number"))


@register("extract_from_conversations", _texts_sql("conv_id, turn", "conversations"))
def q_extract_from_conversations(spark, sf_dir):
    """F17-F19 over every turn of the supplied conversations."""
    return _extracted(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@register("extract_from_documents", _texts_sql("doc_id", "documents"))
def q_extract_from_documents(spark, sf_dir):
    """F17-F19 over the whole text of every document."""
    return _extracted(table(spark, sf_dir, "documents"), "doc_id")


@register("prediction_records", f"""with {NUM_CTE},
t as (select *, prompt || resp1 as pred_str from nt),
u as (select *, {S.number(S.response_of_chat('pred_str'))} as pred_val from t),
v as (select *, {S.user_prompt(f"{S.lit(K.CHALLENGE)} || {S.lit(NL2)} || {S.format_sent('qn_q', '?')} || {S.lit(NL2 + K.PREVIOUS_RESPONSE_LABEL)} || pred_val || {S.lit(NL2 + SUFFIX_NUM)}")} || resp2 as attack_pred_str
      from (select u.*, qn.question as qn_q from u join qn on u.item_id = qn.item_id) x)
select item_id, run, answer, trim(split_part(answer, '####', 2)) as answer_val, pred_str, attack_pred_str, pred_val,
  {S.number(S.response_of_chat('attack_pred_str'))} as attack_pred_val from v""")
def q_prediction_records(spark, sf_dir):
    qn = qa_number(spark, sf_dir)
    rec = R.two_round(gsm8k_corpus(spark, sf_dir, "sharegpt"), "gsm8k", "sharegpt", responses=responses(qn))
    return rec.select("item_id", "run", "answer", "answer_val", "pred_str", "attack_pred_str", "pred_val",
                      "attack_pred_val")


def _two_round_metrics_sql() -> str:
    lb = ", ".join(f"round({c}, 6) as {c}" for c in ("accuracy_before", "accuracy_after", "f1_before", "f1_after",
                                                     "overall_flipping_rate"))
    content = (f"{S.lit(K.CHALLENGE)} || {S.lit(NL2)} || question || {S.lit(NL2 + K.PREVIOUS_RESPONSE_LABEL)} || rec"
               f" || {S.lit(NL2 + SUFFIX_CHOICE)}")
    return f"""with {CORPUS_CTE},
p as (select *, {S.choice(S.response_of_chat('prompt || resp1'))} as pred from r1c),
q as (select *, {S.recall('question', 'pred', from_first_a=True)} as rec from p),
r2 as (select run, gold, pred, resp2, {S.user_prompt(content)} as prompt2 from q),
res as (select run, {S.strip("split_part(gold, ':', 1)")} as gt, pred,
          {S.choice(S.response_of_chat('prompt2 || resp2'))} as attack_pred from r2),
{metrics_ctes('res')}
select run, n_items, {lb} from ev"""


@register("two_round_metrics", _two_round_metrics_sql())
def q_two_round_metrics(spark, sf_dir):
    """Two-round job on chat prompts, then the leaderboard of its records."""
    qa = qa_choice(spark, sf_dir)
    rec = R.two_round(medqa_corpus(spark, sf_dir, "sharegpt"), "medqa", "sharegpt", responses=responses(qa))
    cols = ["accuracy_before", "accuracy_after", "f1_before", "f1_after", "overall_flipping_rate"]
    ev = M.evaluate(R.choice_results(rec))
    return ev.select("run", "n_items", *[F.round(c, 6).alias(c) for c in cols])


def _two_round_numeric_sql() -> str:
    r1 = S.fill(K.ALPACA_INFER, instruction="instruction", input=f"'' || {S.lit(NL2 + SUFFIX_NUM)}", response="''")
    r2 = S.fill(K.ALPACA_CHALLENGE, instruction="instruction", input="''",
                previous_response=f"pred_val || {S.lit(NL2 + SUFFIX_NUM)}", response="''")
    return f"""with {NUM_CTE},
a as (select item_id, run, instruction, answer, resp1, resp2,
        '<|begin_of_text|>' || {r1} || {S.lit(EOS)} || resp1 as pred_str from nc join qn using (item_id, run, answer)),
b as (select *, {S.number(S.response_of_alpaca('pred_str'))} as pred_val from a),
c as (select *, '<|begin_of_text|>' || {S.lit(K.CHALLENGE)} || chr(10) || {r2} || {S.lit(EOS)} || resp2 as attack_pred_str
      from b)
select item_id, run, instruction as question, answer, trim(split_part(answer, '####', 2)) as answer_val, pred_val,
  {S.number(S.response_of_alpaca('attack_pred_str'))} as attack_pred_val, attack_pred_str from c"""


@register("two_round_numeric", _two_round_numeric_sql())
def q_two_round_numeric(spark, sf_dir):
    """R9 for numeric answers in the Alpaca format: the challenge quotes the
    previous number followed by the task suffix (always, even when empty)."""
    qn = qa_number(spark, sf_dir)
    rec = R.two_round(gsm8k_corpus(spark, sf_dir, "alpaca"), "gsm8k", "alpaca", responses=responses(qn))
    return rec.select("item_id", "run", "question", "answer", "answer_val", "pred_val", "attack_pred_val",
                      "attack_pred_str")


def _two_round_lists_sql() -> str:
    from sway.plans.q_format import LISTS_CTE

    suffix = K.TASK_SUFFIX["openbookqa"]
    r1 = S.fill(K.ALPACA_INFER, instruction="head", input=f"choice_text || {S.lit(NL2 + suffix)}", response="''")
    r2 = S.fill(K.ALPACA_CHALLENGE, instruction="head", input="choice_text",
                previous_response=f"case when rec <> '' then rec || {S.lit(NL2 + suffix)} else '' end", response="''")
    return f"""with {LISTS_CTE},
v as (select l.item_id, l.run, head, choice_text, answer_key || ': ' || {S.format_sent('key_text')} as output,
        qa.resp1, qa.resp2 from l join qa on l.item_id = qa.item_id where answer_key in ('A', 'B', 'C', 'D')),
a as (select *, '<|begin_of_text|>' || {r1} || {S.lit(EOS)} || resp1 as pred_str from v),
b as (select *, {S.choice(S.response_of_alpaca('pred_str'))} as pred_idx from a),
c as (select *, {S.recall('choice_text', 'pred_idx')} as rec from b),
d as (select *, '<|begin_of_text|>' || {S.lit(K.CHALLENGE)} || chr(10) || {r2} || {S.lit(EOS)} || resp2
        as attack_pred_str from c)
select item_id, run, head as question, choice_text as options, {S.strip("split_part(output, ':', 1)")} as answer_idx,
  pred_idx, {S.choice(S.response_of_alpaca('attack_pred_str'))} as attack_pred_idx from d"""


@register("two_round_lists", _two_round_lists_sql())
def q_two_round_lists(spark, sf_dir):
    """R9 for multiple choice given as parallel label/text lists (Alpaca)."""
    from sway.plans.fixtures import raw_choice_lists

    qa = qa_choice(spark, sf_dir)
    corpus, _ = P.reformat(raw_choice_lists(spark, sf_dir), "openbookqa", "alpaca")
    rec = R.two_round(corpus, "openbookqa", "alpaca", responses=responses(qa))
    return rec.select("item_id", "run", "question", "options", "answer_idx", "pred_idx", "attack_pred_idx")


def _two_round_lists_chat_sql() -> str:
    from sway.plans.q_format import LISTS_CTE

    suffix = K.TASK_SUFFIX["openbookqa"]
    content = (f"{S.lit(K.CHALLENGE)} || {S.lit(NL2)} || human || {S.lit(NL2 + K.PREVIOUS_RESPONSE_LABEL)} || rec"
               f" || {S.lit(NL2 + suffix)}")
    return f"""with {LISTS_CTE},
v as (select l.item_id, l.run, head || ' ' || choice_text as human,
        answer_key || ': ' || {S.format_sent('key_text')} as gold, qa.resp1, qa.resp2
      from l join qa on l.item_id = qa.item_id where answer_key in ('A', 'B', 'C', 'D')),
b as (select *, {S.choice(S.response_of_chat(S.user_prompt(f"human || {S.lit(NL2 + suffix)}") + " || resp1"))}
        as pred_idx from v),
c as (select *, {S.recall('human', 'pred_idx', from_first_a=True)} as rec from b),
d as (select *, {S.user_prompt(content)} || resp2 as attack_pred_str from c)
select item_id, run, human as question, {S.strip("split_part(gold, ':', 1)")} as answer_idx, pred_idx,
  {S.choice(S.response_of_chat('attack_pred_str'))} as attack_pred_idx, attack_pred_str from d"""


@register("two_round_lists_chat", _two_round_lists_chat_sql())
def q_two_round_lists_chat(spark, sf_dir):
    """R9 for multiple choice given as parallel label/text lists (chat)."""
    from sway.plans.fixtures import raw_choice_lists

    qa = qa_choice(spark, sf_dir)
    corpus, _ = P.reformat(raw_choice_lists(spark, sf_dir), "openbookqa", "sharegpt")
    rec = R.two_round(corpus, "openbookqa", "sharegpt", responses=responses(qa))
    return rec.select("item_id", "run", "question", "answer_idx", "pred_idx", "attack_pred_idx", "attack_pred_str")
