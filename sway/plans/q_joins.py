"""Join-shaped queries (J1, J3, J6), predicted labels (A8), chunk order (O2)
and single-round span records (R8)."""

from __future__ import annotations


from sway.functions import constants as K
from sway.functions.extract import extract_choice
from sway.operators import metrics as M
from sway.operators import packing as PK
from sway.operators import rounds as R
from sway.plans import sqlgen as S
from sway.plans.fixtures import QA_CHOICE_SQL, duck, qa_choice
from sway.plans.q_metrics import RES_CTE, choice_results
from sway.plans.q_pack import PACK_L, PACK_NSEQ, _pack_sql
from sway.plans.q_rounds import CORPUS_CTE, medqa_corpus, responses
from sway.plans.registry import register, table

SEED = K.DEFAULT_SEED
QA = f"qa as ({duck(QA_CHOICE_SQL, orders='orders')})"


@register("attach_gold", f"""with {QA},
r as (select run, item_id, 1 as round, resp1 as response from qa union all select run, item_id, 2, resp2 from qa),
w as (select run, item_id, max(case when round = 1 then response end) as r1,
        max(case when round = 2 then response end) as r2 from r group by run, item_id)
select w.run, w.item_id, qa.answer_idx as gt, {S.choice('w.r1')} as pred, {S.choice('w.r2')} as attack_pred
from w join qa on w.run = qa.run and w.item_id = qa.item_id""")
def q_attach_gold(spark, sf_dir):
    """Recorded responses (one row per item and round) -> one row per item
    (J3) -> parsed -> joined with the gold answers (J1)."""
    qa = qa_choice(spark, sf_dir)
    wide = R.pair_rounds(responses(qa))
    preds = wide.select("run", "item_id", extract_choice("response_1").alias("pred"),
                        extract_choice("response_2").alias("attack_pred"))
    return R.attach_gold(preds, qa).select("run", "item_id", "gt", "pred", "attack_pred")


@register("alignment_check", f"""with {CORPUS_CTE}
select item_id, 'right_only' as side from qa where item_id not in (select item_id from corpus)""")
def q_alignment_check(spark, sf_dir):
    """Items present on one side only (corpus after the integrity check vs
    all gold items)."""
    corpus = medqa_corpus(spark, sf_dir, "alpaca").select("item_id")
    return R.assert_aligned(corpus, qa_choice(spark, sf_dir).select("item_id"), ["item_id"])


@register("predicted_labels", f"with {RES_CTE} select distinct run, phase, pred as label from ph2")
def q_predicted_labels(spark, sf_dir):
    return M.predicted_labels(M.phase_cube(M.outcome_cube(choice_results(spark, sf_dir))))


@register("chunk_order", f"""with {_pack_sql('documents', 'doc_id', 'text', PACK_L, PACK_NSEQ, 'text')},
k as (select shard, chunk_id, cast(shard as varchar) || ':' || cast(chunk_id as varchar) as chunk_key from c
      where n = {PACK_L})
select chunk_key, md5('{SEED}:' || chunk_key) as order_key,
  (row_number() over (order by md5('{SEED}:' || chunk_key), chunk_key) - 1)::BIGINT as rn from k""")
def q_chunk_order(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    chars = PK.text_chars(docs, "text")
    shards = PK.shard_count(docs, "text", PACK_L, PACK_NSEQ, total_chars=chars)
    chunks = PK.chunk_ids(PK.tokenize(docs, "text", max_len=None), "doc_id", "input_ids", PACK_L, shards, SEED)
    est = max(1, int(chars / K.PACK_CHARS_PER_TOKEN / PACK_L))
    return PK.chunk_order(chunks, SEED, est_chunks=est).select("chunk_key", "order_key", "rn")


SPAN_SUFFIX = K.TASK_SUFFIX["squad_v2"]


@register("span_records", f"""with {CORPUS_CTE},
s as (select item_id, run, instruction, input, output,
        '<|begin_of_text|>' || {S.fill(K.ALPACA_INFER, instruction='instruction',
                                         input=f"input || {S.lit(chr(10) * 2 + SPAN_SUFFIX)}", response="''")}
        || {S.lit(K.DEFAULT_EOS)} || resp1 as pred_str from r1a)
select item_id, run, instruction as question, input as context, output as answer,
  {S.span(S.response_of_alpaca('pred_str'))} as pred_ans from s""")
def q_span_records(spark, sf_dir):
    """Single-round span QA (no challenge round), answers parsed as spans."""
    qa = qa_choice(spark, sf_dir)
    rec = R.two_round(medqa_corpus(spark, sf_dir, "alpaca"), "squad_v2", "alpaca", responses=responses(qa))
    return rec.select("item_id", "run", "question", "context", "answer", "pred_ans")
