"""Formatting queries (P1-P9, F1-F4) over raw records derived from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sway.operators import formatting as P
from sway.plans import sqlgen as S
from sway.plans.fixtures import QA_CHOICE_SQL, QA_NUMBER_SQL, duck, raw_choice_lists, raw_choice_map, raw_numeric
from sway.plans.registry import register


def flat_sharegpt(df: DataFrame) -> DataFrame:
    """Conversations as text columns (oracles compare strings, not arrays)."""
    conv = F.col("conversations")
    return df.select(*[c for c in df.columns if c != "conversations"],
                     F.size(conv).alias("n_turns"),
                     conv[0]["from"].alias("human_from"), conv[0]["value"].alias("human_value"),
                     conv[1]["from"].alias("gpt_from"), conv[1]["value"].alias("gpt_value"))


MAP_CTE = f"""qa as ({duck(QA_CHOICE_SQL, orders='orders')}),
m as (select item_id, run, question, answer_idx,
        case answer_idx when 'A' then opt_a when 'B' then opt_b when 'C' then opt_c else opt_d end as gold,
        'A: ' || opt_a || ', B: ' || opt_b || ', C: ' || opt_c || ', D: ' || opt_d as opts
      from qa),
raw as (select *, case when item_id % 13 = 0 then gold || ' (disputed)' else gold end as answer from m)"""

LISTS_CTE = f"""qa as ({duck(QA_CHOICE_SQL, orders='orders')}),
raw as (select item_id, run, '  order ' || cast(item_id as varchar) || ' was placed by one nation  ' as fact1,
          question as question_stem, opt_a as t_a, opt_b as t_b, opt_c as t_c, opt_d || '!' as t_d,
          case when item_id % 17 = 0 then 'E' else answer_idx end as answer_key from qa),
l as (select *, {S.format_sent('fact1', '.')} || ' ' || {S.format_sent('question_stem', '?')} as head,
        'A: ' || {S.format_sent('t_a')} || ' B: ' || {S.format_sent('t_b')} || ' C: ' || {S.format_sent('t_c')}
        || ' D: ' || {S.format_sent('t_d')} as choice_text,
        case answer_key when 'A' then t_a when 'B' then t_b when 'C' then t_c when 'D' then t_d end as key_text
      from raw)"""

NUM_CTE = f"qn as ({duck(QA_NUMBER_SQL, orders='orders')})"


@register("to_alpaca_map", f"""with {MAP_CTE}
select item_id, run, {S.format_sent('question', '?')} as instruction, {S.format_sent('opts', '.')} as input,
  {S.format_sent("answer_idx || ': ' || answer", '.')} as output
from raw where answer = gold""")
def q_to_alpaca_map(spark, sf_dir):
    corpus, _ = P.reformat(raw_choice_map(spark, sf_dir), "medqa", "alpaca")
    return corpus


@register("to_sharegpt_map", f"""with {MAP_CTE}
select item_id, run, 2 as n_turns, 'human' as human_from,
  {S.format_sent('question', '?')} || ' ' || {S.format_sent('opts', '.')} as human_value,
  'gpt' as gpt_from, {S.format_sent("answer_idx || ': ' || answer", '.')} as gpt_value
from raw where answer = gold""")
def q_to_sharegpt_map(spark, sf_dir):
    corpus, _ = P.reformat(raw_choice_map(spark, sf_dir), "medqa", "sharegpt")
    return flat_sharegpt(corpus)


@register("reject_choice_map", f"""with {MAP_CTE}
select item_id, run, answer_idx, answer from raw where answer <> gold""")
def q_reject_choice_map(spark, sf_dir):
    _, rejects = P.check_choice_map(raw_choice_map(spark, sf_dir))
    return rejects.select("item_id", "run", "answer_idx", "answer")


@register("to_alpaca_lists", f"""with {LISTS_CTE}
select item_id, run, head as instruction, choice_text as input,
  answer_key || ': ' || {S.format_sent('key_text')} as output
from l where answer_key in ('A', 'B', 'C', 'D')""")
def q_to_alpaca_lists(spark, sf_dir):
    corpus, _ = P.reformat(raw_choice_lists(spark, sf_dir), "openbookqa", "alpaca")
    return corpus


@register("to_sharegpt_lists", f"""with {LISTS_CTE}
select item_id, run, 2 as n_turns, 'human' as human_from, head || ' ' || choice_text as human_value,
  'gpt' as gpt_from, answer_key || ': ' || {S.format_sent('key_text')} as gpt_value
from l where answer_key in ('A', 'B', 'C', 'D')""")
def q_to_sharegpt_lists(spark, sf_dir):
    corpus, _ = P.reformat(raw_choice_lists(spark, sf_dir), "openbookqa", "sharegpt")
    return flat_sharegpt(corpus)


@register("reject_choice_lists", f"""with {LISTS_CTE}
select item_id, run, answer_key as answerKey from l where answer_key not in ('A', 'B', 'C', 'D')""")
def q_reject_choice_lists(spark, sf_dir):
    _, rejects = P.check_choice_lists(raw_choice_lists(spark, sf_dir))
    return rejects.select("item_id", "run", "answerKey")


@register("to_alpaca_numeric", f"""with {NUM_CTE}
select item_id, run, {S.format_sent('question', '?')} as instruction, '' as input, answer as output from qn""")
def q_to_alpaca_numeric(spark, sf_dir):
    corpus, _ = P.reformat(raw_numeric(spark, sf_dir), "gsm8k", "alpaca")
    return corpus


@register("to_sharegpt_numeric", f"""with {NUM_CTE}
select item_id, run, 2 as n_turns, 'human' as human_from, {S.format_sent('question', '?')} as human_value,
  'gpt' as gpt_from, answer as gpt_value from qn""")
def q_to_sharegpt_numeric(spark, sf_dir):
    corpus, _ = P.reformat(raw_numeric(spark, sf_dir), "gsm8k", "sharegpt")
    return flat_sharegpt(corpus)
