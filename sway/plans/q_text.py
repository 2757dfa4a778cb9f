"""Conversation and training-text queries (SRC8, F7, F10, F11, P11, R1, R2)
over the ``conversations`` table and the derived medqa corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from sway.functions import constants as K
from sway.functions.prompts import add_feedback, render_chat, wrap_first_turn
from sway.operators import formatting as P
from sway.operators import rounds as R
from sway.plans import sqlgen as S
from sway.plans.q_format import MAP_CTE
from sway.plans.q_rounds import medqa_corpus
from sway.plans.registry import register, table
from sway.sources.io import chat_pieces, turns_to_sharegpt

EOS = K.DEFAULT_EOS
NL2 = "\n\n"


def conversations(spark, sf_dir):
    return turns_to_sharegpt(table(spark, sf_dir, "conversations"))


def _piece(role: str, text: str) -> str:
    return f"'<|start_header_id|>' || {role} || '<|end_header_id|>' || chr(10) || chr(10) || {S.strip(text)} || '<|eot_id|>'"


CONV_CTE = """t as (select conv_id, turn, role, text,
          case role when 'user' then 'human' when 'assistant' then 'gpt' else role end as sg,
          row_number() over (partition by conv_id order by turn) as pos from conversations)"""


@register("sharegpt_from_turns", f"""with {CONV_CTE}
select conv_id, count(*)::INTEGER as n_turns, string_agg(sg, ',' order by turn) as roles,
  md5(string_agg(text, chr(30) order by turn)) as values_md5 from t group by conv_id""")
def q_sharegpt_from_turns(spark, sf_dir):
    c = conversations(spark, sf_dir)
    conv = F.col("conversations")
    return c.select("conv_id", F.size(conv).alias("n_turns"),
                    F.array_join(F.transform(conv, lambda m: m["from"]), ",").alias("roles"),
                    F.md5(F.array_join(F.transform(conv, lambda m: m["value"]), "\u001e")).alias("values_md5"))


@register("chat_text", f"""with {CONV_CTE}
select conv_id, '<|begin_of_text|>' || string_agg({_piece('role', 'text')}, '' order by turn) as text
from t group by conv_id""")
def q_chat_text(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", render_chat("conversations").alias("text"))


_CHALLENGED_TURN = f"case when pos = 1 then {S.lit(EOS + K.TRAIN_FEEDBACK + EOS)} || text else text end"


@register("chat_challenged", f"""with {CONV_CTE}
select conv_id, '<|begin_of_text|>' || string_agg({_piece('role', _CHALLENGED_TURN)}, '' order by turn) as text
from t group by conv_id""")
def q_chat_challenged(spark, sf_dir):
    """F11 (ShareGPT): challenge prefix on the first message, then the chat layout."""
    return conversations(spark, sf_dir).select("conv_id", render_chat(wrap_first_turn("conversations")).alias("text"))


FEEDBACK_MARKER = S.lit(K.USER_MARKER)


@register("add_feedback", f"""with {CONV_CTE},
c as (select conv_id, '<|begin_of_text|>' || string_agg({_piece('role', 'text')}, '' order by turn) as text
      from t group by conv_id)
select conv_id, replace(text, {FEEDBACK_MARKER}, {S.lit(K.USER_MARKER + K.TRAIN_FEEDBACK)}) as text from c""")
def q_add_feedback(spark, sf_dir):
    c = conversations(spark, sf_dir).select("conv_id", render_chat("conversations").alias("text"))
    return c.select("conv_id", add_feedback("text").alias("text"))


@register("missing_marker", f"""with {CONV_CTE},
c as (select conv_id, '<|begin_of_text|>' || string_agg({_piece('role', 'text')}, '' order by turn) as text
      from t group by conv_id)
select conv_id, length(text)::INTEGER as n_chars from c where position({FEEDBACK_MARKER} in text) = 0""")
def q_missing_marker(spark, sf_dir):
    return P.missing_marker_pieces(chat_pieces(table(spark, sf_dir, "conversations")))


TRAIN_CTE = f"""{MAP_CTE},
corpus as (select item_id, run, {S.format_sent('question', '?')} as instruction, {S.format_sent('opts', '.')} as input,
             {S.format_sent("answer_idx || ': ' || answer", '.')} as output from raw where answer = gold),
tt as (select item_id, {S.fill(K.ALPACA_TRAIN, instruction='instruction', input='input', response='output')}
         || {S.lit(EOS)} as text from corpus)"""


@register("training_text", f"with {TRAIN_CTE} select item_id, text from tt")
def q_training_text(spark, sf_dir):
    return R.training_text(medqa_corpus(spark, sf_dir, "alpaca"), "alpaca").select("item_id", "text")


@register("training_text_challenged", f"""with {TRAIN_CTE}
select item_id, {S.lit(EOS + K.TRAIN_FEEDBACK + EOS)} || text as text from tt""")
def q_training_text_challenged(spark, sf_dir):
    return R.training_text_challenged(medqa_corpus(spark, sf_dir, "alpaca"), "alpaca").select("item_id", "text")


@register("training_text_chat", f"""with {MAP_CTE},
corpus as (select item_id, {S.format_sent('question', '?')} || ' ' || {S.format_sent('opts', '.')} as human,
             {S.format_sent("answer_idx || ': ' || answer", '.')} as gpt from raw where answer = gold)
select item_id, '<|begin_of_text|>' || {_piece("'user'", 'human')} || {_piece("'assistant'", 'gpt')} as text
from corpus""")
def q_training_text_chat(spark, sf_dir):
    return R.training_text(medqa_corpus(spark, sf_dir, "sharegpt"), "sharegpt").select("item_id", "text")


@register("conversation_prompts", f"""with {CONV_CTE},
last as (select conv_id, max_by(role, turn) as last_role from conversations group by conv_id)
select t.conv_id, '<|begin_of_text|>' || string_agg({_piece('role', 'text')}, '' order by turn)
  || '<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) as prompt
from t join last on t.conv_id = last.conv_id where last.last_role = 'user' group by t.conv_id""")
def q_conversation_prompts(spark, sf_dir):
    """F10 with the generation prompt: conversations that end on a user turn,
    rendered for the assistant's next reply."""
    conv = conversations(spark, sf_dir)
    waiting = conv.filter(F.element_at("conversations", -1)["from"] == F.lit("human"))
    return waiting.select("conv_id", render_chat("conversations", add_generation_prompt=True).alias("prompt"))


@register("chat_pieces", f"""with b as (select conv_id, min(turn) as f from conversations group by conv_id)
select c.conv_id, c.turn, case when c.turn = b.f then '<|begin_of_text|>' else '' end || {_piece('c.role', 'c.text')}
  as piece from conversations c join b on c.conv_id = b.conv_id""")
def q_chat_pieces(spark, sf_dir):
    """F10 in gather-free long form (one rendered piece per turn)."""
    return chat_pieces(table(spark, sf_dir, "conversations"))
