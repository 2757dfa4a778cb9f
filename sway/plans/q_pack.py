"""Tokenise / pack / order / batch queries (T*, K*, O*, A14) over
``documents``, ``conversations`` and the derived medqa corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from sway.functions import constants as K
from sway.functions.prompts import render_chat
from sway.operators import metrics as M
from sway.operators import packing as PK
from sway.operators import rounds as R
from sway.operators.scratch import scratch_path
from sway.plans import sqlgen as S
from sway.plans.q_rounds import medqa_corpus
from sway.plans.q_text import CONV_CTE, TRAIN_CTE, _piece, conversations
from sway.plans.registry import register, table
from sway.sources.io import chat_pieces

EOS = K.DEFAULT_EOS
SEED = K.DEFAULT_SEED
PACK_L = 1024
PACK_NSEQ = 64  # buffer of 1024 * 3.6 * 64 chars per shard
PAIR_L = 256
PAIR_NSEQ = 16
BATCH = 8


def toks_sql(text: str) -> str:
    spaced = f"regexp_replace({text}, '(<\\|[a-z_]+\\|>)', ' \\1 ', 'g')"
    return f"list_filter(regexp_split_to_array({spaced}, '\\s+'), lambda x: x <> '')"


def md5_join(arr) -> F.Column:
    return F.md5(F.array_join(arr, " "))


# ---------------------------------------------------------------- tokenise
@register("tokenize_truncate", f"""with d as (select doc_id, list_slice({toks_sql('text')}, 1, {K.MAX_SEQ_LENGTH}) as ids
                                           from documents)
select doc_id, len(ids)::INTEGER as n_tokens, len(ids)::BIGINT as mask_sum, md5(array_to_string(ids, ' ')) as ids_md5
from d""")
def q_tokenize_truncate(spark, sf_dir):
    docs = PK.tokenize(table(spark, sf_dir, "documents", ["doc_id", "text"]), "text",
                       max_len=K.MAX_SEQ_LENGTH)
    return docs.select("doc_id", F.size("input_ids").alias("n_tokens"),
                       F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("mask_sum"),
                       md5_join("input_ids").alias("ids_md5"))


def _pack_sql(src: str, key: str, text: str, L: int, nseq: int, shards_from: str, sep: str = EOS,
              sfx: str = "") -> str:
    """DuckDB packing by unnesting tokens (an independent formulation).
    Defines CTEs ``sh, d2, d3, u, c`` (+ ``sfx``); ``c`` holds the chunks."""
    bound = L * K.PACK_CHARS_PER_TOKEN * nseq
    return f"""sh{sfx} as (select ceil(sum(length({shards_from})) / {bound})::BIGINT as shards from {src}),
d2{sfx} as (select {key} as k, (('0x' || substr(md5('{SEED}:shard:' || cast({key} as varchar)), 1, 8))::BIGINT % shards)::INTEGER as shard,
         md5('{SEED}:' || cast({key} as varchar)) as okey, list_append({toks_sql(text)}, {S.lit(sep)}) as ids
       from {src}, sh{sfx}),
d3{sfx} as (select *, sum(len(ids)) over (partition by shard order by okey, k rows between unbounded preceding and current row)
                 - len(ids) as off from d2{sfx}),
u{sfx} as (select shard, off, unnest(ids) as tok, generate_subscripts(ids, 1) as i from d3{sfx}),
c{sfx} as (select shard, ((off + i - 1) // {L})::BIGINT as chunk_id, count(*) as n,
        md5(string_agg(tok, ' ' order by off + i)) as chunk_md5 from u{sfx} group by shard, chunk_id)"""


@register("pack_chunks", f"""with {_pack_sql('documents', 'doc_id', 'text', PACK_L, PACK_NSEQ, 'text')}
select shard, chunk_id, n::INTEGER as n_tokens, chunk_md5 from c where n = {PACK_L}""")
def q_pack_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    shards = PK.shard_count(docs, "text", PACK_L, PACK_NSEQ)
    toks = PK.tokenize(docs, "text", max_len=None)
    packed = PK.pack(toks, "doc_id", "input_ids", PACK_L, EOS, shards, SEED)
    return packed.select("shard", "chunk_id", F.size("input_ids").alias("n_tokens"), md5_join("input_ids").alias("chunk_md5"))


_GREEDY_BOUND = int(-(-PACK_L * K.PACK_CHARS_PER_TOKEN * PACK_NSEQ // 1))


@register("pack_greedy", f"""with recursive r as (
  select doc_id, text, row_number() over (order by doc_id) as rn, coalesce(length(text), 0) as l,
         coalesce(sum(length(text)) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as before from documents),
buffers(buffer, first_rn, place) as (
  select 0::BIGINT, 1::BIGINT, 0::HUGEINT
  union all
  select buffer + 1, rn + 1, done from (
    select buffer, min(rn) as rn, min(before + l) as done from buffers b join r on r.rn >= b.first_rn and r.before + r.l >= b.place + {_GREEDY_BOUND}
    group by buffer) z where rn < (select max(rn) from r)),
d2 as (select r.doc_id as k, max(b.buffer) as shard, md5('{SEED}:' || cast(r.doc_id as varchar)) as okey,
         list_append({toks_sql('any_value(r.text)')}, {S.lit(EOS)}) as ids
       from r join buffers b on b.first_rn <= r.rn where r.text is not null group by r.doc_id),
d3 as (select *, sum(len(ids)) over (partition by shard order by okey, k rows between unbounded preceding and current row) - len(ids) as off from d2),
u as (select shard, off, unnest(ids) as tok, generate_subscripts(ids, 1) as i from d3),
c as (select shard, ((off + i - 1) // {PACK_L})::BIGINT as chunk_id, count(*) as n, md5(string_agg(tok, ' ' order by off + i)) as chunk_md5
      from u group by shard, chunk_id)
select shard, chunk_id, n::INTEGER as n_tokens, chunk_md5 from c where n = {PACK_L}""")
def q_pack_greedy(spark, sf_dir):
    """K2 as buffers filled in input order, each shuffled and packed by itself."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    toks = PK.tokenize(docs, "text", max_len=None)
    packed = PK.pack(toks, "doc_id", "input_ids", PACK_L, EOS, seed=SEED, buffers="greedy", num_of_sequences=PACK_NSEQ)
    return packed.select("shard", "chunk_id", F.size("input_ids").alias("n_tokens"), md5_join("input_ids").alias("chunk_md5"))


@register("pack_pieces", f"""with {_pack_sql('documents', 'doc_id', 'text', PACK_L, PACK_NSEQ, 'text')}
select shard, chunk_id, n::INTEGER as n_tokens, chunk_md5 from c where n = {PACK_L}""")
def q_pack_pieces(spark, sf_dir):
    """K1 with no text in one row: pieces of 4,096 characters are tokenised and placed."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    shards = PK.shard_count(docs, "text", PACK_L, PACK_NSEQ)
    packed = PK.pack_texts(docs, "doc_id", "text", PACK_L, EOS, shards, SEED, piece_chars=4096)
    return packed.select("shard", "chunk_id", F.size("input_ids").alias("n_tokens"), md5_join("input_ids").alias("chunk_md5"))


_CHAT_SRC = f"""(select conv_id, text, replace(text, {S.lit(K.USER_MARKER)}, {S.lit(K.USER_MARKER + K.TRAIN_FEEDBACK)}) as ftext
  from (select conv_id, '<|begin_of_text|>' || string_agg({_piece('role', 'text')}, '' order by turn) as text
        from t group by conv_id) z)"""


def _pair_sql() -> str:
    a = _pack_sql("cs", "conv_id", "text", PAIR_L, PAIR_NSEQ, "ftext")
    b = _pack_sql("cs", "conv_id", "ftext", PAIR_L, PAIR_NSEQ, "ftext", sfx="_f")
    return f"""with {CONV_CTE}, cs as {_CHAT_SRC}, {a}, {b}
select c.shard, c.chunk_id, c.chunk_md5, c_f.chunk_md5 as followup_md5
from c join c_f on c.shard = c_f.shard and c.chunk_id = c_f.chunk_id
where c.n = {PAIR_L} and c_f.n = {PAIR_L}"""


@register("pack_paired", _pair_sql())
def q_pack_paired(spark, sf_dir):
    """K3 over the pieces of conversations: none is gathered into one row."""
    pieces = chat_pieces(table(spark, sf_dir, "conversations"), with_last=True)
    paired = PK.pack_paired(pieces, "conv_id", "piece", PAIR_L, EOS, seed=SEED, num_of_sequences=PAIR_NSEQ, part="turn",
                            last="last")
    return paired.select("shard", "chunk_id", md5_join("input_ids").alias("chunk_md5"),
                         md5_join("input_ids_followup").alias("followup_md5"))


def _pair_sample_sql() -> str:
    """A walk over each shard's samples: the chunk where a sample begins, and what its
    last chunk then holds."""
    bound = PAIR_L * K.PACK_CHARS_PER_TOKEN * PAIR_NSEQ
    return f"""with recursive {CONV_CTE}, cs as {_CHAT_SRC},
sh as (select ceil(sum(length(ftext)) / {bound})::BIGINT as shards from cs),
s as (select conv_id as k, (('0x' || substr(md5('{SEED}:shard:' || cast(conv_id as varchar)), 1, 8))::BIGINT % shards)::INTEGER as shard,
        md5('{SEED}:' || cast(conv_id as varchar)) as okey, list_append({toks_sql('text')}, {S.lit(EOS)}) as a,
        list_append({toks_sql('ftext')}, {S.lit(EOS)}) as b from cs, sh),
o as (select *, greatest(len(a), len(b)) as l, row_number() over (partition by shard order by okey, k) as rn from s),
walk(shard, rn, chunk, used, next_chunk) as (
  select shard, rn, 0::BIGINT, l - (l - 1) // {PAIR_L} * {PAIR_L}, (l - 1) // {PAIR_L} from o where rn = 1
  union all
  select o.shard, o.rn, c, case when fresh then 0 else w.used end + o.l - (o.l - 1) // {PAIR_L} * {PAIR_L}, c + (o.l - 1) // {PAIR_L}
  from (select *, next_chunk as nc from walk) w join o on o.shard = w.shard and o.rn = w.rn + 1,
       lateral (select w.used + o.l > {PAIR_L} as fresh) f, lateral (select case when fresh then nc + 1 else nc end as c) g),
parts as (
  select o.shard, o.rn, chunk + p as chunk_id, list_slice(a, p * {PAIR_L} + 1, (p + 1) * {PAIR_L}) as a,
         list_slice(b, p * {PAIR_L} + 1, (p + 1) * {PAIR_L}) as b
  from o join walk using (shard, rn), unnest(range((l - 1) // {PAIR_L} + 1)) t(p))
select shard, chunk_id::BIGINT as chunk_id, count(*) as n_samples,
  md5(array_to_string(flatten(list(a order by rn)), ' ')) as chunk_md5,
  md5(array_to_string(flatten(list(b order by rn)), ' ')) as followup_md5
from parts group by shard, chunk_id"""


@register("pack_paired_samples", _pair_sample_sql())
def q_pack_paired_samples(spark, sf_dir):
    """K3 cut at common sample boundaries: both chunks hold the same conversations."""
    chat = conversations(spark, sf_dir).select("conv_id", render_chat("conversations").alias("text"))
    paired = PK.pack_paired(chat, "conv_id", "text", PAIR_L, EOS, seed=SEED, num_of_sequences=PAIR_NSEQ, align="sample")
    return paired.select("shard", "chunk_id", "n_samples", md5_join("input_ids").alias("chunk_md5"),
                         md5_join("input_ids_followup").alias("followup_md5"))


_SPLIT_CTE = f"""{TRAIN_CTE},
s as (select item_id, {toks_sql('text')} as plain, {toks_sql(S.lit(K.TRAIN_FEEDBACK) + ' || text')} as chal from tt)"""


def challenged_tokens(spark, sf_dir):
    tt = R.training_text_challenged(medqa_corpus(spark, sf_dir, "alpaca"), "alpaca")
    return PK.tokenize(tt, "text", max_len=None).withColumn("labels", F.col("input_ids"))


@register("split_challenge", f"""with {_SPLIT_CTE}
select item_id, len(plain)::INTEGER as n_plain, md5(array_to_string(plain, ' ')) as plain_md5,
  len(chal)::INTEGER as n_challenged, md5(array_to_string(chal, ' ')) as challenged_md5 from s""")
def q_split_challenge(spark, sf_dir):
    rows = PK.split_challenge_rows(challenged_tokens(spark, sf_dir), EOS, cols=("input_ids",))
    ids, chal = F.col("input_ids"), F.col("input_ids_challenged")
    return rows.select("item_id", F.size(ids).alias("n_plain"), md5_join(ids).alias("plain_md5"),
                       F.size(chal).alias("n_challenged"), md5_join(chal).alias("challenged_md5"))


@register("split_challenge_labels", f"""with {_SPLIT_CTE}
select item_id, len(plain)::BIGINT as mask, len(chal)::BIGINT as mask_challenged, md5(array_to_string(plain, ' ')) as labels_md5,
  md5(array_to_string(chal, ' ')) as labels_challenged_md5 from s""")
def q_split_challenge_labels(spark, sf_dir):
    """K4 for the attention mask and the labels, cut with the ids."""
    rows = PK.split_challenge_rows(challenged_tokens(spark, sf_dir), EOS)
    ones = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select("item_id", ones("attention_mask").alias("mask"), ones("attention_mask_challenged").alias("mask_challenged"),
                       md5_join("labels").alias("labels_md5"), md5_join("labels_challenged").alias("labels_challenged_md5"))


@register("prepare_rows", f"""select doc_id, len({toks_sql('lower(text)')})::INTEGER as n_tokens,
  md5(array_to_string({toks_sql('lower(text)')}, ' ')) as ids_md5 from documents""")
def q_prepare_rows(spark, sf_dir):
    """T2 without packing, K6: the whole text comes from a formatting function; a
    table that is tokenised already passes through."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    rows = PK.prepare(docs, formatting_func=lambda df: F.lower("text"), max_len=None)
    return PK.prepare(rows).select("doc_id", F.size("input_ids").alias("n_tokens"), md5_join("input_ids").alias("ids_md5"))


@register("prepare_packed", f"""with {_pack_sql('documents', 'doc_id', 'text', PACK_L, PACK_NSEQ, 'text')}
select shard, chunk_id, chunk_md5 as labels_md5 from c where n = {PACK_L}""")
def q_prepare_packed(spark, sf_dir):
    """T2 with packing, T3, K5: chunks with their labels; no chunk is an error."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    rows = PK.prepare(docs, "text", packing=True, key="doc_id", seq_length=PACK_L, num_of_sequences=PACK_NSEQ)
    return rows.select("shard", "chunk_id", md5_join("labels").alias("labels_md5"))


# ------------------------------------------------------------ order, batches
@register("seeded_order", f"select doc_id, md5('{SEED}:' || cast(doc_id as varchar)) as order_key from documents")
def q_seeded_order(spark, sf_dir):
    return PK.seeded_order(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SEED)


@register("shuffled_order", f"""select doc_id, md5('{SEED}:' || cast(doc_id as varchar)) as order_key,
  row_number() over (order by md5('{SEED}:' || cast(doc_id as varchar)), doc_id) - 1 as position, md5(text) as text_md5 from documents""")
def q_shuffled_order(spark, sf_dir):
    """O1 as rows written in the seeded order, with their positions."""
    rows = PK.write_shuffled(table(spark, sf_dir, "documents", ["doc_id", "text"]), "doc_id", scratch_path(spark, "shuffled"), SEED)
    return rows.select("doc_id", "order_key", "position", F.md5("text").alias("text_md5"))


@register("batch_manifest", f"""with r as (select doc_id, (row_number() over (order by md5('{SEED}:' || cast(doc_id as varchar)), doc_id) - 1)::BIGINT as rn
           from documents), n as (select count(*) as n from documents)
select doc_id, rn, (rn // {BATCH})::BIGINT as batch from r, n where rn < (n.n // {BATCH}) * {BATCH}""")
def q_batch_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return PK.assign_batches(docs, "doc_id", BATCH, SEED, drop_last=True).select("doc_id", "rn", "batch")


@register("step_budget", f"""with {TRAIN_CTE}
select count(*)::BIGINT as n_rows, (10 * ceil(count(*) / 2))::BIGINT as total_steps from corpus""")
def q_step_budget(spark, sf_dir):
    return M.step_budget(medqa_corpus(spark, sf_dir, "alpaca"), epochs=10, batch_size=2)
