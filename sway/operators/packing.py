"""Tokenise, truncate, pack and batch.

Scale notes
-----------
* Tokenisation is a projection (native whitespace tokenizer) or an Arrow
  ``pandas_udf`` for a caller's tokenizer; it never leaves the partition.
* Packing cuts the token stream of a *shard* into constant-length chunks.
  Shards play the role of the reference's bounded text buffers: their number
  is derived from the same character bound (``seq_length * chars_per_token *
  num_of_sequences``), and documents are spread over them by a seeded hash, so
  each shard stays near that bound however large the corpus is. Inside a shard
  a window running sum gives every document its token offset; documents are
  exploded into one row per (document, chunk) they touch — never one row per
  token — and chunks are re-assembled by a grouped, ordered ``collect_list``
  whose groups hold at most ``seq_length`` tokens.
* Global ranks (batch manifest) use a two-level prefix sum over keys: they are range-
  bucketed on their hash-based order key, numbered inside their bucket, and
  the per-bucket counts (one row per bucket; the bucket count is derived from
  the row count, so buckets stay bounded) are prefix-summed and joined back.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Optional

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sway.functions.constants import (
    DEFAULT_EOS,
    DEFAULT_SEED,
    MAX_SEQ_LENGTH,
    PACK_CHARS_PER_TOKEN,
    PACK_NUM_SEQUENCES,
    PACK_SEQ_LENGTH,
    USER_MARKER,
)
from sway.functions.prompts import add_feedback
from sway.functions.text import ColumnOrName, col
from sway.operators.buffers import greedy_buffers
from sway.operators.ordering import with_positions, write_ordered
from sway.operators.scratch import written

# Special tokens of the chat layout (``<|name|>``) are kept as single tokens.
SPECIAL_TOKEN_RE = r"(<\|[a-z_]+\|>)"


# ----------------------------------------------------------------- tokenise
def whitespace_tokens(text: ColumnOrName, most: Optional[int] = None) -> Column:
    """Default tokenizer: special tokens stand alone, everything else splits on
    Unicode whitespace; empty pieces are dropped. With ``most`` the first so many."""
    spaced = F.regexp_replace(col(text), SPECIAL_TOKEN_RE, " $1 ")
    # an empty piece before the first token, and what is left after the last one needed
    pieces = F.split(spaced, r"(?U)\s+", -1 if most is None else most + 2)
    tokens = F.filter(pieces, lambda t: t != F.lit(""))
    return tokens if most is None else F.slice(tokens, 1, most)


Tokenizer = Callable[[list[str]], list[list[int]]]


def tokenizer_udf(fn: Tokenizer, element_type: T.DataType = T.IntegerType()):
    """Wrap a batch tokenizer ``fn(list[str]) -> list[list[id]]`` as an Arrow
    pandas UDF (one call per Arrow batch, not per row)."""

    @F.pandas_udf(T.ArrayType(element_type))
    def _tok(texts: pd.Series) -> pd.Series:
        return pd.Series(fn(texts.fillna("").tolist()), index=texts.index)

    return _tok


def tokenize(df: DataFrame, text_col: str = "text", max_len: Optional[int] = MAX_SEQ_LENGTH,
             tokenizer: Optional[Tokenizer] = None, formatting_func: Optional[Callable[[DataFrame], Column]] = None,
             out: str = "input_ids") -> DataFrame:
    """Token ids truncated to ``max_len`` plus an all-ones attention mask
    (no padding). ``formatting_func`` (K6) maps the DataFrame to the text
    Column to tokenise instead of ``text_col``."""
    text = formatting_func(df) if formatting_func is not None else F.col(text_col)
    if tokenizer is None:
        ids = whitespace_tokens(text, max_len)
    else:
        ids = tokenizer_udf(tokenizer)(text)
        ids = ids if max_len is None else F.slice(ids, 1, max_len)
    return df.withColumn(out, ids).withColumn("attention_mask", F.array_repeat(F.lit(1), F.size(F.col(out))))


def prepare(df: DataFrame, text_col: Optional[str] = None, formatting_func=None, packing: bool = False,
            key: Optional[str] = None, seq_length: int = PACK_SEQ_LENGTH, sep=DEFAULT_EOS,
            num_of_sequences: int = PACK_NUM_SEQUENCES, chars_per_token: float = PACK_CHARS_PER_TOKEN,
            seed: int = DEFAULT_SEED, **kw) -> DataFrame:
    """Pass already-tokenised data through; otherwise tokenise (truncated,
    non-packed) or, with ``packing``, tokenise untruncated and pack into
    constant-length chunks keyed by ``key``. A text column or a formatting
    function is required."""
    if "input_ids" in df.columns:
        return df
    if text_col is None and formatting_func is None:
        raise ValueError("You need to pass a text column or a formatting function to tokenise the dataset.")
    if not packing:
        return tokenize(df, text_col or "text", formatting_func=formatting_func, **kw)
    if key is None:
        raise ValueError("packing needs a key column that orders the samples")
    text = formatting_func(df) if formatting_func is not None else F.col(text_col)
    src = df.select(F.col(key), text.alias("_text"))
    shards = shard_count(src, "_text", seq_length, num_of_sequences, chars_per_token)
    toks = tokenize(src, "_text", max_len=None, tokenizer=kw.get("tokenizer"))
    return require_nonempty(pack(toks, key, "input_ids", seq_length, sep, shards, seed))


# ------------------------------------------------------------------- order
def order_key(key: ColumnOrName, seed: int = DEFAULT_SEED) -> Column:
    """O1: seeded, engine-independent order key ``md5(seed:key)``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), col(key).cast("string")))


def seeded_order(df: DataFrame, key: str, seed: int = DEFAULT_SEED, out: str = "order_key") -> DataFrame:
    """O1/O2: attach the seeded order key (sort by ``(order_key, key)``)."""
    return df.withColumn(out, order_key(key, seed))


def write_shuffled(df: DataFrame, key: str, path: str, seed: int = DEFAULT_SEED, ranges: Optional[int] = None) -> DataFrame:
    """O1: write the rows below ``path`` in the seeded order ``(md5(seed:key), key)``, file
    after file, and return them with ``order_key`` and ``position`` (from 0). One range
    shuffle and a sort inside each range; positions come from one count a range."""
    rows = seeded_order(df, key, seed)
    return with_positions(write_ordered(rows, [F.col("order_key"), F.col(key)], path, ranges))


def _bucket_of(okey: Column, n_buckets: int) -> Column:
    # Range bucket on the first 32 bits of the digest: monotone in the order
    # key, so bucket order + in-bucket order = global order.
    top = F.conv(F.substring(okey, 1, 8), 16, 10).cast("bigint")
    return F.floor(top * F.lit(n_buckets) / F.lit(1 << 32)).cast("int")


def global_rank(df: DataFrame, key: str, seed: int = DEFAULT_SEED, rows_per_bucket: int = 1_000_000,
                n_rows: Optional[int] = None, out: str = "rn") -> DataFrame:
    """Zero-based rank of every row in the seeded order ``(md5(seed:key), key)``
    without a single-partition window. ``key`` must be unique. Pass keys alone
    (``df.select(key)``) and join the rank back: whatever else a row holds would
    travel through the window."""
    if n_rows is None:
        n_rows = df.count()
    n_buckets = max(1, math.ceil(n_rows / rows_per_bucket))
    okey = order_key(key, seed)
    tagged = df.withColumn("_okey", okey).withColumn("_bucket", _bucket_of(F.col("_okey"), n_buckets))
    w = Window.partitionBy("_bucket").orderBy("_okey", key)
    numbered = tagged.withColumn("_in", F.row_number().over(w) - 1)
    counts = tagged.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_cnt"))
    # one row per bucket (a millionth of the rows), prefix-summed in one small window
    offsets = counts.select(
        "_bucket", (F.sum("_cnt").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
                    - F.col("_cnt")).alias("_off"))
    joined = numbered.join(offsets, "_bucket")
    return joined.withColumn(out, (F.col("_off") + F.col("_in")).cast("bigint")).drop("_okey", "_bucket", "_in", "_off")


def assign_batches(df: DataFrame, key: str, batch_size: int, seed: int = DEFAULT_SEED, drop_last: bool = False,
                   rows_per_bucket: int = 1_000_000) -> DataFrame:
    """O3: training-batch manifest ``(…, rn, batch)`` in seeded random order;
    ``drop_last`` removes the incomplete final batch."""
    n = df.count()
    ranked = global_rank(df, key, seed, rows_per_bucket, n_rows=n)
    out = ranked.withColumn("batch", F.floor(F.col("rn") / F.lit(batch_size)).cast("bigint"))
    if drop_last:
        out = out.filter(F.col("rn") < F.lit((n // batch_size) * batch_size))
    return out


# -------------------------------------------------------------------- pack
def buffer_chars(seq_length: int = PACK_SEQ_LENGTH, num_of_sequences: int = PACK_NUM_SEQUENCES,
                 chars_per_token: float = PACK_CHARS_PER_TOKEN) -> float:
    """K2: the character bound of one packing buffer."""
    return seq_length * chars_per_token * num_of_sequences


def text_chars(df: DataFrame, text_col: str) -> int:
    """Total characters of a text column (one aggregation, a scalar result)."""
    return int(df.agg(F.sum(F.length(F.col(text_col)))).first()[0] or 0)


def shard_count(df: DataFrame, text_col: str, seq_length: int = PACK_SEQ_LENGTH,
                num_of_sequences: int = PACK_NUM_SEQUENCES, chars_per_token: float = PACK_CHARS_PER_TOKEN,
                total_chars: Optional[int] = None) -> int:
    """K2: number of shards so that each holds about one buffer of text."""
    total = text_chars(df, text_col) if total_chars is None else total_chars
    return max(1, math.ceil(total / buffer_chars(seq_length, num_of_sequences, chars_per_token)))


def shard_of(key: ColumnOrName, shards: int, seed: int = DEFAULT_SEED) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:shard:"), col(key).cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(shards)).cast("int")


def _with_separator(df: DataFrame, ids_col: str, sep, append: bool) -> Column:
    ids = F.col(ids_col)
    if not append:
        return ids
    return F.concat(ids, F.array(F.lit(sep).cast(df.schema[ids_col].dataType.elementType)))


def _pieces(ids: Column, off: Column, length: Column, seq_length: int, side: int) -> Column:
    """The parts of a sample at offset ``off`` of its shard, one for each chunk that
    it touches, as structs ``(chunk_id, side, off, piece)``."""
    L = F.lit(seq_length).cast("bigint")
    none = F.array().cast("array<bigint>")
    touched = F.when(length > 0, F.sequence(F.floor(off / L), F.floor((off + length - 1) / L))).otherwise(none)

    def piece(chunk):
        lo, hi = F.greatest(chunk * L, off), F.least((chunk + 1) * L, off + length)
        return F.struct(chunk.alias("chunk_id"), F.lit(side).alias("side"), off.alias("off"),
                        F.slice(ids, (lo - off + 1).cast("int"), (hi - lo).cast("int")).alias("piece"))

    return F.transform(touched, piece)


def _joined(pieces: Column) -> Column:
    return F.flatten(F.transform(F.array_sort(pieces), lambda x: x["piece"]))


def _chunks(placed: DataFrame, seq_length: int) -> DataFrame:
    """Whole chunks of rows ``(shard, _ids, _off, _len)``."""
    pieces = placed.filter(F.col("_len") > 0).select(
        "shard", F.inline(_pieces(F.col("_ids"), F.col("_off"), F.col("_len"), seq_length, 0)))
    chunks = pieces.groupBy("shard", "chunk_id").agg(F.collect_list(F.struct("off", "piece")).alias("_p"))
    packed = chunks.select("shard", "chunk_id", _joined(F.col("_p")).alias("input_ids"))
    packed = packed.filter(F.size("input_ids") == seq_length)
    return packed.withColumn("labels", F.col("input_ids"))


def pack(df: DataFrame, key: str, ids_col: str, seq_length: int, sep, shards: Optional[int] = None, seed: int = DEFAULT_SEED,
         append_concat_token: bool = True, order: str = "seeded", shard_col: Optional[str] = None,
         buffers: str = "hash", text_col: str = "text", num_of_sequences: int = PACK_NUM_SEQUENCES,
         chars_per_token: float = PACK_CHARS_PER_TOKEN) -> DataFrame:
    """K1: constant-length packing. Each sample gets the separator appended,
    samples are concatenated per shard in seeded order (``order='key'`` keeps
    key order), cut into ``seq_length`` pieces, and the incomplete tail of
    every shard is dropped. Returns ``(shard, chunk_id, input_ids, labels)``.

    K2: ``buffers='hash'`` spreads samples over ``shards`` shards by a seeded hash (see
    ``shard_count``); ``buffers='greedy'`` fills buffers with samples in the order of
    ``key``, which must be unique, and closes each as soon as its texts (``text_col``) hold
    ``buffer_chars`` characters. Either bounds what one task holds."""
    if buffers == "greedy":
        bound = buffer_chars(seq_length, num_of_sequences, chars_per_token)
        df = df.join(greedy_buffers(df, key, F.length(text_col), bound, "_buffer"), key)
        shard = F.col("_buffer")
    elif buffers == "hash":
        shard = F.col(shard_col) if shard_col else shard_of(key, shards, seed)
    else:
        raise ValueError(f"unknown kind of buffers {buffers!r}")
    okey = order_key(key, seed) if order == "seeded" else F.lit("")
    base = df.select(shard.alias("shard"), okey.alias("_okey"), F.col(key).alias("_key"),
                     _with_separator(df, ids_col, sep, append_concat_token).alias("_ids"))
    base = base.withColumn("_len", F.size("_ids").cast("bigint"))
    w = Window.partitionBy("shard").orderBy("_okey", "_key").rowsBetween(Window.unboundedPreceding, 0)
    return _chunks(base.withColumn("_off", F.sum("_len").over(w) - F.col("_len")), seq_length)


def text_pieces(df: DataFrame, key: str, text_col: str = "text", piece_chars: int = 1 << 20) -> DataFrame:
    """``(key, part, piece, last)``: texts cut into pieces of ``piece_chars`` characters and
    what follows up to the next white space. No token of ``whitespace_tokens`` holds white
    space, so the pieces' tokens, one after the other, are the text's. A text without
    white space is one piece; an empty one is one empty piece; a null one has none."""
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(rf"(?sU).{{1,{piece_chars}}}\S*|\A\z"), F.lit(0))
    # the number of pieces in a projection of its own: no piece's row carries all of them
    cut = df.select(F.col(key), pieces.alias("_pieces")).select(key, "_pieces", F.size("_pieces").alias("_n"))
    return cut.select(key, "_n", F.posexplode("_pieces").alias("part", "piece")).select(
        key, "part", "piece", (F.col("part") == F.col("_n") - 1).alias("last"))


def pack_texts(df: DataFrame, key: str, text_col: str, seq_length: int, sep, shards: int, seed: int = DEFAULT_SEED,
               tokenizer: Optional[Tokenizer] = None, piece_chars: int = 1 << 20) -> DataFrame:
    """K1 for samples of any length: the chunks of ``pack`` over ``tokenize``, built from
    pieces. Pieces are tokenised one by one and written once; the window that places
    them reads their lengths, and the tokens meet their places in a join on (key, part).
    No row holds the tokens of more than a piece, and no window holds any. ``key`` must be
    unique. A caller's tokenizer must give the same tokens for a text cut before white
    space."""
    toks = tokenize(text_pieces(df, key, text_col, piece_chars), "piece", max_len=None, tokenizer=tokenizer, out="_ids")
    whole = _with_separator(toks, "_ids", sep, True)
    toks = toks.select(F.col(key).alias("_key"), "part", shard_of(key, shards, seed).alias("shard"),
                       F.when(F.col("last"), whole).otherwise(F.col("_ids")).alias("_ids"))
    toks = written(toks.withColumn("_len", F.size("_ids").cast("bigint")), "pieces")
    w = (Window.partitionBy("shard").orderBy("_okey", "_key", "part").rowsBetween(Window.unboundedPreceding, 0))
    places = toks.select("_key", "part", "shard", "_len", order_key("_key", seed).alias("_okey"))
    places = places.select("_key", "part", (F.sum("_len").over(w) - F.col("_len")).alias("_off"))
    return _chunks(toks.join(places, ["_key", "part"]), seq_length)


def _sample_chunks(seq_length: int, names: list[str]):
    """Fold over samples ``(shard, la, lb, a, b)`` in order of their shards, one chunk at a
    time. Only lengths are looked at: a chunk is a stretch of each side's tokens, which
    stay Arrow values and are cut by offsets."""

    def run(batches):
        import pyarrow as pa

        shard, chunk, used = None, 0, 0
        # chunks begun: shard, number, samples; and where they begin on either side
        begun, starts, rest = [], ([], []), [None, None]
        for batch in batches:
            kinds = [batch.column(k).type for k in (3, 4)]
            sides = [batch.column(k).flatten() for k in (3, 4)]
            held = [0 if r is None else len(r) for r in rest]
            sides = [s if r is None else pa.concat_arrays([r, s]) for r, s in zip(rest, sides)]
            for s, la, lb in zip(*(batch.column(k).to_pylist() for k in range(3))):
                longer = max(la, lb)
                if s != shard or used + longer > seq_length and used:
                    chunk = chunk + 1 if s == shard else 0
                    shard, used = s, 0
                for at in range(0, longer, seq_length):
                    # a long sample goes on through the next chunks, its end shares the last
                    if at:
                        chunk, used = chunk + 1, 0
                    if not used:
                        begun.append([shard, chunk, 0])
                        for k, n in enumerate((la, lb)):
                            starts[k].append(held[k] + min(at, n))
                    begun[-1][2] += 1
                    used += min(seq_length, longer - at)
                held = [held[0] + la, held[1] + lb]
            yield from packed(begun[:-1], starts, sides, kinds)
            rest = [v.slice(k[-1]) for v, k in zip(sides, starts)] if begun else [None, None]
            begun, starts = begun[-1:], tuple([0] * len(begun[-1:]) for _ in starts)
        if begun:
            yield from packed(begun, [[*k, len(r)] for k, r in zip(starts, rest)], rest, kinds)

    def packed(done, starts, sides, kinds):
        import pyarrow as pa

        if done:
            shards, chunks, samples = zip(*done)
            lists = [pa.ListArray.from_arrays(pa.array(k[:len(done) + 1], pa.int32()), v).cast(t)
                     for k, v, t in zip(starts, sides, kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(chunks, pa.int64()),
                                              pa.array(samples, pa.int64()), *lists], names=names)

    return run


def pack_pairs(df: DataFrame, key: str, plain_col: str, followup_col: str, seq_length: int, sep, shards: int,
               seed: int = DEFAULT_SEED, align: str = "chunk", part: Optional[str] = None,
               last: Optional[str] = None) -> DataFrame:
    """K3 over token arrays: both sides of a sample travel in one row, one window
    sums both lengths, and one grouping by ``(shard, chunk_id)`` builds both
    chunks: one exchange, by shard, and no join.

    ``align='chunk'`` cuts each side at its own offsets and pairs chunks by index;
    chunks beyond the shorter side drop out (J4). ``align='sample'`` cuts both
    sides at common sample boundaries: a chunk of either side holds the same
    samples, the next ones of its shard as long as they fit ``seq_length`` tokens
    of the longer side. A sample longer than that opens a chunk and goes on through
    the next ones, both sides cut at the same places; ``n_samples`` counts the
    samples with a part in the chunk. No token is dropped; a null side has none.

    A sample may come in several rows, ordered by ``part``, the one marked by
    ``last`` being the end that gets the separator (chunk alignment only)."""
    if align == "sample" and part:
        raise ValueError("samples in parts have no common boundaries of rows")

    def ids(c: str) -> Column:
        whole = _with_separator(df, c, sep, True)
        return F.when(F.col(last), whole).otherwise(F.col(c)) if last else whole

    both = df.select(shard_of(key, shards, seed).alias("shard"), order_key(key, seed).alias("_okey"), F.col(key).alias("_key"),
                     (F.col(part) if part else F.lit(0)).alias("_part"), ids(plain_col).alias("_a"),
                     ids(followup_col).alias("_b"))
    both = both.withColumn("_la", F.size("_a").cast("bigint")).withColumn("_lb", F.size("_b").cast("bigint"))
    w = Window.partitionBy("shard").orderBy("_okey", "_key", "_part").rowsBetween(Window.unboundedPreceding, 0)
    if align == "sample":
        kind = both.schema["_a"].dataType
        both = both.withColumns({c: F.coalesce(c, F.array().cast(kind)) for c in ("_a", "_b")})
        both = both.select("shard", F.size("_a").alias("_la"), F.size("_b").alias("_lb"), "_a", "_b", "_okey", "_key",
                           F.xxhash64("_a", "_b").alias("_tie"))
        placed = (both.repartition("shard").sortWithinPartitions("shard", "_okey", "_key", "_tie")
                  .select("shard", "_la", "_lb", "_a", "_b"))
        names = ["shard", "chunk_id", "n_samples", "input_ids", "input_ids_followup"]
        kind = kind.simpleString()
        out = placed.mapInArrow(_sample_chunks(seq_length, names), "shard int, chunk_id bigint, n_samples bigint, "
                                f"input_ids {kind}, input_ids_followup {kind}")
    else:
        placed = (both.withColumn("_oa", F.sum("_la").over(w) - F.col("_la"))
                  .withColumn("_ob", F.sum("_lb").over(w) - F.col("_lb")))
        pieces = placed.select("shard", F.inline(F.concat(
            _pieces(F.col("_a"), F.col("_oa"), F.col("_la"), seq_length, 0),
            _pieces(F.col("_b"), F.col("_ob"), F.col("_lb"), seq_length, 1))))
        side = lambda k: F.collect_list(F.when(F.col("side") == k, F.struct("off", "piece")))
        rows = pieces.groupBy("shard", "chunk_id").agg(side(0).alias("_pa"), side(1).alias("_pb"))
        out = rows.select("shard", "chunk_id", _joined(F.col("_pa")).alias("input_ids"),
                          _joined(F.col("_pb")).alias("input_ids_followup"))
        out = out.filter((F.size("input_ids") == seq_length) & (F.size("input_ids_followup") == seq_length))
    return out.withColumn("labels", F.col("input_ids"))


def pack_paired(df: DataFrame, key: str, text_col: str = "text", seq_length: int = PACK_SEQ_LENGTH, sep=DEFAULT_EOS,
                shards: Optional[int] = None, seed: int = DEFAULT_SEED, feedback: Optional[str] = None,
                marker: str = USER_MARKER, num_of_sequences: int = PACK_NUM_SEQUENCES,
                chars_per_token: float = PACK_CHARS_PER_TOKEN, tokenizer: Optional[Tokenizer] = None,
                align: str = "chunk", part: Optional[str] = None, last: Optional[str] = None) -> DataFrame:
    """K3: the same samples with and without the challenge (inserted after the
    marker, F7), packed by ``pack_pairs``. The shard count follows the challenged
    text length, as in the reference; ``shards`` saves that counting pass. Samples
    may come in parts (``part``, ``last``), such as the pieces of a conversation."""
    from sway.functions.constants import TRAIN_FEEDBACK

    fb = TRAIN_FEEDBACK if feedback is None else feedback
    both = df.select(F.col(key), *[F.col(c) for c in (part, last) if c], F.col(text_col).alias("_plain"),
                     add_feedback(text_col, fb, marker).alias("_followup"))
    if shards is None:
        shards = shard_count(both, "_followup", seq_length, num_of_sequences, chars_per_token)
    toks = tokenize(both, "_plain", max_len=None, tokenizer=tokenizer, out="_plain_ids")
    toks = tokenize(toks, "_followup", max_len=None, tokenizer=tokenizer, out="_followup_ids")
    return pack_pairs(toks, key, "_plain_ids", "_followup_ids", seq_length, sep, shards, seed, align, part, last)


def chunk_ids(df: DataFrame, key: str, ids_col: str, seq_length: int, shards: int, seed: int = DEFAULT_SEED,
              append_concat_token: bool = True) -> DataFrame:
    """The ``(shard, chunk_id)`` that ``pack`` would return, from the samples'
    lengths alone: a shard of n tokens has ``floor(n / seq_length)`` whole chunks."""
    length = F.size(ids_col).cast("bigint") + F.lit(1 if append_concat_token else 0)
    sizes = df.groupBy(shard_of(key, shards, seed).alias("shard")).agg(F.sum(length).alias("_n"))
    whole = F.floor(F.col("_n") / F.lit(seq_length))
    return sizes.filter(whole > 0).select("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), whole - 1)).alias("chunk_id"))


def chunk_order(packed: DataFrame, seed: int = DEFAULT_SEED, rank: bool = True,
                est_chunks: Optional[int] = None) -> DataFrame:
    """O2: the second, seeded shuffle of finished chunks: an order key per
    chunk and (optionally) its global position in that order. ``est_chunks``
    (e.g. total characters / chars-per-token / seq_length) sizes the rank
    buckets without a counting pass over the packed corpus; the rank is exact
    for any estimate."""
    keyed = packed.withColumn("chunk_key", F.concat_ws(":", F.col("shard").cast("string"),
                                                       F.col("chunk_id").cast("string")))
    keyed = keyed.withColumn("order_key", order_key("chunk_key", seed))
    return global_rank(keyed, "chunk_key", seed, n_rows=est_chunks) if rank else keyed


def require_nonempty(packed: DataFrame) -> DataFrame:
    """K5: fail like the reference when not a single chunk results."""
    if packed.isEmpty():
        raise ValueError("packing gave no chunk: the samples hold fewer tokens than one sequence")
    return packed


# ---------------------------------------------------------- split challenge
def split_challenge(ids: ColumnOrName, sep, of: ColumnOrName | None = None) -> tuple[Column, Column]:
    """K4: per row, with the first two separator positions p0 < p1:
    plain = ids without the whole span [p0..p1]; challenged = ids without just
    the two separators. Fewer than two separators leave the row unchanged. ``of``
    is an array cut at the places of ``ids``, such as its mask or labels."""
    first, second = separators(ids, sep)
    return split_at(of if of is not None else ids, first, second)


def separators(ids: ColumnOrName, sep) -> tuple[Column, Column]:
    """1-based positions of the first two separators, 0 where there is none."""
    a = col(ids)
    p0 = F.array_position(a, F.lit(sep))
    rest = F.slice(a, (p0 + 1).cast("int"), F.greatest(F.size(a) - p0, F.lit(1)).cast("int"))
    q = F.array_position(rest, F.lit(sep))
    two = (p0 > 0) & (q > 0)
    return F.when(two, p0).otherwise(0), F.when(two, p0 + q).otherwise(0)


def split_at(values: ColumnOrName, p0: ColumnOrName, p1: ColumnOrName) -> tuple[Column, Column]:
    """The plain and the challenged form of an array, cut at ``p0`` and ``p1``."""
    a, p0, p1 = col(values), col(p0), col(p1)
    head = F.slice(a, 1, F.greatest(p0 - 1, F.lit(0)).cast("int"))
    middle = F.slice(a, (p0 + 1).cast("int"), F.greatest(p1 - p0 - 1, F.lit(0)).cast("int"))
    tail = F.slice(a, (p1 + 1).cast("int"), F.greatest(F.size(a) - p1, F.lit(0)).cast("int"))
    plain = F.when(p1 > 0, F.concat(head, tail)).otherwise(a)
    return plain, F.when(p1 > 0, F.concat(head, middle, tail)).otherwise(a)


def split_challenge_rows(df: DataFrame, sep, ids_col: str = "input_ids",
                         cols: tuple[str, ...] = ("input_ids", "attention_mask", "labels")) -> DataFrame:
    """K4 over a tokenised table: ``ids``, mask and labels are cut at the same two
    separators into ``<col>`` (plain) and ``<col>_challenged``. The positions are
    computed once per row, in a projection of their own."""
    p0, p1 = separators(ids_col, sep)
    placed = df.withColumn("_p", F.struct(p0.alias("p0"), p1.alias("p1"))).withColumns(
        {"_p0": F.col("_p.p0"), "_p1": F.col("_p.p1")}).drop("_p")
    out = {}
    for c in cols:
        plain, challenged = split_at(c, "_p0", "_p1")
        out[c], out[f"{c}_challenged"] = plain, challenged
    return placed.withColumns(out).drop("_p0", "_p1")
