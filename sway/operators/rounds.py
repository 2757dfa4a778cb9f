"""Prompt rounds and the two-round evaluation.

Everything between the two generation steps is a projection of Column
expressions. Responses either come from a recorded responses table (joined
once on the item key) or from a caller-supplied generator run batch-wise with
``mapInPandas``; generated rounds are checkpointed to the shared checkpoint
folder, because generation is expensive and not idempotent under task retry.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor, as_completed
from typing import Optional

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sway.functions.constants import BOS, DEFAULT_EOS, MAX_NEW_TOKENS, NUMBER_PATTERN, PREVIOUS_RESPONSE_LABEL
from sway.functions.extract import (
    extract_choice,
    extract_number,
    extract_span,
    recall_option,
    response_of,
)
from sway.functions.prompts import (
    challenge_prefix,
    render_alpaca,
    render_alpaca_challenge,
    render_chat,
    render_user_prompt,
    task_suffix,
    wrap_challenge,
    wrap_first_turn,
)
from sway.functions.text import gold_number, split_choice_answer
from sway.operators.scratch import scratch_path, written

CHOICE_DATASETS = ("medqa", "openbookqa")
ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _check(dataset: str, fmt: str) -> None:
    if dataset not in ("medqa", "openbookqa", "gsm8k", "squad_v2"):
        raise ValueError(f"no two-round evaluation for dataset {dataset!r}")
    if fmt not in ("alpaca", "sharegpt"):
        raise NotImplementedError(f"unknown corpus format {fmt!r}")


# ----------------------------------------------------------- training text
def training_text(corpus: DataFrame, fmt: str, eos: str = DEFAULT_EOS, out: str = "text") -> DataFrame:
    """Plain training text (Alpaca + EOS, or the chat layout)."""
    if fmt == "alpaca":
        return corpus.withColumn(out, render_alpaca("instruction", "input", "output", eos, phase="train"))
    if fmt == "sharegpt":
        return corpus.withColumn(out, render_chat("conversations"))
    raise NotImplementedError(f"unknown corpus format {fmt!r}")


def training_text_challenged(corpus: DataFrame, fmt: str, eos: str = DEFAULT_EOS, out: str = "text") -> DataFrame:
    """R2: challenge-aware training text: ``EOS + feedback + EOS`` before the
    Alpaca text, or before the first message of a conversation."""
    if fmt == "alpaca":
        return corpus.withColumn(out, wrap_challenge(render_alpaca("instruction", "input", "output", eos, "train"), eos))
    if fmt == "sharegpt":
        return corpus.withColumn(out, render_chat(wrap_first_turn("conversations", eos)))
    raise NotImplementedError(f"unknown corpus format {fmt!r}")


# ------------------------------------------------------------- round one
def question_cols(corpus: DataFrame, fmt: str) -> list[Column]:
    """Normalise a corpus to ``question, options, gold`` columns."""
    if fmt == "alpaca":
        return [F.col("instruction").alias("question"), F.col("input").alias("options"), F.col("output").alias("gold")]
    conv = F.col("conversations")
    return [conv[0]["value"].alias("question"), F.lit(None).cast("string").alias("options"),
            conv[1]["value"].alias("gold")]


def round1_prompts(corpus: DataFrame, dataset: str, fmt: str, eos: str = DEFAULT_EOS,
                   keep: Sequence[str] = ("item_id", "run")) -> DataFrame:
    """``(keep..., question, options, gold, prompt)``."""
    _check(dataset, fmt)
    base = corpus.select(*[c for c in keep if c in corpus.columns], *question_cols(corpus, fmt))
    return base.withColumn("prompt", round1_prompt(dataset, fmt, eos))


def round1_prompt(dataset: str, fmt: str, eos: str = DEFAULT_EOS) -> Column:
    """The round-1 prompt from ``question, options``."""
    suffix = F.lit("\n\n" + task_suffix(dataset))
    if fmt == "alpaca":
        return render_alpaca("question", F.concat(F.col("options"), suffix), F.lit(""), eos, phase="infer")
    return render_user_prompt(F.concat(F.col("question"), suffix))


def transcript(prompt: ColumnLike, response: ColumnLike, fmt: str) -> Column:
    """Decoded generation: the prompt (Alpaca prompts get the BOS the tokenizer
    adds; chat prompts carry it already) followed by the response."""
    resp = F.coalesce(_c(response), F.lit(""))
    if fmt == "alpaca":
        return F.concat(F.lit(BOS), _c(prompt), resp)
    return F.concat(_c(prompt), resp)


def parse_answer(text: ColumnLike, dataset: str, fmt: str, compat: bool = False) -> Column:
    """Parse a decoded transcript into the dataset's prediction (Column
    form; ``with_parsed`` is the cheaper DataFrame form for wide tables)."""
    return extractor(dataset, fmt, compat)(response_of(text, fmt))


def extractor(dataset: str, fmt: str, compat: bool = False):
    """The extraction function (response Column -> prediction) of a dataset."""
    if dataset in CHOICE_DATASETS:
        return extract_choice
    if dataset == "gsm8k":
        return lambda r: extract_number(r, NUMBER_PATTERN, dot_only_fallback=(compat and fmt == "sharegpt"))
    if dataset == "squad_v2":
        return extract_span
    raise ValueError(f"no answer parser for dataset {dataset!r}")


def with_parsed(df: DataFrame, text_col: str, dataset: str, fmt: str, out: str, compat: bool = False) -> DataFrame:
    """R5 as a DataFrame step: the response section is materialised in its own
    projection first (Spark keeps a non-trivial expression that is read several
    times in a separate projection), so it is computed once per row although
    the extraction cascade reads it up to four times."""
    tmp = f"_{out}_response"
    return (df.withColumn(tmp, response_of(text_col, fmt))
            .withColumn(out, extractor(dataset, fmt, compat)(F.col(tmp))).drop(tmp))


# ------------------------------------------------------------- round two
def previous_response(df: DataFrame, dataset: str, fmt: str, pred: str = "pred", compat: bool = False) -> Column:
    """The "previous response" text quoted back in the challenge."""
    suffix = task_suffix(dataset)
    if dataset == "gsm8k":
        if fmt == "alpaca":
            return F.concat(F.col(pred), F.lit("\n\n" + suffix))
        return F.col(pred)
    if fmt == "alpaca":
        recalled = recall_option("options", pred, compat=compat)
        return F.when(recalled != "", F.concat(recalled, F.lit("\n\n" + suffix))).otherwise(F.lit(""))
    return recall_option("question", pred, from_first_a=True, compat=compat)


def round2_prompt(df: DataFrame, dataset: str, fmt: str, identity=None, seed: int = 3407, eos: str = DEFAULT_EOS,
                  pred: str = "pred", compat: bool = False, key: str = "item_id") -> Column:
    """The challenge prompt from the round-1 prediction."""
    _check(dataset, fmt)
    if dataset == "squad_v2":
        raise NotImplementedError("span QA has no second round")
    prefix = challenge_prefix(identity, dataset, key, seed)
    prev = previous_response(df, dataset, fmt, pred, compat)
    if fmt == "alpaca":
        return F.concat(prefix, F.lit("\n"), render_alpaca_challenge("question", "options", prev, eos))
    content = F.concat(prefix, F.lit("\n\n"), F.col("question"), F.lit("\n\n" + PREVIOUS_RESPONSE_LABEL), prev,
                       F.lit("\n\n" + task_suffix(dataset)))
    return render_user_prompt(content)


# ------------------------------------------------------------ records
def prediction_records(df: DataFrame, dataset: str, fmt: str, keep: Sequence[str] = ("item_id", "run")) -> DataFrame:
    """One prediction record per item in the reference's field names,
    from ``question, options, gold, pred_str, attack_pred_str, pred, attack_pred``."""
    k = [c for c in keep if c in df.columns]
    if dataset in CHOICE_DATASETS:
        idx, ans = split_choice_answer("gold")
        cols = [F.col("question")]
        if fmt == "alpaca":
            cols.append(F.col("options"))
        return df.select(*k, *cols, ans.alias("answer"), idx.alias("answer_idx"), "pred_str", "attack_pred_str",
                         F.col("pred").alias("pred_idx"), F.col("attack_pred").alias("attack_pred_idx"))
    if dataset == "gsm8k":
        return df.select(*k, "question", F.col("gold").alias("answer"), gold_number("gold").alias("answer_val"),
                         "pred_str", "attack_pred_str", F.col("pred").alias("pred_val"),
                         F.col("attack_pred").alias("attack_pred_val"))
    raise ValueError(f"no answer parser for dataset {dataset!r}")


def span_records(df: DataFrame, fmt: str, keep: Sequence[str] = ("item_id", "run")) -> DataFrame:
    """Single-round span QA records."""
    k = [c for c in keep if c in df.columns]
    cols = [F.col("question")]
    if fmt == "alpaca":
        cols.append(F.col("options").alias("context"))
    return df.select(*k, *cols, "pred_str", F.col("gold").alias("answer"), F.col("pred").alias("pred_ans"))


# ------------------------------------------------------------ generation
Generator = Callable[[list[str]], list[str]]


def generate(prompts: DataFrame, fn: Generator, prompt_col: str = "prompt", out: str = "response",
             max_new_tokens: int = MAX_NEW_TOKENS, batch_size: int = 64) -> DataFrame:
    """Run a caller-supplied generator over the prompt column, batch-wise
    in Python workers (Arrow transfer). ``fn(list_of_prompts, max_new_tokens)``
    or ``fn(list_of_prompts)`` returns the generated texts."""
    # a new StructType: DataFrame.schema is cached and .add() would mutate it
    schema = T.StructType([*prompts.schema.fields, T.StructField(out, T.StringType())])

    import inspect

    try:
        params = inspect.signature(fn).parameters.values()
        takes_limit = sum(p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD) for p in params) >= 2 or any(
            p.kind == p.VAR_POSITIONAL for p in params)
    except (TypeError, ValueError):  # builtins without a signature
        takes_limit = False

    def call(batch: list[str]) -> list[str]:
        out = list(fn(batch, max_new_tokens) if takes_limit else fn(batch))
        if len(out) != len(batch):
            raise ValueError(f"generator returned {len(out)} texts for {len(batch)} prompts")
        return out

    def run(it):
        for pdf in it:
            outs: list[str] = []
            texts = pdf[prompt_col].fillna("").tolist()
            for i in range(0, len(texts), batch_size):
                outs.extend(call(texts[i:i + batch_size]))
            yield pdf.assign(**{out: pd.Series(outs, index=pdf.index, dtype=object)})

    return prompts.mapInPandas(run, schema)


#: batches of a resumed generation that run at the same time
BATCHES_AT_ONCE = 4


def resume_generation(prompts: DataFrame, fn: Generator, store: str, keys: Sequence[str] = ("run", "item_id"),
                      round_no: int = 1, prompt_col: str = "prompt", out: str = "response",
                      max_new_tokens: int = MAX_NEW_TOKENS, rows_per_batch: int = 100_000) -> DataFrame:
    """R4 that can be stopped and started again: ``prompts`` with ``out``, null where the
    generator gave none.

    Responses are added to the Parquet files below ``store`` under their item's ``keys``, the
    round and the digest of the prompt, batch after batch, each in a folder of its own (read
    them with ``recursiveFileLookup``). A start generates only the prompts that the store
    doesn't hold; a prompt that changed is another one. The missing prompts are written once,
    dealt into batches by a hash of their keys, and every batch is a job of its own; a few run
    at the same time. One that fails, or a lost executor, costs that batch alone: those that
    run beside it are finished and kept, later ones are not begun.
    ``keys`` must identify a prompt of the round; null keys are values like others."""
    spark = prompts.sparkSession
    digest = F.md5(F.coalesce(F.col(prompt_col), F.lit("")))
    asked = prompts.select(*keys, digest.alias("prompt_md5"), F.col(prompt_col).alias("_prompt"))
    columns = [*keys, "prompt_md5", "response"]
    kind = T.StructType([*[prompts.schema[k] for k in keys], T.StructField("prompt_md5", T.StringType()),
                         T.StructField("response", T.StringType())])
    path = f"{store.rstrip('/')}/round={round_no}"
    spark.createDataFrame([], kind).write.mode("append").parquet(f"{path}/batch=none")

    def stored():
        # a batch that was stopped while it was committed may be there twice
        return (spark.read.schema(kind).option("recursiveFileLookup", "true").parquet(path)
                .dropDuplicates([*keys, "prompt_md5"]))

    def same(left, right):
        on = F.lit(True)
        for k in (*keys, "prompt_md5"):
            on = on & left[k].eqNullSafe(right[k])
        return on

    done = stored()
    missing = asked.join(done, same(asked, done), "left_anti")
    missing = written(missing.withColumn("_hash", F.xxhash64(*keys, "prompt_md5")), "missing")
    batches = max(1, math.ceil(missing.count() / rows_per_batch))
    pieces = math.ceil(spark.sparkContext.defaultParallelism / 2)
    batch = F.pmod("_hash", F.lit(batches)).alias("_batch")
    numbers = sorted(r[0] for r in missing.select(batch).distinct().collect())
    # a batch is read as so many files, however many tasks write them
    dealt, start = scratch_path(spark, "batches"), uuid.uuid4().hex
    piece = F.pmod(F.shiftright("_hash", 32), F.lit(pieces)).alias("_piece")
    missing.select("*", batch, piece).repartition("_batch", "_piece").write.partitionBy("_batch", "_piece").parquet(dealt)

    def run(b):
        part = spark.read.schema(missing.schema).parquet(f"{dealt}/_batch={b}").select(*missing.columns)
        got = generate(part, fn, "_prompt", "response", max_new_tokens).select(*columns)
        # jobs that run at the same time can't commit to one folder
        got.write.mode("append").parquet(f"{path}/batch={start}-{b}")

    with ThreadPoolExecutor(BATCHES_AT_ONCE) as pool:
        runs = [pool.submit(inheritable_thread_target(spark)(run), b) for b in numbers]
        try:
            for r in as_completed(runs):
                r.result()
        finally:
            for r in runs:
                r.cancel()
    done = stored().select(*[F.col(c).alias(f"_{c}") for c in columns])
    on = digest.eqNullSafe(F.col("_prompt_md5"))
    for k in keys:
        on = on & prompts[k].eqNullSafe(F.col(f"_{k}"))
    return prompts.join(done, on, "left").withColumn(out, F.col("_response")).drop(*[f"_{c}" for c in columns])


def pair_rounds(responses: DataFrame, keys: Sequence[str] = ("run", "item_id"), round_col: str = "round",
                text_col: str = "response") -> DataFrame:
    """One row per item with ``response_1`` and ``response_2`` by a single
    aggregation on the item key (for callers that want the wide form)."""
    return responses.groupBy(*keys).agg(
        F.max(F.when(F.col(round_col) == 1, F.col(text_col))).alias("response_1"),
        F.max(F.when(F.col(round_col) == 2, F.col(text_col))).alias("response_2"),
    )


def attach_responses(df: DataFrame, responses: DataFrame, round_no: int, keys: Sequence[str],
                     round_col: str = "round", text_col: str = "response", out: Optional[str] = None) -> DataFrame:
    """Left equi-join of prompts with the responses of one round
    (``keys`` must identify one response per round). The round filter is
    pushed into the responses scan; after the first round the items are
    already partitioned on the keys, so the second round only shuffles its
    own responses. Prompts are better rendered after the joins than shuffled."""
    r = responses.filter(F.col(round_col) == round_no).select(*keys, F.col(text_col).alias(out or f"response_{round_no}"))
    return df.join(r, on=list(keys), how="left")


def two_round(corpus: DataFrame, dataset: str, fmt: str, *, responses: Optional[DataFrame] = None,
              generator: Optional[Generator] = None, identity=None, seed: int = 3407, eos: str = DEFAULT_EOS,
              keys: Sequence[str] = ("run", "item_id"), compat: bool = False,
              max_new_tokens: int = MAX_NEW_TOKENS, store: Optional[str] = None) -> DataFrame:
    """Round-1 prompt -> response -> parse -> challenge prompt -> response
    -> parse -> prediction records.

    With ``responses`` (``keys..., round, response``) each round is attached
    by a left join (J2) to the items, before any prompt is rendered, so no rendered
    text is shuffled; items without a response parse as ''. With a
    ``generator`` each round is generated and checkpointed before use; with a ``store``
    besides, responses are kept there and a stopped run goes on where it was."""
    _check(dataset, fmt)

    def generated(df, prompt, out, round_no):
        if store:
            return resume_generation(df, generator, store, keys, round_no, prompt, out, max_new_tokens)
        return generate(df, generator, prompt, out, max_new_tokens).checkpoint(eager=True)

    keep = list(keys)
    r1 = round1_prompts(corpus, dataset, fmt, eos, keep=keep)
    if responses is not None:
        df = attach_responses(r1.drop("prompt"), responses, 1, keys)
        if dataset != "squad_v2":
            df = attach_responses(df, responses, 2, keys)
        df = df.withColumn("prompt", round1_prompt(dataset, fmt, eos))
    elif generator is not None:
        from sway.session import ensure_checkpoint_dir

        ensure_checkpoint_dir(corpus.sparkSession)  # reliable checkpoints go to the shared folder
        df = generated(r1, "prompt", "response_1", 1)
    else:
        raise ValueError("two_round needs recorded responses or a generator")
    df = df.withColumn("pred_str", transcript("prompt", "response_1", fmt))
    df = with_parsed(df, "pred_str", dataset, fmt, "pred", compat)
    if dataset == "squad_v2":
        return span_records(df, fmt, keep)
    df = df.withColumn("prompt2", round2_prompt(df, dataset, fmt, identity, seed, eos, "pred", compat, keys[-1]))
    if responses is None:
        df = generated(df, "prompt2", "response_2", 2)
    df = df.withColumn("attack_pred_str", transcript("prompt2", "response_2", fmt))
    df = with_parsed(df, "attack_pred_str", dataset, fmt, "attack_pred", compat)
    return prediction_records(df, dataset, fmt, keep)


def attach_gold(preds: DataFrame, items: DataFrame, keys: Sequence[str] = ("run", "item_id"),
                gold: str = "answer_idx") -> DataFrame:
    """Predictions joined 1:1 with the gold of their item (inner equi-join
    on the item key; AQE picks broadcast or sort-merge at run time)."""
    return preds.join(items.select(*keys, F.col(gold).alias("gt")), on=list(keys), how="inner")


def assert_aligned(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present on only one side, as ``(keys..., side)`` rows — one
    full outer join (each side scanned and shuffled once)."""
    k = list(keys)
    both = left.select(*k, F.lit(True).alias("_l")).join(right.select(*k, F.lit(True).alias("_r")), on=k,
                                                          how="full_outer")
    side = F.when(F.col("_r").isNull(), F.lit("left_only")).when(F.col("_l").isNull(), F.lit("right_only"))
    return both.select(*k, side.alias("side")).filter(F.col("side").isNotNull())


def duplicate_responses(responses: DataFrame, keys: Sequence[str], round_col: str = "round") -> DataFrame:
    """J2 guard: ``(keys..., round, n)`` that have more than one response; such a
    table would multiply items in ``attach_responses``."""
    return responses.groupBy(*keys, round_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def unmatched_prompts(prompts: DataFrame, responses: DataFrame, keys: Sequence[str], round_col: str = "round") -> DataFrame:
    """The number of prompts without a response, ``(round, n)``, for both rounds."""
    rounds = prompts.select(*keys, F.explode(F.array(F.lit(1), F.lit(2))).alias(round_col))
    known = responses.select(*keys, F.col(round_col).cast("int").alias(round_col))
    return rounds.join(known, [*keys, round_col], "left_anti").groupBy(round_col).agg(F.count(F.lit(1)).alias("n"))


def with_item_key(df: DataFrame, cols: Sequence[str], out: str = "item_id") -> DataFrame:
    """A key for records without one: the md5 of the fields ``cols``; the second
    and later records with equal fields get their number appended, so a key names
    one record."""
    from pyspark.sql import Window

    content = F.md5(F.to_json(F.struct(*cols)))
    # records of one content are interchangeable, so any order numbers them alike
    number = F.row_number().over(Window.partitionBy("_content").orderBy("_content")) - 1
    keyed = df.withColumn("_content", content).withColumn("_number", number)
    key = F.when(F.col("_number") == 0, F.col("_content")).otherwise(F.concat_ws(":", "_content", F.col("_number").cast("string")))
    return keyed.withColumn(out, key).drop("_content", "_number")


def choice_results(records: DataFrame, run_col: str = "run") -> DataFrame:
    """SRC6: ``answer_idx, pred_idx, attack_pred_idx`` -> ``gt, pred, attack_pred``."""
    return records.select(F.col(run_col).alias("run"), F.col("answer_idx").alias("gt"),
                          F.col("pred_idx").alias("pred"), F.col("attack_pred_idx").alias("attack_pred"))


def numeric_results(records: DataFrame, keep: Sequence[str] = ("run",)) -> DataFrame:
    """SRC7: ``answer_val, pred_val, attack_pred_val`` -> canonical ``gt, pred,
    attack_pred`` (F20). The values should be plain columns: each is read often."""
    from sway.functions.extract import normalise_numbers

    g, p, a = normalise_numbers("answer_val", "pred_val", "attack_pred_val")
    return records.select(*keep, g.alias("gt"), p.alias("pred"), a.alias("attack_pred"))


NUMERIC_DATASETS = ("gsm8k",)


def judged_results(results: DataFrame) -> DataFrame:
    """Result records of any dataset -> ``(run, dataset, gt, pred, attack_pred,
    reject)``. ``reject`` says why a record can't be scored: its dataset has no
    two-round score, its gold answer or one of its predictions is missing. It is
    null for the others. An unparsed answer is the empty prediction, not a missing
    one. The run is the result file (or the folder of a Spark-written one)."""
    from sway.functions.extract import normalise_numbers
    from sway.functions.paths import dataset_of

    run = F.regexp_replace("path", r"/part-[^/]*$", "")
    named = F.col("dataset") if "dataset" in results.columns else F.lit(None).cast("string")
    dataset = dataset_of(F.coalesce(named, run))
    numeric, choice = F.col("dataset").isin(*NUMERIC_DATASETS), F.col("dataset").isin(*CHOICE_DATASETS)
    base = results.withColumn("dataset", dataset)
    values = [F.when(numeric, F.col(f"{c}_val")).when(choice, F.col(f"{c}_idx")).alias(name)
              for c, name in (("answer", "a"), ("pred", "p"), ("attack_pred", "q"))]
    # a generator of one row: what stands before it is computed once, however
    # often the expressions after it read the values
    base = base.select(run.alias("run"), "dataset", F.inline(F.array(F.struct(*values))))
    canonical = [F.when(numeric, n).otherwise(F.col(c)).alias(name)
                 for n, c, name in zip(normalise_numbers("a", "p", "q"), "apq", ("gt", "pred", "attack_pred"))]
    scored = base.select("run", "dataset", F.inline(F.array(F.struct(*canonical))))
    known = F.col("dataset").isin(*NUMERIC_DATASETS, *CHOICE_DATASETS)
    reason = (F.when(~known, "unknown dataset").when(F.col("gt").isNull(), "missing gold")
              .when(F.col("pred").isNull() | F.col("attack_pred").isNull(), "missing prediction"))
    return scored.withColumn("reject", reason)


def result_outcomes(results: DataFrame) -> DataFrame:
    """The records that can be scored: ``(run, dataset, gt, pred, attack_pred)``."""
    return judged_results(results).filter("reject is null").drop("reject")


def outcome_rejects(results: DataFrame) -> DataFrame:
    """``(run, dataset, reason, n)``: records that are left out of the score, and
    ``unparsed answer``: records that are scored with an empty prediction."""
    judged = judged_results(results)
    unparsed = F.when((F.col("pred") == "") | (F.col("attack_pred") == ""), F.lit("unparsed answer"))
    return (judged.select("run", "dataset", F.coalesce("reject", unparsed).alias("reason")).filter("reason is not null")
            .groupBy("run", "dataset", "reason").agg(F.count(F.lit(1)).alias("n")))
