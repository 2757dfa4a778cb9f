"""Raw QA records -> instruction corpora.

Each operator is a single projection (one narrow stage, no shuffle); the
integrity checks split a table into ``(valid, rejects)`` instead of aborting
the whole run on the first bad record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sway.functions.constants import USER_MARKER
from sway.functions.text import answer_from_lists, answer_from_map, format_sent, join_choices, join_options


class IntegrityError(ValueError):
    pass


def _sharegpt(human: Column, gpt: Column) -> Column:
    return F.array(
        F.struct(F.lit("human").alias("from"), human.alias("value")),
        F.struct(F.lit("gpt").alias("from"), gpt.alias("value")),
    )


def _keep(df: DataFrame, keep):
    return [c for c in keep if c in df.columns]


# ------------------------------------------------------------ options as a map
def choice_map_to_alpaca(df: DataFrame, keep=("item_id", "run")) -> DataFrame:
    """``question, answer, options MAP, answer_idx`` -> Alpaca row."""
    return df.select(
        *_keep(df, keep),
        format_sent("question", "?").alias("instruction"),
        format_sent(join_options("options"), ".").alias("input"),
        answer_from_map("options", "answer_idx").alias("output"),
    )


def choice_map_to_sharegpt(df: DataFrame, keep=("item_id", "run")) -> DataFrame:
    """Same record -> ShareGPT conversation (question + options, answer)."""
    human = F.concat(format_sent("question", "?"), F.lit(" "), format_sent(join_options("options"), "."))
    return df.select(*_keep(df, keep), _sharegpt(human, answer_from_map("options", "answer_idx")).alias("conversations"))


def check_choice_map(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``options[answer_idx] == answer``; returns (valid, rejects). A record without a
    question, a key or an answer is a reject."""
    ok = F.coalesce((F.col("options")[F.col("answer_idx")] == F.col("answer")) & F.col("question").isNotNull(), F.lit(False))
    return df.filter(ok), df.filter(~ok)


# -------------------------------------------------- options as parallel lists
def choice_lists_to_alpaca(df: DataFrame, keep=("item_id", "run")) -> DataFrame:
    """``fact1, question_stem, choices{text,label}, answerKey`` -> Alpaca."""
    return df.select(
        *_keep(df, keep),
        F.concat(format_sent("fact1", "."), F.lit(" "), format_sent("question_stem", "?")).alias("instruction"),
        join_choices("choices.label", "choices.text").alias("input"),
        answer_from_lists("choices.label", "choices.text", "answerKey").alias("output"),
    )


def choice_lists_to_sharegpt(df: DataFrame, keep=("item_id", "run")) -> DataFrame:
    """Same record -> ShareGPT conversation."""
    human = F.concat(format_sent("fact1", "."), F.lit(" "), format_sent("question_stem", "?"), F.lit(" "),
                     join_choices("choices.label", "choices.text"))
    gpt = answer_from_lists("choices.label", "choices.text", "answerKey")
    return df.select(*_keep(df, keep), _sharegpt(human, gpt).alias("conversations"))


def check_choice_lists(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The answer key must be one of the labels, and fact, question and choices there."""
    asked = F.col("fact1").isNotNull() & F.col("question_stem").isNotNull() & F.col("choices.text").isNotNull()
    ok = F.coalesce((F.array_position("choices.label", F.col("answerKey")) > 0) & asked, F.lit(False))
    return df.filter(ok), df.filter(~ok)


# ---------------------------------------------------------- numeric answers
def check_numeric(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Question and answer must be there; returns (valid, rejects)."""
    ok = F.col("question").isNotNull() & F.col("answer").isNotNull()
    return df.filter(ok), df.filter(~ok)


def numeric_to_alpaca(df: DataFrame, keep=("item_id", "run")) -> DataFrame:
    """P5: ``question, answer`` -> Alpaca with empty input, answer verbatim."""
    return df.select(*_keep(df, keep), format_sent("question", "?").alias("instruction"),
                     F.lit("").alias("input"), F.col("answer").alias("output"))


def numeric_to_sharegpt(df: DataFrame, keep=("item_id", "run")) -> DataFrame:
    """P6."""
    return df.select(*_keep(df, keep), _sharegpt(format_sent("question", "?"), F.col("answer")).alias("conversations"))


_FORMATTERS = {
    ("medqa", "alpaca"): (check_choice_map, choice_map_to_alpaca),
    ("medqa", "sharegpt"): (check_choice_map, choice_map_to_sharegpt),
    ("openbookqa", "alpaca"): (check_choice_lists, choice_lists_to_alpaca),
    ("openbookqa", "sharegpt"): (check_choice_lists, choice_lists_to_sharegpt),
    ("gsm8k", "alpaca"): (check_numeric, numeric_to_alpaca),
    ("gsm8k", "sharegpt"): (check_numeric, numeric_to_sharegpt),
}


def reformat(df: DataFrame, dataset: str, fmt: str, strict: bool = False,
             keep=("item_id", "run")) -> tuple[DataFrame, DataFrame]:
    """Dataset x format dispatch. Returns (corpus, rejects). ``strict``
    raises like the reference when any record fails its integrity check
    (this runs one extra count job)."""
    if dataset not in ("medqa", "openbookqa", "gsm8k"):
        raise ValueError(f"no formatter for dataset {dataset!r}")
    if fmt not in ("alpaca", "sharegpt"):
        raise NotImplementedError(f"unknown corpus format {fmt!r}")
    check, to_corpus = _FORMATTERS[(dataset, fmt)]
    df, rejects = check(df)
    if strict and not rejects.isEmpty():
        raise IntegrityError(f"{dataset}: records whose answer does not match the keyed option, or that lack a part")
    return to_corpus(df, keep=keep), rejects


def missing_marker(df: DataFrame, text_col: str = "text", marker: str = USER_MARKER) -> DataFrame:
    """Rows where the challenge cannot be inserted (marker absent)."""
    return df.filter(~F.coalesce(F.instr(F.col(text_col), marker) > 0, F.lit(False)))


def missing_marker_pieces(pieces: DataFrame, key: str = "conv_id", piece: str = "piece",
                          marker: str = USER_MARKER) -> DataFrame:
    """P11 over rendered pieces (one per turn): conversations without the marker
    and the length of their text, ``(key, n_chars)``, by sums alone. The marker can't
    lie across two pieces: it begins with the text's first token, which a piece
    holds whole, and every piece ends with an end-of-turn token."""
    has = F.coalesce(F.instr(F.col(piece), marker) > 0, F.lit(False))
    return (pieces.groupBy(key).agg(F.sum(F.length(piece)).cast("int").alias("n_chars"), F.bool_or(has).alias("_has"))
            .filter("not _has").drop("_has"))
