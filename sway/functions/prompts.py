"""Prompt and transcript rendering (F7-F13) as native Column expressions."""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sway.functions.constants import (
    ALPACA_CHALLENGE,
    ALPACA_INFER,
    ALPACA_TRAIN,
    BOS,
    CHALLENGE,
    CHALLENGE_WITH_IDENTITY,
    DEFAULT_EOS,
    END_HEADER,
    EOT,
    IDENTITY_POOLS,
    SHAREGPT_TO_ROLE,
    START_HEADER,
    TASK_SUFFIX,
    TRAIN_FEEDBACK,
    USER_MARKER,
)
from sway.functions.text import ColumnOrName, col, fill, py_strip


def add_feedback(text: ColumnOrName, feedback: str = TRAIN_FEEDBACK, marker: str = USER_MARKER) -> Column:
    """insert ``feedback`` right after every occurrence of ``marker``
    (non-overlapping, left to right, inserted text is not re-scanned)."""
    return F.replace(col(text), F.lit(marker), F.lit(marker + feedback))


def render_alpaca(instruction: ColumnOrName, input_: ColumnOrName, response: ColumnOrName,
                  eos: Optional[str] = DEFAULT_EOS, phase: str = "train") -> Column:
    """F8: Alpaca prompt; ``phase`` picks the exact whitespace of the training
    (11-space) or inference (12-space) template. ``eos`` is appended."""
    template = {"train": ALPACA_TRAIN, "infer": ALPACA_INFER}[phase]
    body = fill(template, instruction=instruction, input=input_, response=response)
    return F.concat(body, F.lit(eos)) if eos else body


def render_alpaca_challenge(instruction: ColumnOrName, input_: ColumnOrName, previous_response: ColumnOrName,
                            eos: Optional[str] = DEFAULT_EOS) -> Column:
    """Alpaca challenge prompt with the "Your previous response" section."""
    body = fill(ALPACA_CHALLENGE, instruction=instruction, input=input_, previous_response=previous_response,
                response=F.lit(""))
    return F.concat(body, F.lit(eos)) if eos else body


def _turn(role: Column, content: Column) -> Column:
    return F.concat(F.lit(START_HEADER), role, F.lit(END_HEADER + "\n\n"), py_strip(content), F.lit(EOT))


def render_chat(conversations: ColumnOrName, add_generation_prompt: bool = False) -> Column:
    """llama-3 chat layout of a ShareGPT ``ARRAY<STRUCT<from, value>>``.
    ShareGPT roles map back to chat roles (human->user, gpt->assistant);
    message contents are stripped like the template's ``trim`` filter."""
    roles = F.create_map(*[F.lit(x) for kv in SHAREGPT_TO_ROLE.items() for x in kv])

    def one(m: Column) -> Column:
        return _turn(F.coalesce(F.element_at(roles, m["from"]), m["from"]), m["value"])

    out = F.concat(F.lit(BOS), F.array_join(F.transform(col(conversations), one), ""))
    if add_generation_prompt:
        out = F.concat(out, F.lit(START_HEADER + "assistant" + END_HEADER + "\n\n"))
    return out


def render_user_prompt(content: ColumnOrName) -> Column:
    """Chat transcript of a single user message plus the generation prompt."""
    return F.concat(
        F.lit(BOS), _turn(F.lit("user"), col(content)), F.lit(START_HEADER + "assistant" + END_HEADER + "\n\n")
    )


def wrap_challenge(text: ColumnOrName, eos: str = DEFAULT_EOS, feedback: str = TRAIN_FEEDBACK) -> Column:
    """``EOS + feedback + EOS + text`` (training-time challenge prefix)."""
    return F.concat(F.lit(eos + feedback + eos), col(text))


def wrap_first_turn(conversations: ColumnOrName, eos: str = DEFAULT_EOS, feedback: str = TRAIN_FEEDBACK) -> Column:
    """F11 for ShareGPT: prefix only the first message's value."""
    return F.transform(
        col(conversations),
        lambda m, i: F.when(i == 0, m.withField("value", wrap_challenge(m["value"], eos, feedback))).otherwise(m),
    )


def task_suffix(dataset: str) -> str:
    """the task instruction appended to each question."""
    try:
        return TASK_SUFFIX[dataset]
    except KeyError:
        raise ValueError(f"no task suffix for dataset {dataset!r}") from None


def seeded_pick(key: ColumnOrName, n: int, seed: int) -> Column:
    """Deterministic choice in ``[0, n)`` from ``md5(seed:key)``; identical
    in Spark and DuckDB."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), col(key).cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(n))


def challenge_prefix(identity: Optional[str | Sequence[str]] = None, dataset: Optional[str] = None,
                     item_id: ColumnOrName = "item_id", seed: int = 3407) -> Column:
    """the challenger's opening sentence.

    ``identity`` None / '' / [] -> no identity; a list is joined with spaces;
    ``'random'`` -> a seeded choice from the dataset's pool per item."""
    if isinstance(identity, (list, tuple)):
        identity = " ".join(identity)
    if not identity:
        return F.lit(CHALLENGE)
    if identity == "random":
        if dataset not in IDENTITY_POOLS:
            raise ValueError(f"Dataset {dataset} has no identity pool.")
        pool = IDENTITY_POOLS[dataset]
        who = F.get(F.array(*[F.lit(x) for x in pool]), seeded_pick(item_id, len(pool), seed).cast("int"))
        head, tail = CHALLENGE_WITH_IDENTITY.split("{identity}")
        return F.concat(F.lit(head), who, F.lit(tail))
    return F.lit(CHALLENGE_WITH_IDENTITY.format(identity=identity))
