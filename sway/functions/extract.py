"""Answer extraction from free model text (F14-F20), as native Column
expressions.

Regex dialect notes: Java's ``.`` stops at ``\\r`` and other line separators
and ``\\s``/``\\d`` are ASCII by default; the ``(?dU)`` prefix gives the
Python semantics (``.`` excludes only ``\\n``, Unicode classes).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sway.functions.constants import (
    ALPACA_RESPONSE_MARKER,
    ANSWER_PATTERN,
    CHOICE_AFTER_MARKER,
    LEADING_CHOICE,
    NUMBER_AFTER_MARKER,
    NUMBER_AFTER_MARKER_DOT_ONLY,
    NUMBER_PATTERN,
    OPTION_HIT,
    RECALL_LETTERS,
    SPAN_AFTER_MARKER,
    START_HEADER,
)
from sway.functions.text import ColumnOrName, col, py_strip, quote_regex


def _nz(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def tail_from_last(s: ColumnOrName, pattern: str) -> Column:
    """``s[s.rfind(pattern):]``. When the pattern is absent the reference
    keeps the last character only, where no pattern can match; we return ''."""
    s = col(s)
    return F.when(F.instr(s, pattern) > 0, F.concat(F.lit(pattern), F.substring_index(s, pattern, -1))).otherwise(
        F.lit("")
    )


def response_of_alpaca(transcript: ColumnOrName) -> Column:
    """stripped text between the 1st and 2nd ``### Response:``.
    Missing marker gives '' (the reference raises, Q2)."""
    part = F.get(F.split(col(transcript), quote_regex(ALPACA_RESPONSE_MARKER), -1), 1)
    return F.coalesce(py_strip(part), F.lit(""))


def response_of_chat(transcript: ColumnOrName) -> Column:
    """F16: the third ``<|start_header_id|>`` part, stripped, from just after
    its first blank line to the end. Anything missing gives ''."""
    part = py_strip(F.get(F.split(col(transcript), quote_regex(START_HEADER), -1), 2))
    return F.coalesce(F.regexp_extract(part, r"(?s)\n\n(.*)", 1), F.lit(""))


def response_of(transcript: ColumnOrName, fmt: str) -> Column:
    if fmt == "alpaca":
        return response_of_alpaca(transcript)
    if fmt == "sharegpt":
        return response_of_chat(transcript)
    raise NotImplementedError(f"unknown corpus format {fmt!r}")


def extract_choice(response: ColumnOrName, pattern: str = ANSWER_PATTERN) -> Column:
    """option letter. (a) ``PATTERN:?\\s+([A-Z]):?`` searched from the last
    occurrence of the pattern, (b) the same with the lower-cased pattern,
    (c) a leading ``X:``, else ''."""
    r = col(response)

    def attempt(p: str) -> Column:
        return F.regexp_extract(tail_from_last(r, p), "(?U)" + p + CHOICE_AFTER_MARKER, 1)

    return F.coalesce(
        _nz(attempt(pattern)),
        _nz(attempt(pattern.lower())),
        _nz(F.regexp_extract(r, LEADING_CHOICE, 1)),
        F.lit(""),
    )


def extract_span(response: ColumnOrName, pattern: str = ANSWER_PATTERN) -> Column:
    """free span after the pattern up to the first period or line end,
    from the last occurrence; then with the lower-cased pattern."""
    r = col(response)

    def attempt(p: str) -> Column:
        return F.regexp_extract(tail_from_last(r, p), "(?dU)" + p + SPAN_AFTER_MARKER, 1)

    # a match always captures at least one character; whether it matched is
    # decided on the raw capture, and only then stripped (a whitespace-only
    # span is a match that yields '', not a reason to try the next pattern)
    return F.coalesce(py_strip(_nz(attempt(pattern))), py_strip(_nz(attempt(pattern.lower()))), F.lit(""))


def extract_number(response: ColumnOrName, pattern: str = NUMBER_PATTERN, *, dot_only_fallback: bool = False) -> Column:
    """number after the marker on the same line; the last marker first,
    else the first marker followed by a number anywhere. ``dot_only_fallback``
    reproduces the chat parser, whose fallback accepts only ``.`` separators."""
    r = col(response)
    main = "(?dU)" + pattern + NUMBER_AFTER_MARKER
    fallback = "(?dU)" + pattern + (NUMBER_AFTER_MARKER_DOT_ONLY if dot_only_fallback else NUMBER_AFTER_MARKER)
    return F.coalesce(
        _nz(F.regexp_extract(tail_from_last(r, pattern), main, 1)),
        _nz(F.regexp_extract(r, fallback, 1)),
        F.lit(""),
    )


def option_texts(options_text: ColumnOrName) -> Column:
    """All ``X: text`` hits of an options string; text stops at ``,`` or ``.``."""
    return F.regexp_extract_all(col(options_text), F.lit(OPTION_HIT), 0)


def recall_option(options_text: ColumnOrName, pred_idx: ColumnOrName, *, from_first_a: bool = False,
                  compat: bool = False) -> Column:
    """text of the previously chosen option, positional on the regex hits.

    ``from_first_a`` starts the scan at the first ``A:`` (chat layout), which
    yields '' when there is none. Letters outside A-H or beyond the list give
    ''. An empty prediction recalls nothing unless ``compat`` (then option A,
    as the reference does)."""
    s = col(options_text)
    if from_first_a:
        start = F.instr(s, "A:")
        s = F.when(start > 0, F.substring(s, start, 1 << 30))
    p = col(pred_idx)
    pos = F.instr(F.lit(RECALL_LETTERS), p)
    hit = F.get(option_texts(s), (pos - 1).cast("int"))
    valid = (pos > 0) & (F.length(p) <= 1)
    if not compat:
        valid = valid & (p != F.lit(""))
    return F.coalesce(F.when(valid, hit), F.lit(""))


def recall_by_key(options: ColumnOrName, pred_idx: ColumnOrName) -> Column:
    """F14 for structured options: the text under the predicted label of an options
    map, whole and by label instead of position; '' if there is none."""
    return F.coalesce(F.try_element_at(col(options), col(pred_idx)), F.lit(""))


_DECIMAL_RE = r"^[+-]?(\d+\.?\d*|\.\d+)$"


def _decimals(x: Column) -> Column:
    return F.when(F.instr(x, ".") > 0, F.length(F.substring_index(x, ".", -1))).otherwise(F.lit(0))


def normalise_numbers(gt: ColumnOrName, pred: ColumnOrName, attack: ColumnOrName) -> tuple[Column, Column, Column]:
    """joint canonicalisation of (gold, prediction, challenged prediction).

    Commas are dropped. When all three are non-empty decimals they are printed
    with the largest number of decimals among them; otherwise the comma-free
    strings are kept. Exotic float spellings (``1e5``, ``inf``, ``1_0``) count
    as non-numeric."""
    # (inputs should be plain columns: each is read several times below)
    a, p, q = (F.replace(col(c), F.lit(","), F.lit("")) for c in (gt, pred, attack))
    ok = a.rlike(_DECIMAL_RE) & p.rlike(_DECIMAL_RE) & q.rlike(_DECIMAL_RE)
    fmt = F.concat(F.lit("%."), F.greatest(_decimals(a), _decimals(p), _decimals(q)).cast("string"), F.lit("f"))

    def canon(x: Column) -> Column:
        return F.when(ok, F.printf(fmt, x.cast("double"))).otherwise(x)

    return canon(a), canon(p), canon(q)
