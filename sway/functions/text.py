"""String, array and map Column functions (all native Catalyst expressions).

Every function takes and returns ``Column`` objects so that callers can
compose them inside one projection; nothing here leaves the JVM.
"""

from __future__ import annotations

import re
import string
from typing import Union

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Union[Column, str]

# Python's str.strip() removes every character for which str.isspace() is
# true; Spark's one-argument trim() removes spaces only. The set below is that
# Python definition (control separators, NEL, NBSP and the Unicode spaces).
PY_WHITESPACE = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: ColumnOrName) -> Column:
    """Strip leading/trailing whitespace exactly like Python ``str.strip()``
    (a linear scan from both ends, no regex)."""
    return F.btrim(col(c), F.lit(PY_WHITESPACE))


def format_sent(c: ColumnOrName, end: str = ".") -> Column:
    """strip, upper-case the first character only, append ``end`` unless
    the text already ends in ``.``, ``!`` or ``?``. Empty stays empty."""
    s = py_strip(c)
    # every use of ``s`` sits in an always-evaluated position, so the strip is
    # computed once per row (subexpression elimination skips lazy branches)
    capped = F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30))
    needs_end = (F.length(s) > 0) & ~F.substring(s, -1, 1).isin(".", "!", "?")
    return F.concat(capped, F.when(needs_end, F.lit(end)).otherwise(F.lit("")))


def join_options(options: ColumnOrName) -> Column:
    """``K: V, K: V`` over a MAP in insertion order."""
    return F.array_join(
        F.transform(F.map_entries(col(options)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])),
        ", ",
    )


def join_choices(labels: ColumnOrName, texts: ColumnOrName) -> Column:
    """``L: Sentence. L: Sentence.`` from two parallel arrays."""
    return F.array_join(
        F.zip_with(col(labels), col(texts), lambda l, t: F.concat(l, F.lit(": "), format_sent(t, "."))),
        " ",
    )


def answer_from_map(options: ColumnOrName, key: ColumnOrName) -> Column:
    """F4 (map form): ``key: Sentence.`` for the gold option."""
    return format_sent(F.concat(col(key), F.lit(": "), col(options)[col(key)]), ".")


def answer_from_lists(labels: ColumnOrName, texts: ColumnOrName, key: ColumnOrName) -> Column:
    """F4 (list form): ``key: `` + formatted text of the labelled choice."""
    pos = F.array_position(col(labels), col(key))
    text = F.get(col(texts), (pos - 1).cast("int"))
    return F.concat(col(key), F.lit(": "), format_sent(text, "."))


def split_choice_answer(c: ColumnOrName) -> tuple[Column, Column]:
    """split ``"C: text"`` at the first colon into stripped (key, text).
    A value without a colon yields nulls (the reference raises)."""
    parts = F.split(col(c), ":", 2)
    return (
        F.when(F.size(parts) == 2, py_strip(F.get(parts, 0))),
        F.when(F.size(parts) == 2, py_strip(F.get(parts, 1))),
    )


def gold_number(c: ColumnOrName) -> Column:
    """the stripped text after the first ``####`` (null if absent)."""
    return py_strip(F.get(F.split(col(c), "####", 2), 1))


def slug(c: ColumnOrName) -> Column:
    """filesystem slug, spaces become underscores."""
    return F.replace(col(c), F.lit(" "), F.lit("_"))


def fill(template: str, **values: ColumnOrName) -> Column:
    """Fill ``{name}`` placeholders of a fixed template with Columns.

    Substitution happens once, so braces inside the values are kept as they
    are (the reference formats twice and breaks on braces)."""
    pieces: list[Column] = []
    for literal, field, _spec, _conv in string.Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if field is not None:
            # plain strings name columns; literals must come wrapped in F.lit
            pieces.append(col(values[field]))
    return F.concat(*pieces) if pieces else F.lit("")


def quote_regex(s: str) -> str:
    """Java-regex literal for ``s``."""
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", s)
