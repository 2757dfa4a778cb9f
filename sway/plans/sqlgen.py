"""DuckDB SQL fragments for the oracle queries.

These restate the operator semantics in a second dialect (RE2 regex, no
look-behind, ``string_split`` instead of ``substring_index``) so that the
oracle is an independent formulation, not a transcription of the Spark plan.
Patterns are spelled out here once more.
"""

from __future__ import annotations

# The answer grammar. As in the constants of the library but for what RE2 needs:
# white space is written out, for \s lacks the vertical tab there, and a dot that stays on
# its line is written as [^\n], for DuckDB's dot does not.
ANSWER = "The correct answer is"
NUMBER = "####"
CHOICE_TAIL = ":?[ \\t\\n\\r\\f\\v]+([A-Z]):?"
CHOICE_HEAD = "^([A-Z]):"
SPAN_TAIL = "(?:[^A-Za-z0-9]+)?[ \\t\\n\\r\\f\\v]*([^\\n]+?)(?:\\.|$)"
NUMBER_TAIL = "[^\\n]*?([+-]?\\d+(?:[,\\.]\\d+)?|\\.\\d+)"
NUMBER_TAIL_DOT = "[^\\n]*?([+-]?\\d+(?:[.\\.]\\d+)?|\\.\\d+)"
OPTION = "[A-Z]: [^,.]+"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


def format_sent(e: str, end: str = ".") -> str:
    s = strip(e)
    capped = f"(upper(substr({s}, 1, 1)) || substr({s}, 2))"
    return (f"(case when length({s}) = 0 then {s} "
            f"when right({s}, 1) in ('.', '!', '?') then {capped} "
            f"else {capped} || {lit(end)} end)")


def tail(e: str, p: str) -> str:
    return f"(case when position({lit(p)} in {e}) > 0 then {lit(p)} || string_split({e}, {lit(p)})[-1] else '' end)"


def choice(e: str, p: str = ANSWER) -> str:
    def attempt(q: str) -> str:
        return f"nullif(regexp_extract({tail(e, q)}, {lit(q + CHOICE_TAIL)}, 1), '')"

    return f"coalesce({attempt(p)}, {attempt(p.lower())}, nullif(regexp_extract({e}, {lit(CHOICE_HEAD)}, 1), ''), '')"


def span(e: str, p: str = ANSWER) -> str:
    def attempt(q: str) -> str:
        return strip(f"nullif(regexp_extract({tail(e, q)}, {lit(q + SPAN_TAIL)}, 1), '')")

    return f"coalesce({attempt(p)}, {attempt(p.lower())}, '')"


def number(e: str, p: str = NUMBER, dot_only_fallback: bool = False) -> str:
    last, any_ = lit(p + NUMBER_TAIL), lit(p + (NUMBER_TAIL_DOT if dot_only_fallback else NUMBER_TAIL))
    return f"coalesce(nullif(regexp_extract({tail(e, p)}, {last}, 1), ''), nullif(regexp_extract({e}, {any_}, 1), ''), '')"


def response_of_alpaca(e: str) -> str:
    return f"coalesce({strip(f'string_split({e}, {lit('### Response:')})[2]')}, '')"


def response_of_chat(e: str) -> str:
    part = strip(f"string_split({e}, '<|start_header_id|>')[3]")
    return (f"coalesce(case when position(chr(10) || chr(10) in {part}) > 0 "
            f"then substr({part}, position(chr(10) || chr(10) in {part}) + 2) end, '')")


def seeded_pick(key: str, n: int, seed: int) -> str:
    return f"(('0x' || substr(md5('{seed}:' || cast({key} as varchar)), 1, 8))::BIGINT % {n})"


def fill(template: str, **exprs: str) -> str:
    """A fixed template with ``{name}`` slots as a DuckDB concatenation."""
    import string as _string

    parts = []
    for literal, field, _s, _c in _string.Formatter().parse(template):
        if literal:
            parts.append(lit(literal))
        if field is not None:
            parts.append(f"({exprs[field]})")
    return "(" + " || ".join(parts) + ")"


def recall(options: str, pred: str, from_first_a: bool = False, compat: bool = False) -> str:
    src = options
    if from_first_a:
        src = f"(case when position('A:' in {options}) > 0 then substr({options}, position('A:' in {options})) end)"
    hits = f"regexp_extract_all({src}, {lit(OPTION)})"
    empty = f"when {pred} = '' then {hits}[1] " if compat else f"when {pred} = '' then '' "
    return (f"coalesce(case {empty}when length({pred}) = 1 and position({pred} in 'ABCDEFGH') > 0 "
            f"then {hits}[position({pred} in 'ABCDEFGH')] end, '')")


def user_prompt(content: str) -> str:
    return (lit("<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\n") + f" || {strip(content)} || "
            + lit("<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n"))
