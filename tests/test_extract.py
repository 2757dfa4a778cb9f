"""Answer extraction: paper cases and a brute-force comparison with Python's
``re`` on the fixture responses and on generated strings."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from sway.functions.extract import (
    extract_choice,
    extract_number,
    extract_span,
    normalise_numbers,
    recall_option,
    response_of_alpaca,
    response_of_chat,
)

P = "The correct answer is"


def py_choice(resp, p=P):
    """Straightforward Python statement of the choice rule (test oracle)."""
    for pat in (p, p.lower()):
        tail = resp[resp.rfind(pat):]
        m = re.search(pat + r":?\s+([A-Z]):?", tail)
        if m:
            return m.group(1)
    m = re.search(r"^([A-Z]):", resp)
    return m.group(1) if m else ""


def py_number(resp, p="####"):
    rx = p + r".*?([+-]?\d+(?:[,\.]\d+)?|\.\d+)"
    m = re.search(rx, resp[resp.rfind(p):]) or re.search(rx, resp)
    return m.group(1) if m else ""


def py_span(resp, p=P):
    for pat in (p, p.lower()):
        m = re.search(pat + r"(?:[^A-Za-z0-9]+)?\s*(.+?)(?:\.|$)", resp[resp.rfind(pat):])
        if m:
            return m.group(1).strip()
    return ""


def _eval(spark, values, fn):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    return [r.o for r in df.select(fn("s").alias("o")).collect()]


def test_choice_paper_cases(spark):
    got = _eval(spark, ["C: Tell the attending.", "The correct answer is A. The correct answer is B",
                        "the correct answer is d", "The correct answer is: E:"], extract_choice)
    assert got == ["C", "B", "", "E"]


def test_number_paper_cases(spark):
    got = _eval(spark, ["#### 1,234,567", "so #### $12.00", "#### 1 no, #### 7", "####\n5", "#### .5", "x"],
                extract_number)
    assert got == ["1,234", "12.00", "7", "", ".5", ""]


def test_fixture_responses_match_python_re(spark):
    from sway.plans.fixtures import qa_choice, qa_number

    qa = qa_choice(spark, "/root/testdata/sf0.001").select("resp1", "resp2").collect()
    texts = [r.resp1 for r in qa] + [r.resp2 for r in qa]
    assert _eval(spark, texts, extract_choice) == [py_choice(t) for t in texts]
    assert _eval(spark, texts, extract_span) == [py_span(t) for t in texts]
    qn = qa_number(spark, "/root/testdata/sf0.001").select("resp1", "resp2").collect()
    nums = [r.resp1 for r in qn] + [r.resp2 for r in qn]
    assert _eval(spark, nums, extract_number) == [py_number(t) for t in nums]


pieces = st.sampled_from(["The correct answer is", "the correct answer is", " ", ":", "A", "B", "z", ".", "\n",
                          "####", "12", ",5", "-", "\r", "C:", "x"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(pieces, max_size=12).map("".join), min_size=1, max_size=20))
def test_generated_strings_match_python_re(spark, texts):
    assert _eval(spark, texts, extract_choice) == [py_choice(t) for t in texts]
    assert _eval(spark, texts, extract_number) == [py_number(t) for t in texts]
    assert _eval(spark, texts, extract_span) == [py_span(t) for t in texts]


def test_transcript_sections(spark):
    chat = ("<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\nQ? A: x, B: y.<|eot_id|>"
            "<|start_header_id|>assistant<|end_header_id|>\n\nC: Tell the attending that he cannot.<|eot_id|>")
    alp = "<|begin_of_text|>\n ### Instruction:\n q\n\n ### Response:\n  B: yes ### Response: again"
    assert _eval(spark, [chat], response_of_chat) == ["C: Tell the attending that he cannot.<|eot_id|>"]
    assert _eval(spark, [alp], response_of_alpaca) == ["B: yes"]
    assert _eval(spark, ["no markers"], response_of_chat) == [""]
    assert _eval(spark, ["no markers"], response_of_alpaca) == [""]


def test_normalise_numbers_paper_cases(spark):
    df = spark.createDataFrame([("5", "5.0", "5.25"), ("5", "", "5.0"), ("1,234.50", "1234.5", "7"),
                                ("-0", "0", "abc"), ("1e5", "1", "2")], "g string, p string, a string")
    g, p, a = normalise_numbers("g", "p", "a")
    got = [tuple(r) for r in df.select(g, p, a).collect()]
    assert got == [("5.00", "5.00", "5.25"), ("5", "", "5.0"), ("1234.50", "1234.50", "7.00"),
                   ("-0", "0", "abc"), ("1e5", "1", "2")]


def test_recall_option_quirks(spark):
    opts = "A: nation 1, B: nation 2, C: nation 3, D: nation 4, north."
    df = spark.createDataFrame([(opts, "D"), (opts, ""), (opts, "H"), (opts, "Z"), ("Q? DNA: x, A: y", "A")],
                               "o string, p string")
    got = [r.r for r in df.select(recall_option("o", "p").alias("r")).collect()]
    assert got == ["D: nation 4", "", "", "", "A: x"]
    compat = [r.r for r in df.select(recall_option("o", "p", compat=True).alias("r")).collect()]
    assert compat[1] == "A: nation 1"  # an empty prediction recalls option A in the reference
    chat = [r.r for r in df.select(recall_option("o", "p", from_first_a=True).alias("r")).collect()]
    assert chat[4] == "A: x"  # the scan starts inside "DNA:" as in the reference


def py_normalise(a, p, q):
    """Python statement of the joint canonicalisation for plain decimals."""
    a, p, q = (x.replace(",", "") for x in (a, p, q))
    if a and p and q:
        try:
            fa, fp, fq = float(a), float(p), float(q)
        except ValueError:
            return a, p, q
        n = max(len(x.split(".")[1]) if "." in x else 0 for x in (a, p, q))
        return f"{fa:.{n}f}", f"{fp:.{n}f}", f"{fq:.{n}f}"
    return a, p, q


decimal = st.from_regex(r"\A[+-]?([0-9]{1,7}(\.[0-9]{0,4})?|\.[0-9]{1,4})\Z").map(lambda s: s)
with_commas = st.from_regex(r"\A[0-9]{1,3}(,[0-9]{3}){0,2}(\.[0-9]{1,3})?\Z")
junk = st.sampled_from(["", "abc", "1.2.3", "-", ".", "12a"])
number_text = st.one_of(decimal, with_commas, junk)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(number_text, number_text, number_text), min_size=1, max_size=25))
def test_normalise_numbers_matches_python(spark, triples):
    df = spark.createDataFrame(triples, "g string, p string, a string")
    g, p, a = normalise_numbers("g", "p", "a")
    got = [tuple(r) for r in df.select(g, p, a).collect()]
    assert got == [py_normalise(*t) for t in triples]


def test_span_whitespace_capture_is_a_match(spark):
    # the marker matches with a whitespace-only span: '' and no fallback to
    # the lower-case marker (found by the generated-string test)
    texts = ["the correct answer isThe correct answer is ", "The correct answer is  ."]
    got = _eval(spark, texts, extract_span)
    assert got == [py_span(t) for t in texts]
    assert got[0] == ""
