from pyspark.sql import functions as F
from pyspark.sql import types as T

from sway.functions.text import format_sent, gold_number, join_choices, join_options, py_strip, split_choice_answer


def _fmt(spark, s, end):
    df = spark.createDataFrame([(s,)], "s string")
    return df.select(format_sent("s", end).alias("o")).first().o


def test_format_sent_paper_cases(spark):
    assert _fmt(spark, " what is it", "?") == "What is it?"
    assert _fmt(spark, "", ".") == ""
    assert _fmt(spark, "done!", ".") == "Done!"
    assert _fmt(spark, "   \n ", ".") == ""
    assert _fmt(spark, "already. ", "?") == "Already."
    # only the first character changes case (not initcap)
    assert _fmt(spark, "mRNA is fine", ".") == "MRNA is fine."


def test_format_sent_matches_python(spark):
    def ref(s, end):
        s = s.strip()
        if s:
            s = s[0].upper() + s[1:]
        if s and s[-1] not in ".!?":
            s += end
        return s

    cases = ["a", " b ", "x?", "hello world", "\tz!", "é tait", "12 apples", "end.", "q"]
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    got = [r.o for r in df.select(format_sent("s", "?").alias("o")).collect()]
    assert got == [ref(c, "?") for c in cases]


def test_join_options_keeps_map_order(spark):
    df = spark.sql("select map('C', 'third', 'A', 'first', 'B', 'second') as m")
    assert df.select(join_options("m").alias("o")).first().o == "C: third, A: first, B: second"


def test_join_choices(spark):
    df = spark.sql("select array('A', 'B') as l, array('red', 'blue!') as t")
    assert df.select(join_choices("l", "t").alias("o")).first().o == "A: Red. B: Blue!"


def test_split_choice_answer_and_gold_number(spark):
    df = spark.createDataFrame([("C: text: more ", "so #### 42 "), ("nothing", "no marker")], "g string, a string")
    k, v = split_choice_answer("g")
    out = df.select(k.alias("k"), v.alias("v"), gold_number("a").alias("n")).collect()
    assert (out[0].k, out[0].v, out[0].n) == ("C", "text: more", "42")
    assert (out[1].k, out[1].v, out[1].n) == (None, None, None)


def test_py_strip_unicode(spark):
    df = spark.createDataFrame([("  x \n",)], T.StructType([T.StructField("s", T.StringType())]))
    assert df.select(py_strip("s").alias("o")).first().o == "x"
    assert df.select(F.trim("s").alias("o")).first().o != "x"  # why py_strip exists
