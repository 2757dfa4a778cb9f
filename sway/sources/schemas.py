"""Declared schemas of the record types (no inference: JSON inference would
turn the options map into an alphabetically sorted struct)."""

from pyspark.sql import types as T

S = T.StringType()

CHOICE_MAP = T.StructType([
    T.StructField("question", S), T.StructField("answer", S),
    T.StructField("options", T.MapType(S, S)), T.StructField("answer_idx", S),
])

CHOICE_LISTS = T.StructType([
    T.StructField("fact1", S), T.StructField("question_stem", S),
    T.StructField("choices", T.StructType([T.StructField("text", T.ArrayType(S)), T.StructField("label", T.ArrayType(S))])),
    T.StructField("answerKey", S),
])

NUMERIC_QA = T.StructType([T.StructField("question", S), T.StructField("answer", S)])

ALPACA = T.StructType([T.StructField("instruction", S), T.StructField("input", S), T.StructField("output", S)])

MESSAGE = T.StructType([T.StructField("from", S), T.StructField("value", S)])
SHAREGPT = T.StructType([T.StructField("conversations", T.ArrayType(MESSAGE))])

CORPUS = {"alpaca": ALPACA, "sharegpt": SHAREGPT}

PREDICTION = T.StructType([T.StructField(n, S) for n in (
    "question", "options", "context", "answer", "answer_idx", "answer_val", "pred_str", "attack_pred_str",
    "pred_idx", "attack_pred_idx", "pred_val", "attack_pred_val", "pred_ans")])

# recorded responses: the item's key, the round (1 or 2) and the generated text
RESPONSE = T.StructType([T.StructField("item_id", S), T.StructField("round", T.IntegerType()), T.StructField("response", S)])
