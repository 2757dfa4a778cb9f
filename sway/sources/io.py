"""Sources and sinks (SRC1-SRC8, SNK1-SNK3)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sway.functions.constants import ROLE_TO_SHAREGPT
from sway.sources import schemas as SC


#: result files: those of Spark's JSON writer (``part-*.json``) and single ``*.jsonl`` files
RESULT_GLOB = "*.json*"


#: column of a record's own text where it can't be read
CORRUPT = "_corrupt_record"


def sound_and_broken(lines: DataFrame, schema) -> tuple[DataFrame, DataFrame]:
    """JSON lines ``(value, ...)`` as records of ``schema`` (beside the other columns), and those
    that are none, with ``reason`` and ``record`` (the line). Blank lines are neither."""
    kind = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = lines.where(F.btrim("value", F.lit(" \t\r\n")) != "").withColumn(
        "_r", F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    rest = [c for c in lines.columns if c != "value"]
    nothing = F.col("_r").isNull() | ~F.startswith(F.ltrim("value"), F.lit("{"))
    broken = F.col(f"_r.{CORRUPT}").isNotNull() | nothing
    sound = parsed.where(~broken).select(*rest, *[F.col(f"_r.{f.name}").alias(f.name) for f in schema.fields])
    reason = F.when(F.col(f"_r.{CORRUPT}").isNotNull(), "not a JSON record of the declared types").otherwise("no JSON object")
    return sound, parsed.where(broken).select(*rest, reason.alias("reason"), F.col("value").alias("record"))


def _lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """The lines of text files with the path of their file."""
    reader = spark.read
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("path"))


def _read(spark: SparkSession, path: str, schema, fmt: str = "json", with_broken: bool = False):
    if fmt == "parquet":
        records = spark.read.schema(schema).parquet(path)
        none = records.limit(0).select(*[F.lit(None).cast("string").alias(c) for c in ("path", "reason", "record")])
        return (records, none) if with_broken else records
    if not with_broken:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    sound, broken = sound_and_broken(_lines(spark, path), schema)
    return sound.drop("path"), broken


def read_choice_map(spark: SparkSession, path: str, fmt: str = "json", with_broken: bool = False):
    """SRC1: JSON-lines multiple-choice records, options as an ordered map. A line that is no
    such record fails the job that reads it; ``with_broken`` returns a second table of
    those lines instead, ``(path, reason, record)``."""
    return _read(spark, path, SC.CHOICE_MAP, fmt, with_broken)


def read_choice_lists(spark: SparkSession, path: str, fmt: str = "parquet", with_broken: bool = False):
    """SRC2: multiple choice with parallel label/text lists and a fact; broken lines as for
    ``read_choice_map``."""
    return _read(spark, path, SC.CHOICE_LISTS, fmt, with_broken)


def read_numeric_qa(spark: SparkSession, path: str, fmt: str = "parquet", with_broken: bool = False):
    """SRC3: numeric-answer QA (answer ends in ``#### <number>``); broken lines as for
    ``read_choice_map``."""
    return _read(spark, path, SC.NUMERIC_QA, fmt, with_broken)


def corpus_path(root: str, split: str, fmt: str) -> str:
    return f"{root.rstrip('/')}/{split}_{fmt}_sft.jsonl"


def read_corpus(spark: SparkSession, root: str, split: str, fmt: str, with_broken: bool = False):
    """SRC4: corpus addressed by split and format (file or directory); broken lines as for
    ``read_choice_map``."""
    if fmt not in SC.CORPUS:
        raise NotImplementedError(f"unknown corpus format {fmt!r}")
    return _read(spark, corpus_path(root, split, fmt), SC.CORPUS[fmt], "json", with_broken)


def with_origin(results: DataFrame, path=None) -> DataFrame:
    """Result records with ``path`` (their file) and, where the path has them as
    partitions (``dataset=...``, ``split=...``), ``dataset`` and ``split``."""
    path = F.col("_metadata.file_path") if path is None else path

    def partition(name: str):
        value = F.regexp_extract(path, rf"/{name}=([^/]*)/", 1)
        return F.try_url_decode(F.try_url_decode(F.nullif(value, F.lit("")))).alias(name)

    return results.select("*", path.alias("path"), partition("dataset"), partition("split"))


def read_results(spark: SparkSession, root: str, schema=SC.PREDICTION, glob: str = RESULT_GLOB, with_broken: bool = False):
    """SRC5: every result file under ``root`` in one scan, with its path and the
    partition columns that ``write_predictions`` put into it; broken lines as for
    ``read_choice_map``."""
    options = {"recursiveFileLookup": "true", "pathGlobFilter": glob}
    if with_broken:
        sound, broken = sound_and_broken(_lines(spark, root, **options), schema)
        return with_origin(sound.withColumnRenamed("path", "_path"), F.col("_path")).drop("_path"), broken
    return with_origin(spark.read.schema(schema).options(mode="FAILFAST", **options).json(root))


def turns_to_sharegpt(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role",
                      text: str = "text") -> DataFrame:
    """SRC8: one row per turn -> one ShareGPT conversation per key, turns in
    order, roles mapped user->human, assistant->gpt."""
    roles = F.create_map(*[F.lit(x) for kv in ROLE_TO_SHAREGPT.items() for x in kv])
    msg = F.struct(F.col(order).alias("o"), F.coalesce(F.element_at(roles, F.col(role)), F.col(role)).alias("from"),
                   F.col(text).alias("value"))
    grouped = turns.groupBy(key).agg(F.array_sort(F.collect_list(msg)).alias("_m"))
    return grouped.select(key, F.transform("_m", lambda m: F.struct(m["from"].alias("from"),
                                                                    m["value"].alias("value"))).alias("conversations"))


def chat_pieces(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role",
                text: str = "text", add_generation_prompt: bool = False, with_last: bool = False) -> DataFrame:
    """F10 in long form: one rendered piece per turn, ``(key, order, piece)``,
    computed row by row with no grouping. In ``order`` the pieces concatenate
    to ``render_chat`` of the conversation (the first turn carries the BOS).
    Every piece starts and ends on a special token, so tokenising pieces and
    concatenating the tokens equals tokenising the whole text: a conversation
    of any length can be tokenised and packed without ever being gathered into
    one row. ``add_generation_prompt`` appends the assistant header to the
    last turn (found with a per-conversation max, an aggregate, not a gather);
    ``with_last`` adds a column that marks it."""
    from sway.functions.constants import BOS, END_HEADER, EOT, START_HEADER
    from sway.functions.text import py_strip

    bounds = turns.groupBy(key).agg(F.min(order).alias("_first"), F.max(order).alias("_last"))
    t = turns.join(bounds, key)
    piece = F.concat(F.when(F.col(order) == F.col("_first"), F.lit(BOS)).otherwise(F.lit("")),
                     F.lit(START_HEADER), F.col(role), F.lit(END_HEADER + "\n\n"), py_strip(text), F.lit(EOT))
    if add_generation_prompt:
        piece = F.concat(piece, F.when(F.col(order) == F.col("_last"),
                                       F.lit(START_HEADER + "assistant" + END_HEADER + "\n\n")).otherwise(F.lit("")))
    last = [(F.col(order) == F.col("_last")).alias("last")] if with_last else []
    return t.select(key, order, piece.alias("piece"), *last)


def write_corpus(df: DataFrame, root: str, split: str, fmt: str, mode: str = "overwrite") -> str:
    """SNK1: corpus writer (a directory named like the reference's file)."""
    cols = ["instruction", "input", "output"] if fmt == "alpaca" else ["conversations"]
    path = corpus_path(root, split, fmt)
    df.select(*cols).write.mode(mode).json(path)
    return path


def write_predictions(df: DataFrame, path: str, partition_by: Sequence[str] = ("dataset", "split"),
                      mode: str = "overwrite") -> None:
    """SNK2: prediction records as JSON lines, partitioned (train split by
    split index through an ordinary partition column). ``mode='overwrite'`` replaces the
    partitions that ``df`` holds and leaves the others below ``path`` as they are; without
    a partition column it replaces all."""
    cols = [c for c in partition_by if c in df.columns]
    w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    if cols:
        w = w.partitionBy(*cols)
    w.json(path)


def plain_decimal(value) -> F.Column:
    """A double as plain decimal text (no exponent): 18 places, trailing zeros
    dropped, one kept after the point."""
    text = F.col(value).cast("decimal(38,18)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", ".0")


def render_report(report: DataFrame, run_cols: Sequence[str] = ("run",)) -> DataFrame:
    """SNK3: report text lines ``(run, ordinal, line)`` in the reference's
    layout: ``"{section}:\n\n"`` before a section's first entry, one
    ``"key: value"`` line per entry, two empty lines after its last entry. Which
    entry is first and last follows from the fixed order of the report, so no run's
    lines are gathered to find out; the empty lines come as a row of their own."""
    from sway.operators.metrics import report_entries

    ordinals: dict[str, list[int]] = {}
    for section, o, _, src in report_entries():
        ordinals.setdefault(section, []).append(o)
    values = {section: [o for s, o, _, src in report_entries() if s == section and src not in ("@before", "@after")]
              for section in ordinals}
    first = F.col("ordinal").isin([v[0] for v in values.values()])
    value_text = F.coalesce(F.col("text"), plain_decimal("value"))
    head = F.when(first, F.concat(F.col("section"), F.lit(":\n\n"))).otherwise(F.lit(""))
    line = F.concat(head, F.col("key"), F.lit(": "), value_text)
    end = F.lit(None).cast("double")
    for section, own in values.items():
        end = F.when(F.col("ordinal") == own[-1], F.lit(ordinals[section][-1] + 0.5)).otherwise(end)
    lines = F.array_compact(F.array(
        F.struct(F.col("ordinal").cast("double").alias("ordinal"), line.alias("line")),
        F.when(end.isNotNull(), F.struct(end.alias("ordinal"), F.lit("\n").alias("line")))))
    return report.select(*run_cols, F.inline(lines))


def write_report(report: DataFrame, path: str, run_cols: Sequence[str] = ("run",), mode: str = "overwrite") -> None:
    """SNK3: one text report per run (``partitionBy(run)``), lines in order. Reports of runs
    that ``report`` doesn't hold stay as they are."""
    lines = render_report(report, run_cols).repartition(*run_cols).sortWithinPartitions(*run_cols, "ordinal", "line")
    (lines.select(*run_cols, "line").write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy(*run_cols).text(path))
