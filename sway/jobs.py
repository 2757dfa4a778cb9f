"""Batch jobs for the pipeline stages (format, infer, train-data, analyze), one Spark job each.

    spark-submit -m sway.jobs format  --dataset medqa --input data/US/train.jsonl --split train \\
                                      --data_format alpaca --output corpora/medqa
    spark-submit -m sway.jobs infer   --dataset medqa --corpus corpora/medqa --split test --data_format alpaca \\
                                      --responses responses/ --output outputs/medqa/run1 [--identity random]
    spark-submit -m sway.jobs train-data --corpus corpora/medqa --split train --data_format sharegpt \
                                      --output train/ [--challenged] [--packing] [--tokenizer module:fn --sep id]
    spark-submit -m sway.jobs analyze --results outputs/ --output reports/

``format`` turns raw QA records into an instruction corpus (rejects are
written next to it instead of aborting the run). ``infer`` builds both prompt
rounds, attaches recorded responses (or runs ``--generator module:function``)
and writes prediction records. ``analyze`` reads every result file under a
folder in one scan and writes per-run metrics, confusion cells and the text
report.
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable
from typing import Optional, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sway.functions.paths import run_dimensions
from sway.operators import metrics as M
from sway.operators import rounds as R
from sway.operators.formatting import IntegrityError, reformat
from sway.session import get_spark
from sway.sources import io
from sway.sources import schemas as SC

READERS = {
    "medqa": lambda spark, path, **kw: io.read_choice_map(spark, path, "json", **kw),
    "openbookqa": lambda spark, path, **kw: io.read_choice_lists(spark, path, "parquet" if path.endswith(".parquet") else "json", **kw),
    "gsm8k": lambda spark, path, **kw: io.read_numeric_qa(spark, path, "parquet" if path.endswith(".parquet") else "json", **kw),
}


# ------------------------------------------------------------------ format
def format_job(spark: SparkSession, dataset: str, input_path: str, split: str, fmt: str, output: str,
               strict: bool = False) -> str:
    if dataset not in READERS:
        raise ValueError(f"no reader for dataset {dataset!r}")
    raw, broken = READERS[dataset](spark, input_path, with_broken=True)
    if strict and not broken.isEmpty():
        raise IntegrityError(f"{dataset}: {broken.count()} lines that are no record")
    corpus, rejects = reformat(raw, dataset, fmt, strict=strict, keep=())
    if not strict:
        rejects.write.mode("overwrite").json(f"{output.rstrip('/')}/{split}_{fmt}_rejects.jsonl")
        broken.write.mode("overwrite").json(f"{output.rstrip('/')}/{split}_{fmt}_broken.jsonl")
    return io.write_corpus(corpus, output, split, fmt)


# ------------------------------------------------------------------- infer
def _load(spec: str):
    module, _, fn = spec.partition(":")
    return getattr(importlib.import_module(module), fn)


def infer_job(spark: SparkSession, dataset: str, corpus_root: str, split: str, fmt: str, output: str,
              responses_path: Optional[str] = None, generator: Optional[str] = None, identity=None,
              seed: int = 3407, max_new_tokens: int = 512) -> str:
    """R9 as a job. Corpus rows are keyed by ``item_id`` when present, else by
    the md5 of their content and, for repeated records, their number; a responses
    table must carry the same key plus ``round`` (1 or 2) and ``response``, one
    row for each. The number of prompts without a response, by round, is written
    next to the records."""
    corpus = io.read_corpus(spark, corpus_root, split, fmt)
    cols = ["instruction", "input", "output"] if fmt == "alpaca" else ["conversations"]
    if "item_id" not in corpus.columns:
        corpus = R.with_item_key(corpus, cols)
    kw = dict(identity=identity, seed=seed, keys=("item_id",), max_new_tokens=max_new_tokens)
    if responses_path:
        responses = spark.read.schema(SC.RESPONSE).json(responses_path)
        if not R.duplicate_responses(responses, ("item_id",)).isEmpty():
            raise ValueError("the responses hold more than one row for an item and round")
        R.unmatched_prompts(corpus, responses, ("item_id",)).write.mode("overwrite").json(
            f"{output.rstrip('/')}/{split}_unmatched")
        records = R.two_round(corpus, dataset, fmt, responses=responses, **kw)
    elif generator:
        # responses stay beside the records: a job that is started again goes on with the missing ones
        records = R.two_round(corpus, dataset, fmt, generator=_load(generator),
                              store=f"{output.rstrip('/')}/{split}_{fmt}_responses", **kw)
    else:
        raise ValueError("infer needs --responses or --generator")
    path = f"{output.rstrip('/')}/{split}.jsonl"
    records.write.mode("overwrite").json(path)
    return path


# -------------------------------------------------------------- train data
def train_data_job(spark: SparkSession, corpus_root: str, split: str, fmt: str, output: str,
                   challenged: bool = False, packing: bool = False, max_seq_length: int = 2048,
                   seq_length: int = 1024, batch_size: int = 8, epochs: int = 10, seed: int = 3407,
                   tokenizer: Optional[Callable] = None, eos: Optional[str] = None, sep=None) -> dict[str, object]:
    """E4 (the data part of training): corpus -> training text (plain R1, or
    challenge-aware R2) -> tokenised and truncated rows (T1), split into the plain
    and the challenged side (K4) when ``challenged``, or packed chunks (K1; K3
    paired chunks when ``challenged``) -> seeded batch manifest (O3) and the step
    budget (A14). Rows or chunks are written once under ``output``; the manifest
    ranks their keys and is joined back. ``tokenizer`` is a batch function from
    texts to ids and ``sep`` its id of the separator. Samples whose text lacks the
    marker, so that both sides are the same, are counted."""
    from sway.functions.constants import DEFAULT_EOS
    from sway.operators import packing as PK
    from sway.operators.formatting import missing_marker

    eos = eos or DEFAULT_EOS
    if tokenizer is not None and sep is None:
        raise ValueError("a tokenizer needs the id of its separator")
    sep = eos if tokenizer is None else sep
    corpus = io.read_corpus(spark, corpus_root, split, fmt)
    cols = ["instruction", "input", "output"] if fmt == "alpaca" else ["conversations"]
    corpus = R.with_item_key(corpus, cols)
    out = f"{output.rstrip('/')}/{split}_{fmt}"
    unmarked = 0
    if not packing:
        text = (R.training_text_challenged if challenged else R.training_text)(corpus, fmt, eos)
        rows = PK.tokenize(text.select("item_id", "text"), "text", max_len=max_seq_length, tokenizer=tokenizer)
        rows = rows.withColumn("labels", F.col("input_ids")).drop("text")
        if challenged:
            rows = PK.split_challenge_rows(rows, sep)
    else:
        text = R.training_text(corpus, fmt, eos).select("item_id", "text")
        if challenged:
            unmarked = missing_marker(text).count()
            rows = PK.pack_paired(text, "item_id", "text", seq_length, sep, seed=seed, tokenizer=tokenizer)
        else:
            shards = PK.shard_count(text, "text", seq_length)
            rows = PK.pack(PK.tokenize(text, "text", max_len=None, tokenizer=tokenizer), "item_id", "input_ids",
                           seq_length, sep, shards, seed)
        rows = rows.withColumn("item_id", F.concat_ws(":", F.col("shard").cast("string"),
                                                      F.col("chunk_id").cast("string")))
    rows.write.mode("overwrite").parquet(f"{out}_rows")
    rows = spark.read.schema(rows.schema).parquet(f"{out}_rows")
    if packing:
        PK.require_nonempty(rows)
    budget = M.step_budget(corpus, epochs, batch_size).first()
    manifest = rows.join(PK.assign_batches(rows.select("item_id"), "item_id", batch_size, seed), "item_id")
    manifest.write.mode("overwrite").parquet(f"{out}_train")
    return {"path": f"{out}_train", "n_rows": budget.n_rows, "total_steps": budget.total_steps, "unmarked": unmarked}


# ----------------------------------------------------------------- analyze
def analyze_job(spark: SparkSession, results_root: str, output: str, glob: str = io.RESULT_GLOB) -> dict[str, str]:
    """One scan of all result files, one outcome cube, every metric. The small
    cube is written once and read by every step. Run dimensions are parsed once per
    run, after aggregation. Records that can't be scored are counted by reason."""
    results = io.read_results(spark, results_root, glob=glob)
    keys = ("run", "dataset")
    out = output.rstrip("/")
    paths = {name: f"{out}/{name}" for name in ("cube", "rejects", "metrics", "confusion", "report")}
    cube = M.outcome_cube(R.result_outcomes(results), run_cols=keys)
    cube.write.mode("overwrite").parquet(paths["cube"])
    cube = spark.read.schema(cube.schema).parquet(paths["cube"])
    R.outcome_rejects(results).write.mode("overwrite").json(paths["rejects"])
    board = M.evaluate_cube(cube, keys)
    board = board.withColumn("latex", M.latex_row(board)).withColumn("dims", run_dimensions("run"))
    board.write.mode("overwrite").parquet(paths["metrics"])
    confusion = M.confusion_long(M.phase_cube(cube, keys), keys)
    confusion.write.mode("overwrite").parquet(paths["confusion"])
    confusion = spark.read.schema(confusion.schema).parquet(paths["confusion"])
    io.write_report(M.report_long(board, ("run",), confusion.drop("dataset")), paths["report"])
    return paths


# ---------------------------------------------------------------------- cli
def main(argv: Optional[Sequence[str]] = None) -> None:
    ap = argparse.ArgumentParser(prog="sway.jobs")
    sub = ap.add_subparsers(dest="cmd", required=True)
    f = sub.add_parser("format")
    f.add_argument("--dataset", required=True)
    f.add_argument("--input", required=True)
    f.add_argument("--split", required=True)
    f.add_argument("--data_format", required=True)
    f.add_argument("--output", required=True)
    f.add_argument("--strict", action="store_true")
    i = sub.add_parser("infer")
    i.add_argument("--dataset", required=True)
    i.add_argument("--corpus", required=True)
    i.add_argument("--split", required=True)
    i.add_argument("--data_format", required=True)
    i.add_argument("--output", required=True)
    i.add_argument("--responses")
    i.add_argument("--generator")
    i.add_argument("--identity", nargs="*", default=None)
    i.add_argument("--seed", type=int, default=3407)
    t = sub.add_parser("train-data")
    t.add_argument("--corpus", required=True)
    t.add_argument("--split", required=True)
    t.add_argument("--data_format", required=True)
    t.add_argument("--output", required=True)
    t.add_argument("--challenged", action="store_true")
    t.add_argument("--packing", action="store_true")
    t.add_argument("--max_seq_length", type=int, default=2048)
    t.add_argument("--batch_size", type=int, default=8)
    t.add_argument("--num_epoch", type=int, default=10)
    t.add_argument("--seed", type=int, default=3407)
    t.add_argument("--tokenizer", help="module:function, a batch tokenizer")
    t.add_argument("--sep", type=int, help="its id of the separator")
    a = sub.add_parser("analyze")
    a.add_argument("--results", required=True)
    a.add_argument("--output", required=True)
    args = ap.parse_args(argv)
    spark = get_spark(app=f"sway-{args.cmd}")
    if args.cmd == "format":
        print(format_job(spark, args.dataset, args.input, args.split, args.data_format, args.output, args.strict))
    elif args.cmd == "infer":
        print(infer_job(spark, args.dataset, args.corpus, args.split, args.data_format, args.output,
                        args.responses, args.generator, args.identity, args.seed))
    elif args.cmd == "train-data":
        print(train_data_job(spark, args.corpus, args.split, args.data_format, args.output, args.challenged,
                             args.packing, args.max_seq_length, batch_size=args.batch_size, epochs=args.num_epoch,
                             seed=args.seed, tokenizer=_load(args.tokenizer) if args.tokenizer else None, sep=args.sep))
    else:
        print(analyze_job(spark, args.results, args.output))


if __name__ == "__main__":
    main()
