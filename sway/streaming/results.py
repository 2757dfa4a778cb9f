"""Structured Streaming over result files.

The reference has no streaming logic; what streams for free here is the
stateless part (parsing) and the outcome cube, which is an ordinary streaming
aggregate. New result files dropped into a folder update the cube, and every
micro-batch computes the metrics of the runs it changed.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Optional, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sway.operators import metrics as M
from sway.operators.rounds import result_outcomes
from sway.sources import schemas as SC
from sway.sources.io import RESULT_GLOB, with_origin


def read_results_stream(spark: SparkSession, root: str, schema=SC.PREDICTION, max_files: int = 1000) -> DataFrame:
    """Streaming counterpart of ``read_results``: every new result file under
    ``root`` (recursively) with its path and partition columns."""
    df = (spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", RESULT_GLOB)
          .option("maxFilesPerTrigger", max_files).json(root))
    return with_origin(df)


def stream_outcomes(stream: DataFrame) -> DataFrame:
    """Stateless: result records -> ``(run, gt, pred, attack_pred)``, choice and
    numeric, exactly as the batch operator; records without a gold answer or of an
    unknown dataset are left out (``outcome_rejects`` counts them in batch)."""
    return result_outcomes(stream).select("run", "gt", "pred", "attack_pred")


def streaming_cube(outcomes: DataFrame, run_cols: Sequence[str] = ("run",)) -> DataFrame:
    """A1 as a streaming aggregate (state = one counter per outcome triple)."""
    return M.outcome_cube(outcomes, run_cols)


def start_metrics(cube: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
                  trigger_available_now: bool = True, run_cols: Sequence[str] = ("run",),
                  query_name: Optional[str] = None, buckets: int = 64) -> StreamingQuery:
    """Run the streaming cube in ``update`` mode: every micro-batch adds the counters it
    changed to a snapshot next to ``checkpoint``, and hands the metrics (A12) of the runs it
    changed to ``sink(df, epoch)``. ``checkpoint`` must be a folder in the shared checkpoint
    location so the query survives restarts.

    The snapshot is kept by hash buckets of the runs. A micro-batch reads and writes the
    buckets of the runs it changed, each under its own number, and an index with one
    row a bucket says which number holds a bucket's latest state; so what a batch reads
    depends on the counters of those buckets, not on the batches before it. A counter
    only grows, so its latest value is its largest, and a batch that is run again writes
    the same."""
    store = f"{checkpoint.rstrip('/')}-cube"
    triple = [*run_cols, "gt", "pred", "attack_pred"]

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*run_cols), F.lit(buckets)).cast("int")
        batch.withColumn("bucket", bucket).write.mode("overwrite").parquet(f"{store}/delta/epoch={epoch}")
        kind = T.StructType([*batch.schema.fields, T.StructField("bucket", T.IntegerType())])
        delta = spark.read.schema(kind).parquet(f"{store}/delta/epoch={epoch}")
        latest = {}
        if epoch:
            latest = dict(map(tuple, spark.read.schema("bucket int, epoch long").parquet(f"{store}/index/epoch={epoch - 1}").collect()))
        touched = [r.bucket for r in delta.select("bucket").distinct().collect()]
        before = [f"{store}/snapshot/epoch={latest[b]}/bucket={b}" for b in touched if b in latest]
        every = delta
        if before:
            held = spark.read.schema(batch.schema).parquet(*before).withColumn("bucket", bucket)
            every = held.unionByName(delta)
        every = every.groupBy("bucket", *triple).agg(F.max("n").alias("n"))
        every.write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/snapshot/epoch={epoch}")
        index = [(b, e) for b, e in (latest | dict.fromkeys(touched, epoch)).items()]
        spark.createDataFrame(index, "bucket int, epoch long").write.mode("overwrite").parquet(f"{store}/index/epoch={epoch}")
        held = spark.read.schema(kind).parquet(f"{store}/snapshot/epoch={epoch}")
        changed = delta.select(*run_cols).distinct()
        sink(M.evaluate_cube(held.join(changed, list(run_cols), "left_semi").drop("bucket"), run_cols), epoch)

    w = cube.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(each)
    if query_name:
        w = w.queryName(query_name)
    if trigger_available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def parse_transcripts_stream(spark: SparkSession, root: str, dataset: str, fmt: str,
                             text_col: str = "pred_str", key: str = "item_id", out: str = "pred") -> DataFrame:
    """R5 on a stream: generation logs (``key``, ``text_col`` JSON lines) that
    land in ``root`` are parsed with exactly the batch operator — parsing is
    stateless, so the streaming plan is the batch plan."""
    from sway.operators.rounds import with_parsed

    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField(text_col, T.StringType())])
    stream = spark.readStream.schema(schema).option("pathGlobFilter", RESULT_GLOB).json(root)
    return with_parsed(stream, text_col, dataset, fmt, out)
