"""Exact deduplication by a stateful stream.

Documents arrive as files of a stream. The keyed state, kept on disk by RocksDB
and never expired, holds for each digest the stable identifier of the document
that stays, the locator of its content (file and row) and the number of copies.
The state is a streaming aggregate, so copies are reduced before the shuffle and
a digest that holds a third of all rows is no burden to its task. Each
micro-batch writes the changed entries to the shared folder, under its own
number, so a repeated batch overwrites itself.

A digest with more than one row is a hit. The full bytes of every hit are
compared with the content at the retained locator; the documents of a digest
that turns out to cover different texts are regrouped by their bytes.

Before a result is given the state is held against the files: it must count every
row, hold every digest, and the retained content of every hit must be found. A
stream that missed rows is an error, not a smaller result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sway.llm.common import saved, shared_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sha256(text) -> F.Column:
    return F.unhex(F.sha2(text, 256))


def _rows(df: DataFrame, key: str, text: str, digest) -> DataFrame:
    content = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.col(key).alias("key"), F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.row_index").alias("line"), content.alias("text"), digest(content).alias("digest"))


def digest_state(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text", digest=sha256,
                 files_per_batch: int | None = None, bytes_per_batch: int = 1 << 40) -> DataFrame:
    """Run the stream over the Parquet files at ``path`` until all are read and
    return its state: ``digest``, ``stays (key, file, line)``, ``copies``. A micro-batch
    takes files of ``bytes_per_batch`` in all, or ``files_per_batch`` where that is given.
    The state of a stream that wrote no batch has no rows."""
    put = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB,
           "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
           # a store reserves no disk beyond what it holds
           "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
    was = {k: spark.conf.get(k, None) for k in put}
    entries, progress = shared_path(spark, "state"), shared_path(spark, "progress")
    schema = spark.read.parquet(path).select(key, text).schema
    # a glob that matches the path itself: a plain path to a single file can't be streamed
    path = path.rstrip("/")
    if not any(c in path for c in "*?[{\\"):
        path = f"{path[:-1]}[{path[-1]}]"
    bound = ("maxFilesPerTrigger", files_per_batch) if files_per_batch else ("maxBytesPerTrigger", bytes_per_batch)
    stream = (spark.readStream.schema(schema).option(*bound)
              .parquet(path))
    # of equal texts the largest key stays, then the last row; null keys are the smallest
    state = _rows(stream, key, text, digest).groupBy("digest").agg(
        F.max(F.struct("key", "file", "line")).alias("stays"), F.count("*").alias("copies"))

    batches = set()

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{entries}/batch={number}")
        batches.add(number)

    for k, v in put.items():
        spark.conf.set(k, v)
    try:
        (state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", progress)
         .trigger(availableNow=True).start().awaitTermination())
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    kind = f"digest binary, stays struct<key: {schema[key].dataType.simpleString()}, file: string, line: bigint>, copies bigint, batch int"
    if batches:
        written = spark.read.schema(kind).option("basePath", entries).parquet(f"{entries}/batch=*")
    else:
        written = spark.createDataFrame([], kind)
    last = written.groupBy("digest").agg(F.max_by(F.struct("stays", "copies"), "batch").alias("last"))
    return last.select("digest", "last.stays", "last.copies")


def exact_dedup(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text", digest=sha256,
                files_per_batch: int | None = None, bytes_per_batch: int = 1 << 40) -> DataFrame:
    """One row for each row of the Parquet files at ``path``: ``key``,
    ``digest``, ``keep`` (key of the equal text that stays: the largest),
    ``group_size`` and ``kept`` (true for one row of each group).

    A null text counts as empty. A null key is smaller than any other; of rows
    with equal texts and keys the last one in the files stays. Files without rows
    give no rows. Other columns are not read, so their names can't clash. ``RuntimeError``
    if the state doesn't cover the files, also where no batch was written for them."""
    source = spark.read.parquet(path)
    docs = _rows(source, key, text, digest)
    state = saved(digest_state(spark, path, key, text, digest, files_per_batch, bytes_per_batch), "digests")
    counted = state.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"), F.count_if(F.col("copies") > 1).alias("hits"),
                        F.coalesce(F.sum(F.when(F.col("copies") > 1, F.col("copies"))), F.lit(0)).alias("copies")).first()
    n = source.count()
    if counted["rows"] != n:
        raise RuntimeError(f"the state counts {counted['rows']} rows, the files at {path} hold {n}")
    known = F.coalesce("copies", F.raise_error(F.lit("a digest of the files is not in the state")).cast("bigint"))
    marked = docs.drop("text").join(state, "digest", "left").withColumn("copies", known)

    # the texts are shuffled once; only those of hits go on
    hits = saved(docs.join(state.where("copies > 1").select("digest", "stays"), "digest"), "hits")
    stays = (F.col("file") == F.col("stays.file")) & (F.col("line") == F.col("stays.line"))
    found = hits.agg(F.count(F.lit(1)).alias("copies"), F.count_if(stays).alias("hits")).first()
    if (found["copies"], found["hits"]) != (counted["copies"], counted["hits"]):
        raise RuntimeError(f"{found['copies']} rows with {found['hits']} retained texts were found to compare, "
                           f"the state counts {counted['copies']} with {counted['hits']}")
    retained = hits.where(stays).select("digest", F.col("text").alias("retained"))
    # no aggregate by digest follows, so the join can split a digest with many rows
    differ = saved(hits.select("digest", "text").join(retained, "digest").where("text <> retained")
                   .select("digest"), "differ")
    if not differ.isEmpty():
        same = marked.join(differ, "digest", "left_anti")
        mixed = hits.drop("stays").join(differ, "digest", "left_semi")
        groups = mixed.groupBy("digest", "text").agg(F.max(F.struct("key", "file", "line")).alias("stays"),
                                                     F.count("*").alias("copies"))
        marked = same.unionByName(mixed.join(groups, ["digest", "text"]).drop("text"))
    return marked.select(
        F.col("key").alias(key), "digest", F.col("stays.key").alias("keep"), F.col("copies").alias("group_size"),
        ((F.col("file") == F.col("stays.file")) & (F.col("line") == F.col("stays.line"))).alias("kept"))
