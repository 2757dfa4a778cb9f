"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Optional

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sway.session import ensure_checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder named by ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df``: write it as Parquet to the shared folder and
    read it back. Survives the loss of any executor."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, row: str) -> DataFrame:
    """``df`` with ``row``, its number in the scan, written once: a second scan may be
    split otherwise and number other rows so."""
    path = shared_path(df.sparkSession, name)
    df = df.withColumn(row, F.monotonically_increasing_id())
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A name like each of ``names`` that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared(spark: SparkSession, value):
    """A broadcast of ``value``, pickled with the classes of this package, so that workers
    need no copy of it; ``unshared`` reads it in a task."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def unshared(broadcast):
    return cloudpickle.loads(broadcast.value)


def byte_texts(column) -> Iterator[Optional[bytes]]:
    """UTF-8 bytes of an Arrow string column, None for null."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for value in column.cast(kind):
        yield value.as_py()


def hashed_unit(*cols) -> F.Column:
    """A uniform value in [0, 1) that depends on the values of ``cols`` only."""
    return (F.xxhash64(*cols).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53)))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges (a, b)``, long columns, as ``(node, root)``
    with ``root`` the smallest node of the component. Nodes without an edge are
    not listed; self loops and nulls are ignored.

    Alternating large-star and small-star steps: each is one aggregation and one
    join on the node, so a hub is pre-aggregated before the shuffle and the join
    is one that adaptive execution can split. Every round is written to the
    shared folder; the driver sees a row count and a checksum only."""
    spark = edges.sparkSession
    edges = saved(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = saved(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen:
            break
        seen = state
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())
