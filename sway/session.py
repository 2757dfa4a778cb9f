"""SparkSession helpers."""

from __future__ import annotations

import os
import tempfile
from typing import Optional

from pyspark.sql import SparkSession

# Settings that matter at any scale: adaptive execution (coalescing, skew-join
# splitting, runtime join selection), Arrow batches for the few Python UDFs.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def get_spark(master: Optional[str] = None, app: str = "sway", shuffle_partitions: Optional[int] = None,
              extra: Optional[dict] = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    # the checkpoint folder is resolved lazily, by the operators that cut
    # lineage (ensure_checkpoint_dir)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder the cluster names in
    ``spark.checkpoint.dir``. Where it is unset on a local master (tests, a laptop)
    a private folder is created; on a cluster a machine-local folder would not
    survive executor loss, so an unset setting is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS / object storage)")
    path = tempfile.mkdtemp(prefix="sway-ckpt-")
    sc.setCheckpointDir(path)
    return path
