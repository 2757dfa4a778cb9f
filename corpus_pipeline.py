"""From documents to sharded training data: language ID, near-dedup, benchmark
decontamination, mixing and sharding.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that its
predecessor kept, read again from the Parquet files it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sway.llm import decontam, langid, mixing, sharding, simhash
from sway.llm.common import fresh, saved

#: shards of the last stage, and slots of its lookup table
SHARDS = [f"shard-{k:03d}" for k in range(64)]
SLOTS = 6553


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an identified language stay; those whose text is null or
    has no letter go. A document without a language gets the one found; a given one
    stays. If nothing could be learned, no document has a language."""
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"), 4, 2)))
    label, score = fresh(docs, "__lang", "__score")
    found = langid.identify(docs, model, label=label, score=score, keep_text=True)
    found = found.where(F.col(label) != langid.UNKNOWN).withColumn("lang", F.coalesce("lang", label))
    return found.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, the one with the smallest id."""
    return simhash.simhash_dedup(docs, shingle=3, radius=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut from the texts. A document goes if more
    of its words are cut than stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    words, spans, items = fresh(docs, "__words", "__spans", "__items")
    found = decontam.find(docs, benchmark, width=10, clean=True, own=(words, spans, items))
    cut = decontam.n_hit(F.col(spans))
    found = found.where(cut * 2 <= F.col(words))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(
            docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of the curriculum."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the columns ``slot`` and ``shard``."""
    return sharding.place(docs, SHARDS, SLOTS)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("mixing", mix), ("sharding", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: the trained language model can't be expressed in SQL
ORACLE_SQL = None
