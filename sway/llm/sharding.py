"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table. The
shards take turns, each claiming the first slot of its permutation that is still
free, until the table is full: all shards own the same number of slots, give or
take one, and a changed list of shards moves few slots. Documents look their
slot up in the broadcast table."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sway.llm.common import fresh

#: a table beyond this many slots isn't broadcast
LARGEST_TABLE = 1 << 20


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n ** 0.5) + 1))


def _number(name: str, salt: str) -> int:
    return int(md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def fill(shards: Sequence[str], slots: int) -> list[int]:
    """The index of the shard that owns each of ``slots`` slots."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if not is_prime(slots) or slots < len(shards):
        raise ValueError("the number of slots must be a prime, no smaller than the number of shards")
    owner = [-1] * slots
    at = [_number(s, "offset") % slots for s in shards]
    skip = [_number(s, "skip") % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    claimed = 0
    while True:
        for shard, step in enumerate(skip):
            while owner[at[shard]] >= 0:
                at[shard] = (at[shard] + step) % slots
            owner[at[shard]] = shard
            claimed += 1
            if claimed == slots:
                return owner


def lookup_table(spark: SparkSession, shards: Sequence[str], slots: int) -> DataFrame:
    """The filled table as rows ``(slot, shard)``, ``shard`` an index."""
    owners = ",".join(map(str, fill(shards, slots)))
    return (spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "shard"))
            .select("slot", F.col("shard").cast("int").alias("shard")))


def slot_of(key, text, slots: int) -> F.Column:
    """The slot of a row: from its key; from its text where the key is null."""
    name = F.coalesce(key.cast("string"), F.concat(F.lit("text:"), text), F.lit(""))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long") % F.lit(slots)


def place(docs: DataFrame, shards: Sequence[str], slots: int = 6553, key: str = "doc_id", text: str = "text",
          slot: str = "slot", shard: str = "shard") -> DataFrame:
    """``docs`` with the columns ``slot`` (long) and ``shard`` (int, an index into
    ``shards``), which replace columns of these names.

    A null key is placed by its text, a null key and text as the empty string.
    Equal keys, repeated rows too, go to one shard. An empty table stays empty."""
    if slots > LARGEST_TABLE:
        raise ValueError(f"at most {LARGEST_TABLE} slots")
    own, owner = fresh(docs, "__slot", "__shard")
    table = lookup_table(docs.sparkSession, shards, slots).select(F.col("slot").cast("long").alias(own),
                                                                  F.col("shard").alias(owner))
    rest = [F.col(c) for c in docs.columns if c not in (slot, shard)]
    placed = docs.withColumn(own, slot_of(F.col(key), F.col(text), slots)).join(F.broadcast(table), own)
    return placed.select(*rest, F.col(own).alias(slot), F.col(owner).alias(shard))
