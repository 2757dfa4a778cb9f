"""Greedy text buffers in input order (K2), found in parallel.

A buffer takes texts in order until it holds ``bound`` characters; the next one starts
with the text after. Where a buffer starts depends on all before it, but where the next
one would start depends on a text's running length alone:

1. Two-level prefix sums give every text the characters before it. A text with
   characters is named by that number; empty texts go with the one that follows.
2. The buffer that would start at place v ends with the text that covers v + bound. Places
   are dealt out by stretches of ``bound`` characters, where one sorted pass answers all
   of them; a text that covers several stretches is listed in each.
3. Pointer doubling. The table of 2^k-fold jumps, joined with itself, gives that of
   2^(k+1)-fold jumps. Only places that some 2^k-fold jump reaches are kept, and chains
   that meet stay together, so the tables shrink as they go.
4. From place 0 the largest jumps mark every 2^k-th start, the next smaller ones those
   half-way between, down to single jumps.
5. Starts lie ``bound`` apart at least, so a stretch holds one at most, and a text's
   buffer starts in its own stretch or the one before: two joins on the stretch."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sway.operators.ordering import with_positions, write_ordered
from sway.operators.scratch import scratch_path, written


def running_lengths(df: DataFrame, key: str, length, ranges: int | None = None) -> DataFrame:
    """``(key, len, before)``: every row's length and the sum of those that come before it
    in the order of ``key`` (unique; nulls last). Sums of ranges are added up, one row a
    range, and windows run inside ranges, over keys and lengths alone."""
    rows = df.select(F.col(key).alias("key"), F.coalesce(length, F.lit(0)).cast("long").alias("len"))
    rows = write_ordered(rows, [F.asc_nulls_last("key"), F.col("len")], scratch_path(df.sparkSession, "lengths"), ranges)
    sums = rows.groupBy("part").agg(F.sum("len").alias("sum"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("part").alias("_part"), F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("inner", F.coalesce(F.sum("len").over(inside), F.lit(0)))
            .join(offsets, F.col("part") == F.col("_part"))
            .select("key", "len", (F.col("offset") + F.col("inner")).alias("before")))


def _next_starts(texts: DataFrame, bound: int) -> DataFrame:
    """``(v, to)``: for each text with characters, where the buffer after one that starts
    there would start; null where the texts end before."""
    stretch = lambda c: F.floor(c / F.lit(bound))
    end = F.col("before") + F.col("len")
    ends = texts.select(F.explode(F.sequence(stretch(F.col("before")), stretch(end))).alias("stretch"), end.alias("at"),
                        end.alias("end"), F.lit(None).cast("long").alias("v"))
    wanted = F.col("before") + F.lit(bound)
    asked = texts.select(stretch(wanted).alias("stretch"), wanted.alias("at"), F.lit(None).cast("long").alias("end"),
                         F.col("before").alias("v"))
    # from the far end of a stretch: the nearest text's end seen so far, equal ones included
    nearest = (Window.partitionBy("stretch").orderBy(F.desc("at"), F.col("v").isNotNull())
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = ends.unionByName(asked).withColumn("to", F.last("end", ignorenulls=True).over(nearest))
    return found.where("v is not null").select("v", "to")


def _starts(texts: DataFrame, bound: int) -> DataFrame:
    """``(v)``: the places at which buffers start."""
    total = texts.agg(F.sum("len")).first()[0] or 0
    last = texts.agg(F.max("before")).first()[0]
    zero = texts.sparkSession.range(1).select(F.col("id").alias("v"))
    # a jump goes ``bound`` characters on at least
    rounds = max(1, math.ceil(math.log2(total // bound + 2)))
    jumps = [written(_next_starts(texts, bound).where((F.col("to") <= last)), "jumps")]
    for _ in range(rounds - 1):
        one = jumps[-1]
        reached = one.select(F.col("to").alias("v")).unionByName(zero).distinct()
        two = one.select(F.col("v").alias("to"), F.col("to").alias("beyond"))
        jumps.append(written(reached.join(one, "v").join(two, "to").select("v", F.col("beyond").alias("to")), "jumps"))
        if jumps[-1].isEmpty():
            break
    marked = zero
    for jump in reversed(jumps):
        more = marked.join(jump, "v").select(F.col("to").alias("v"))
        marked = written(marked.unionByName(more).distinct(), "starts")
    return marked


def greedy_buffers(df: DataFrame, key: str, length, bound: float, out: str = "buffer", ranges: int | None = None) -> DataFrame:
    """``(key, out)`` for each row of ``df``: the number, from 0, of the buffer that it falls
    into when buffers are filled in the order of ``key`` (unique; nulls last) and closed as
    soon as they hold ``bound`` characters. ``length`` is the column of lengths; null counts
    as 0. A table without characters is one buffer; an empty one gives no rows."""
    if bound <= 0:
        raise ValueError("a buffer needs a positive bound")
    bound = math.ceil(bound)
    spark = df.sparkSession
    rows = written(running_lengths(df, key, length, ranges), "running")
    texts = rows.where("len > 0").select("before", "len")
    starts = _starts(texts, bound)
    # empty texts that follow a full buffer, last of all, are one more
    total = rows.agg(F.sum("len")).first()[0] or 0
    trailing = rows.where((F.col("before") == total) & (F.col("len") == 0))
    if total and not trailing.isEmpty():
        last = starts.agg(F.max("v")).first()[0]
        if total - last >= bound:
            starts = starts.unionByName(spark.range(1).select(F.lit(total).cast("long").alias("v")))
    starts = with_positions(write_ordered(starts, [F.col("v")], scratch_path(spark, "starts")), out)
    starts = written(starts.select("v", F.floor(F.col("v") / F.lit(bound)).alias("stretch"), out), "buffers")
    own = starts.select("stretch", F.col("v").alias("_v"), F.col(out).alias("_own"))
    before = starts.select((F.col("stretch") + 1).alias("stretch"), F.col(out).alias("_before"))
    placed = rows.withColumn("stretch", F.floor(F.col("before") / F.lit(bound))).join(own, "stretch", "left").join(
        before, "stretch", "left")
    return placed.select(F.col("key").alias(key), F.when(F.col("_v") <= F.col("before"), F.col("_own"))
                         .otherwise(F.col("_before")).alias(out))
