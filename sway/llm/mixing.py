"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources share a multiple of all words by weight, none above its cap.
Amounts: every document is taken as often as its source's target holds the whole
source; the remainder goes to the documents that come first in a hashed order.
Positions: a source's weight over training time is a piecewise-linear schedule.
Its integral, scaled to the target, is the source's cumulative demand; a copy
stands at the time at which the demand reaches the middle of its words.

The running sum of a source's words is split by ranges of the hashed order, so
no task holds a whole source: sums of ranges, a prefix sum over them for each
source, and a window inside each range. The ranges hold about equally many rows
and their number follows from that of all rows; rows that share a key, or have
none, are told apart by size and row, so they spread over ranges too."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sway.llm.common import fresh, numbered, saved

#: (time, weight) points from time 0 to time 1; rising, level and falling in turn
SCHEDULES = (((0.0, 2.0), (0.5, 1.0), (1.0, 1.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.6, 0.5), (1.0, 3.0)))
WORD = r"[^\x20\x09-\x0D]+"
#: the hashed order goes by a remainder of the hash first, then by the hash
BUCKETS = 4096


def targets(sizes: DataFrame, weights: Sequence[int], share: tuple[int, int], cap: int) -> DataFrame:
    """``sizes (source, source_size)`` with ``turn`` (place in code-point order,
    null last) and ``target``: ``share`` of all sizes by weight, the excess over
    ``cap`` times a source's size reshared. With the sources in order of cap over
    weight, those in front are capped as long as the level of the rest lies above
    their own; comparisons are on integers. One row a source: it fits one task."""
    every = Window.partitionBy()
    rows = sizes.withColumn("turn", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("turn") % len(weights) + 1))
    rows = rows.withColumn("most", F.col("source_size") * cap)
    rows = rows.withColumn("total", F.sum("source_size").over(every)).withColumn("heft", F.sum("weight").over(every))
    before = Window.orderBy(F.col("most") / F.col("weight"), "turn").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    rows = rows.withColumn("most_before", so_far("most")).withColumn("heft_before", so_far("weight"))
    above = ((F.col("total") * share[0] - F.col("most_before") * share[1]) * F.col("weight")
             >= F.col("most") * share[1] * (F.col("heft") - F.col("heft_before")))
    rows = rows.withColumn("capped", above)
    rows = rows.withColumn("most_capped", F.sum(F.when(F.col("capped"), F.col("most")).otherwise(0)).over(every))
    rows = rows.withColumn("heft_capped", F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(0)).over(every))
    level = (F.col("weight") * (F.col("total") * share[0] - F.col("most_capped") * share[1]).cast("double")
             / (share[1] * (F.col("heft") - F.col("heft_capped"))).cast("double"))
    target = F.when(F.col("capped"), F.col("most").cast("double")).otherwise(level)
    return rows.select("source", "source_size", "turn", target.alias("target"))


def time_of(part, schedule) -> F.Column:
    """The time at which the integral of ``schedule`` is ``part`` of the whole:
    in each linear piece the root of a quadratic."""
    pieces = [(t0, t1, w0, w1, (w0 + w1) / 2 * (t1 - t0)) for (t0, w0), (t1, w1) in zip(schedule, schedule[1:])]
    whole = sum(p[-1] for p in pieces)
    out, done = None, 0.0
    for t0, t1, w0, w1, area in pieces:
        left = part * F.lit(whole) - F.lit(done)
        slope = (w1 - w0) / (t1 - t0)
        at = left / F.lit(w0) if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + F.lit(2 * slope) * left)) - w0) / slope
        at = F.lit(t0) + at
        done += area
        inside = part * F.lit(whole) < F.lit(done)
        out = F.when(inside, at) if out is None else out.when(inside, at)
    return F.least(F.lit(1.0), F.coalesce(out, F.lit(1.0)))


def ranged(rows: DataFrame, order: Sequence[str], range_rows: int) -> DataFrame:
    """``rows`` with ``range``: the number, ascending with ``order``, of a stretch
    of about ``range_rows`` rows. Written, so that the stretches stay as they are."""
    ranges = rows.count() // range_rows + 1
    return saved(rows.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "ranges")


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: tuple[int, int] = (3, 2), cap: int = 2,
        schedules=SCHEDULES, range_rows: int = 1 << 18, key: str = "doc_id", text: str = "text",
        source: str = "source", row: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``key``, ``row`` (its number: the column
    named by ``row``, or else that of the one scan), ``size`` (words), ``source_size``, ``target`` (of its source),
    ``taken`` (words taken, repeats counted) and ``positions`` (ascending times
    in [0, 1], one for each copy; empty if none).

    Null and wordless texts have size 0 and are taken with whole passes only;
    documents without a source form one, the last; ties of the hashed order are
    broken by key, size and row; repeated rows count like any other; an empty
    table gives no rows. Other columns are not read."""
    copies = cap + 1
    rows = docs.select(
        F.col(key).alias("key"), (F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    place = F.md5(F.coalesce(F.col("key").cast("string"), F.lit("")))
    # "s" and the name, or "": a join key that holds null sources too
    rows = rows.select("*", place.alias("place"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("origin"),
                       (F.conv(F.substring(place, 1, 8), 16, 10).cast("long") % BUCKETS).cast("int").alias("bucket"))
    order = ["bucket", "place", "key", "size", "row"]
    rows = ranged(saved(rows, "sizes"), ["origin", *order], range_rows)
    sums = saved(rows.groupBy("origin", "source", "range").agg(F.sum("size").alias("words")), "sums")
    wanted = targets(sums.groupBy("origin", "source").agg(F.sum("words").alias("source_size"))
                     .select("source", "source_size"), weights, share, cap)
    wanted = wanted.withColumn("origin", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).drop("source")
    before = Window.partitionBy("origin").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0)))
    offsets = offsets.drop("source", "words").join(wanted, "origin")
    inside = (Window.partitionBy("origin", "range").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    out = rows.join(offsets, ["origin", "range"]).withColumn(
        "start", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1))
    out = out.withColumn("passes", whole.cast("long"))
    over = F.col("target") - (F.col("passes") * F.col("source_size"))
    more = (F.col("size") > 0) & (F.col("start") + F.col("size") / 2 < over)
    out = out.withColumn("copies", (F.col("passes") + more.cast("long")).cast("int"))
    middle = lambda c: F.lit(c) * F.col("source_size") + F.col("start") + F.col("size") / 2
    part = lambda c: F.when(F.col("target") > 0, F.least(F.lit(1.0), middle(c) / F.col("target"))).otherwise(0.0)
    times = F.array(*[
        F.when(F.col("copies") > c, F.coalesce(*[F.when(F.col("turn") % len(schedules) == k, time_of(part(c), s))
                                                 for k, s in enumerate(schedules)]))
        for c in range(copies)])
    return out.select(F.col("key").alias(key), "row", "size", "source_size", "target",
                      (F.col("size") * F.col("copies")).alias("taken"), F.array_compact(times).alias("positions"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken,
    range-sorted by training position. Same columns as ``docs``, whatever their names. The
    rows are numbered and written once."""
    columns, (row, places, place) = docs.columns, fresh(docs, "__row", "__positions", "__position")
    docs = numbered(docs, "rows", row)
    plan = mix(docs, row=row, **options).where(F.size("positions") > 0).select(
        F.col("row").alias(row), F.col("positions").alias(places))
    rows = docs.join(plan, row)
    return rows.select(*columns, row, F.explode(places).alias(place)).orderBy(place, row).select(*columns)
