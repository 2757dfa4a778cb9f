"""Rows in a total order, written once, with their positions (O1).

The rows are dealt out by ranges of the order's columns, sorted inside each range and
written, so that file after file holds the order. A row's position is its place in its
range plus the number of rows in the ranges before: one count a range is all that is
summed up, and no window holds the rows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Optional

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_IN_PARTITION = (1 << 33) - 1


def write_ordered(df: DataFrame, by: Sequence[Column], path: str, ranges: Optional[int] = None,
                  part: str = "part", place: str = "place") -> DataFrame:
    """Write ``df`` below ``path`` as Parquet in the order of ``by`` and read it back, with
    ``part`` (the number of the range, ascending with the order) and ``place`` (the row's
    place in it, from 0).

    ``ranges`` is their number, by default that of the shuffle partitions. Rows that are
    equal in ``by`` stay in one range: give it columns that tell rows apart, where one
    value may be very common."""
    dealt = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    dealt = (dealt.sortWithinPartitions(*by).withColumn(part, F.spark_partition_id())
             .withColumn(place, F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION))))
    dealt.write.parquet(path)
    return df.sparkSession.read.schema(dealt.schema).parquet(path)


def with_positions(ordered: DataFrame, out: str = "position", part: str = "part", place: str = "place") -> DataFrame:
    """Rows that ``write_ordered`` returned, ``part`` and ``place`` replaced by their
    position in the whole order, from 0."""
    counts = ordered.groupBy(part).agg(F.count(F.lit(1)).alias("_rows"))
    # one row a range
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(part).alias("_part"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    joined = ordered.join(offsets, F.col(part) == F.col("_part"))
    return joined.withColumn(out, F.col("_offset") + F.col(place)).drop("_part", "_offset", part, place)
