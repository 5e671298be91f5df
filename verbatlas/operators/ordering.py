"""Places of rows in a total order, without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatlas.sources import tables

#: A value to sort by, and whether it rises.
Key = tuple[Column, bool]


def numbered(rows: DataFrame, order: list[Key], name: str = "place") -> DataFrame:
    """Add the 1-based place of every row in the order; equal to row_number over all rows. The order should end in a unique key.

    One sort by range, written once: a range's rows are consecutive, so that a place is the row's number in its range plus the rows of the ranges
    before. Only one row per range meets in a window. Nothing is joined by value, so nulls keep their rows.
    """
    packed = rows.select(F.struct(*rows.columns).alias("row"), *[value.alias(f"o{i}") for i, (value, _) in enumerate(order)])
    keys = [F.col(f"o{i}").asc_nulls_last() if up else F.col(f"o{i}").desc_nulls_last() for i, (_, up) in enumerate(order)]
    ranged = packed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("row", F.monotonically_increasing_id().alias("seq"))
    stored = tables.kept(ranged.withColumn("range", F.shiftright("seq", 33)), "ordered")
    sizes = stored.groupBy(F.col("range").alias("of")).agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    before = F.sum("n").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("of", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift"))
    return stored.join(starts, F.col("range") == F.col("of")).select("row.*", (F.col("seq") + F.col("shift")).alias(name))


def rising(value: str) -> Key:
    """By a column, smallest first, nulls last."""
    return F.col(value), True


def falling(value: str) -> Key:
    """By a column, largest first, nulls last."""
    return F.col(value), False
