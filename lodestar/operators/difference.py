"""The difference of two versions of a table as multisets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(columns, change): every distinct row whose number of occurrences differs, with how many more (or, below 0, fewer) `new` has.

    Rows are equal if all their values are, nulls being equal to nulls; both tables
    have the same columns, in any order, none of them a map. Counts of either side are
    signed and summed by the whole row: combined before one shuffle, so a row in a third of
    all is one row of each task.
    """
    signed = old.withColumn("change", F.lit(-1)).unionByName(new.withColumn("change", F.lit(1)))
    return signed.groupBy(*old.columns).agg(F.sum("change").alias("change")).filter("change <> 0")


def common(old: DataFrame, new: DataFrame) -> DataFrame:
    """(columns, n): every distinct row of both, with how often both have it (INTERSECT ALL)."""
    sides = old.withColumns({"a": F.lit(1), "b": F.lit(0)}).unionByName(new.withColumns({"a": F.lit(0), "b": F.lit(1)}))
    return sides.groupBy(*old.columns).agg(F.least(F.sum("a"), F.sum("b")).alias("n")).filter("n > 0")


def apply(old: DataFrame, change: DataFrame) -> DataFrame:
    """`old` with the changes: what `changes` said of the two versions makes the new one of the old."""
    counted = old.withColumn("change", F.lit(1).cast("long")).unionByName(change)
    left = counted.groupBy(*old.columns).agg(F.sum("change").alias("n")).filter("n > 0")
    return left.select(*old.columns, F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("n")).drop("n")
