"""As-of and interval joins: what was in force at a time, and which spans overlap.

Neither compares every row of a key with every other. As-of is one shuffle and one sort of
both sides together, along which the last value is carried; a key with very many rows
is cut into blocks of time, and each block begins with the value that the blocks
before it end with. Overlaps are found in bins as wide as the longer span of a pair, so a
span lies in two bins of each width at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of both sides that one task sorts of one key, as far as times differ.
BLOCK = 1_000_000


def _width(rows: DataFrame, by: Sequence[str], low: int, high: int) -> int:
    """The widest of halved blocks of time of which no key has more than BLOCK rows in one."""
    width = max(1, high - low + 1)
    while width > 1:
        most = rows.groupBy(*by, F.floor((F.col("__t") - low) / width)).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= BLOCK:
            break
        width = -(-width // 2)
    return width


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], at: Column, since: Column, values: Sequence[str], tie: Column | None = None) -> DataFrame:
    """Every row of `left` with the `values` of the last row of `right` with its key whose `since` is not after its `at`; nulls where there is none.

    `at` and `since` are whole numbers (as F.unix_micros gives). Of rows of equal
    `since` the one with the largest `tie` counts, and of equal ties an arbitrary one. Rows
    without a key or a time stay with nulls, and such rows of `right` count for
    nothing. Columns of `left` with the names of values are replaced. The sizes of keys are counted when this is called.
    """
    by, own = list(by), [c for c in left.columns if c not in values]
    value = F.struct(*[F.col(c).alias(c) for c in values])
    known = F.lit(True)
    for c in by:
        known &= F.col(c).isNotNull()
    marks = right.filter(known & since.isNotNull()).select(*by, since.cast("long").alias("__t"), (tie if tie is not None else F.lit(0)).alias("__tie"), value.alias("__value"))
    asked = left.select(*own, at.cast("long").alias("__t"), F.lit(True).alias("__asked"))
    told = known & F.col("__t").isNotNull()
    rest = asked.filter(~told).select(*own, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in values])
    asked = asked.filter(told)
    both = marks.select(*by, "__t").unionByName(asked.select(*by, "__t")).filter("__t is not null")
    low, high = both.agg(F.min("__t"), F.max("__t")).first()
    width = _width(both, by, low, high) if low is not None else 1
    block = F.floor((F.col("__t") - F.lit(low or 0)) / width)
    marks, asked = marks.withColumn("__block", block), asked.withColumn("__block", block)
    # what each block ends with is what the ones after it begin with
    ends = marks.groupBy(*by, "__block").agg(F.max_by("__value", F.struct("__t", "__tie")).alias("__value"))
    before = W.partitionBy(*by).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    needed = ends.unionByName(asked.select(*by, "__block").distinct().withColumn("__value", F.lit(None).cast(ends.schema["__value"].dataType)))
    starts = needed.groupBy(*by, "__block").agg(F.max_by("__value", F.col("__value").isNotNull()).alias("__value"))
    starts = starts.withColumn("__value", F.last("__value", ignorenulls=True).over(before)).filter("__value is not null").withColumn("__first", F.lit(True))
    rows = asked.unionByName(marks, allowMissingColumns=True).unionByName(starts, allowMissingColumns=True)
    order = W.partitionBy(*by, "__block").orderBy(F.col("__first").desc_nulls_last(), "__t", F.col("__asked").asc_nulls_first(), "__tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = F.last("__value", ignorenulls=True).over(order)
    found = rows.withColumn("__value", last).filter("__asked")
    return found.select(*own, *[F.col(f"__value.{c}").alias(c) for c in values]).unionByName(rest)



def overlapping(left: DataFrame, right: DataFrame, by: Sequence[str], spans: tuple[str, str], others: tuple[str, str]) -> DataFrame:
    """All pairs of rows with equal keys whose half-open spans overlap: the columns of `left`, and those of `right` but the keys.

    `spans` and `others` name the begin and the end of a span on either side, whole numbers;
    no other column may be on both sides. Empty spans, and rows with nulls in keys or spans, are in no pair.
    """
    by = list(by)
    (a, z), (b, y) = spans, others

    def level(begin: str, end: str) -> Column:
        """The power of two that a span is no longer than."""
        return F.ceil(F.log2((F.col(end) - F.col(begin)).cast("double"))).cast("int")

    mine = left.filter(F.col(z) > F.col(a)).withColumn("__own", level(a, z))
    theirs = right.filter(F.col(y) > F.col(b)).withColumn("__other", level(b, y))
    # widths that occur: one for each doubling of the span at most, so 64
    levels = sorted({r[0] for side, c in ((mine, "__own"), (theirs, "__other")) for r in side.select(c).distinct().collect()})

    wide = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__level"))

    def binned(side: DataFrame, begin: str, end: str, own: str) -> DataFrame:
        at = F.filter(F.array(*[F.lit(k) for k in levels]) if levels else F.array().cast("array<int>"), lambda k: k >= F.col(own))
        cut = side.withColumn("__level", F.explode(at))
        first, last = F.floor(F.col(begin) / wide), F.floor((F.col(end) - 1) / wide)
        return cut.withColumn("__bin", F.explode(F.sequence(first, last)))

    p, q = binned(mine, a, z, "__own"), binned(theirs, b, y, "__other")
    pairs = p.join(q, [*by, "__level", "__bin"])
    # a pair is looked at in bins of the longer span's width, and counts where the later of the two begins
    there = (F.greatest("__own", "__other") == F.col("__level")) & (F.floor(F.greatest(a, b) / wide) == F.col("__bin"))
    return pairs.filter(there & (F.col(a) < F.col(y)) & (F.col(b) < F.col(z))).select(*left.columns, *[c for c in right.columns if c not in by])
