"""Counts, distinct counts and percentiles that are kept by day and merge to any span.

A day's rows of a key become one row: sums, which are exact, and two sketches, a HyperLogLog
of distinct values and a KLL of a number's distribution, each of a few kilobytes
however many rows there are. Any span, or any set of keys, is then a merge of such rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base-two logarithm of the HyperLogLog's registers (relative error about 1.04 / sqrt(2 ** 14), 0.8 %), and the KLL's size (rank error about 0.65 % at 400).
HLL, KLL = 14, 400
#: What an estimate may be off: part of the distinct count, part of the ranks.
HLL_ERROR, KLL_ERROR = 0.03, 0.02


def summaries(rows: DataFrame, by: Sequence[str], who: str, number: str) -> DataFrame:
    """(by, n, total, distinct_sketch, rank_sketch): one row for each group, to be written and kept."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(number).alias("total"), F.hll_sketch_agg(who, F.lit(HLL)).alias("distinct_sketch"), F.kll_sketch_agg_bigint(number, F.lit(KLL)).alias("rank_sketch"))


def merged(kept: DataFrame, by: Sequence[str], within: Column | None = None) -> DataFrame:
    """`summaries` of larger groups from those of smaller ones, of the rows within a condition (a span of days)."""
    rows = kept if within is None else kept.filter(within)
    return rows.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_bigint("rank_sketch").alias("rank_sketch"))


def estimates(kept: DataFrame, ranks: Sequence[float] = (0.5,)) -> DataFrame:
    """The groups of `summaries` with `distinct`, and `quantiles`, an array by rank, instead of the sketches."""
    at = F.array(*[F.kll_sketch_get_quantile_bigint("rank_sketch", F.lit(float(r))) for r in ranks])
    return kept.withColumns({"distinct": F.hll_sketch_estimate("distinct_sketch"), "quantiles": at}).drop("distinct_sketch", "rank_sketch")


def totals(rows: DataFrame, by: Sequence[str], number: str, how: str = "cube") -> DataFrame:
    """(by, level, n, total): exact counts and sums of all combinations of the groups (`cube`), or of each beginning of them (`rollup`), in one pass; `level` tells a group of nulls from all groups."""
    grouped = rows.cube(*by) if how == "cube" else rows.rollup(*by)
    return grouped.agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum(number).alias("total")).select(*by, "level", "n", "total")
