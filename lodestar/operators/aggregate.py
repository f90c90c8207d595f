"""Aggregations over shipments, entities and daily series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouped(rows: DataFrame, key: Column, name: str, measures: Mapping[str, Column], order_by: str | None = None, top: int | None = None) -> DataFrame:
    """Measures by one key; with `order_by`, the `top` groups with the largest of that measure (ties by key)."""
    out = rows.groupBy(key.alias(name)).agg(*[m.alias(k) for k, m in measures.items()])
    return out.orderBy(F.desc_nulls_last(order_by), F.asc_nulls_first(name)).limit(top) if order_by and top else out


def counted_where(rows: DataFrame, tests: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """How many rows pass each test, all in one scan."""
    return rows.groupBy(*by).agg(*[F.count_if(t).alias(k) for k, t in tests.items()])


def daily_spine(spark, last: str, days: int) -> DataFrame:
    """One row for each of the last `days` days."""
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(F.to_date(F.lit(last)), days - 1), F.to_date(F.lit(last)))).alias("day"))


def on_spine(spine: DataFrame, series: Mapping[str, DataFrame]) -> DataFrame:
    """The spine with a count column for each series (day, n), zero where there is none."""
    for name, rows in series.items():
        spine = spine.join(rows.select("day", F.col("n").alias(name)), "day", "left")
    return spine.fillna(0, list(series))


def histogram(value: Column, width: int, last: int) -> Column:
    """Bucket number of a whole number from 0 on; all beyond the last bucket count there."""
    return F.least(F.lit(last), F.floor(value / width)).cast("long")


def trade_flow(flows: DataFrame, world: str) -> DataFrame:
    """By partner the sum of the first value that is not zero, with the grand total beside it.

    The partner `world` is no row of its own; its largest value is the total, and
    if that is missing or zero the sum of all partners is.
    """
    value = F.coalesce(F.nullif("fob", F.lit(0)), F.nullif("cif", F.lit(0)), F.col("other"), F.lit(0))
    by = flows.groupBy("partner").agg(F.sum(value).alias("value"), F.max(value).alias("largest"), F.sum(F.coalesce("weight", F.lit(0))).alias("weight"))
    total = by.agg(F.max(F.when(F.col("partner") == world, F.col("largest"))).alias("w"), F.sum(F.when(F.col("partner") != world, F.col("value"))).alias("s"))
    one = total.select(F.coalesce(F.nullif("w", F.lit(0)), "s").alias("total"))
    return by.filter(F.col("partner") != world).select("partner", "value", "weight").join(F.broadcast(one), F.lit(True))  # a single row
