"""Sinks: CSV exports with a notice, JSON lines, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_cells(df: DataFrame, order: tuple[str, ...], limit: int) -> DataFrame:
    """(k, line): the rows of an export, at most `limit` of them, cells as JSON, text quoted and numbers not."""
    kinds = dict(df.dtypes)
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    cell = lambda c: F.coalesce(quoted(c) if kinds[c] == "string" else F.col(c).cast("string"), F.lit("null"))
    top = df.orderBy(*order).limit(limit)
    return top.select(F.concat_ws(",", *[cell(c) for c in df.columns]).alias("line"))


def write_csv_export(df: DataFrame, path: str, notice: str, order: tuple[str, ...], limit: int) -> None:
    """One CSV file whose first line is a comment with the notice; an export is limited, so one task writes it."""
    lines = json_cells(df, order, limit)
    head = df.sparkSession.createDataFrame([(f"# {notice}",), (",".join(df.columns),)], "line string")
    head.coalesce(1).union(lines.coalesce(1)).coalesce(1).write.text(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object to a line, nulls included."""
    df.write.option("ignoreNullFields", "false").json(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A report, a few rows, as one file with one JSON array; nulls included."""
    whole = rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("j")).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("j")), ","), F.lit("]")).alias("value"))
    whole.coalesce(1).write.text(path)


def add_counters(stored: DataFrame, more: DataFrame, key: tuple[str, ...], value: str) -> DataFrame:
    """Counters with increments added; new keys start at their increment."""
    return stored.select(*key, value).unionByName(more.select(*key, value)).groupBy(*key).agg(F.sum(value).alias(value))
