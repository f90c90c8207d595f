"""Streams of account events: first notices, counters, quotas, windows."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import new_path


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The events of a folder or a file as they come; `ts` in UTC.

    What is there at the start is one batch, of however many files: files come by
    the time of writing, and a batch of some of them would be out of the order of
    `ts`, so that folds would take rows too early and watermarks drop others.
    """
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # a stream reads a single file only by a pattern
    return spark.readStream.schema(schema).parquet(pattern).withColumn("ts", F.col("ts").cast("timestamp"))


def first_notices(events: DataFrame, key: str = "event_key", late: str | None = None) -> DataFrame:
    """Each notice once, however late; the state holds every key.

    With `late`, state is kept only as long as a repeat may be late; a first
    notice that is later than that behind the latest `ts` of the batches before
    is lost.
    """
    if late is None:
        return events.dropDuplicates([key])
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def usage_counters(events: DataFrame) -> DataFrame:
    """Units by day and meter."""
    return events.groupBy(F.to_date("ts").cast("string").alias("day"), F.col("event_type").alias("meter")).agg(F.count("*").alias("used"))


def windowed(events: DataFrame, window: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Events by tumbling or sliding window and kind."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", window, slide or window), "event_type").agg(F.count("*").alias("n"))
    return by.select(F.unix_seconds("window.start").alias("begin"), "event_type", "n")


def closed(events: DataFrame, end: str) -> DataFrame:
    """A stream with one more row, of nulls but for `ts`, that carries the watermark to `end`: so what is open when a stored table ends is given out.

    The row itself stays open. (A filter on it would move below the watermark.)
    """
    spark, path = events.sparkSession, new_path(events.sparkSession, "end")
    row = [F.lit(end).cast(f.dataType).alias(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema]
    spark.range(1).select(*row).write.parquet(path)
    return events.unionByName(spark.readStream.schema(events.schema).parquet(path))


def sessions(events: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    """Sessions of accounts: events no further apart than the gap; a session is given out, and leaves the state, when the watermark has passed its end."""
    by = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return by.select("user_id", F.unix_micros("session_window.start").alias("begin"), "n")


def run_quotas(events: DataFrame, limits: Mapping[str, int], rates: Mapping[str, int]) -> DataFrame:
    """(account, event_id, accepted, balance): what becomes of each request of a stream, with quota and balance of its account as state.

    `events` has account, event_id, ts, meter (null for a top-up), n and amount.
    A batch's rows are sorted by Spark, the state of each account before its rows,
    and folded as they come, so an account may have any number of rows. A row that
    comes in a later batch is taken after all before, whatever its ts, as what was
    answered stands. A request that the balance cannot pay takes nothing. Answers
    and state of a batch are written as one folder named by the batch, from the
    folder of the batch before: a batch that is run again replaces its own.
    """
    spark, out = events.sparkSession, new_path(events.sparkSession, "quotas")
    schema = "account long, event_id long, accepted boolean, balance long, used string"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        account, balance, used = None, 0, {}
        closing = lambda: [(account, None, None, balance, json.dumps(used))] if account is not None else []
        for b in batches:
            rows = []
            for a, event, meter, n, amount, kept, held in zip(b["account"], b["event_id"], b["meter"], b["n"], b["amount"], b["balance"], b["used"], strict=True):
                if a != account:
                    rows += closing()
                    account, balance, used = a, 0, {}
                if isinstance(held, str):
                    balance, used = int(kept), json.loads(held)
                elif not isinstance(meter, str):
                    balance += int(amount)
                    rows.append((a, event, True, balance, None))
                else:
                    n = int(n)
                    free = max(0, min(n, limits[meter] - used.get(meter, 0)))
                    cost = (n - free) * rates[meter]
                    if accepted := cost <= balance:
                        used[meter], balance = used.get(meter, 0) + n, balance - cost
                    rows.append((a, event, accepted, balance, None))
            yield _quota_rows(rows)
        yield _quota_rows(closing())

    def step(batch: DataFrame, number: int) -> None:
        new = batch.select("account", "event_id", "ts", "meter", "n", "amount", F.lit(None).cast("long").alias("balance"), F.lit(None).cast("string").alias("used"))
        if number:
            before = spark.read.schema(schema).parquet(f"{out}/batch={number - 1}").filter("event_id is null")
            new = new.unionByName(before.select("account", "balance", "used"), allowMissingColumns=True)
        laid = new.repartition("account").sortWithinPartitions("account", F.col("used").isNull(), "ts", "event_id")
        laid.mapInPandas(fold, schema).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = events.writeStream.option("checkpointLocation", f"{out}-state").trigger(availableNow=True)
    writer.foreachBatch(step).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/batch=*").filter("event_id is not null").drop("used")


def _quota_rows(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["account", "event_id", "accepted", "balance", "used"])
    return out.astype({"account": "Int64", "event_id": "Int64", "accepted": "boolean", "balance": "Int64", "used": object})


def run_available(stream: DataFrame, mode: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Run a stream over what is there, and read what it wrote.

    Appended rows go to a Parquet sink, exactly once. With `update`, each batch
    writes only the keys that it changed, in a folder of its own that a second run
    replaces, and the last value of each key counts; what the watermark has passed
    leaves the state. A complete result replaces the one before, and keeps all
    state. Checkpoint and result lie in the shared folder.
    """
    spark = stream.sparkSession
    out = new_path(spark, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{out}/rows").start()
    elif mode == "update":
        query = writer.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{out}/rows/batch={k}")).start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{out}/rows")).start()
    query.awaitTermination()
    if mode != "update":
        return spark.read.schema(stream.schema).parquet(f"{out}/rows")
    rows = spark.read.schema(f"{stream.schema.toDDL()}, batch long").parquet(f"{out}/rows")
    values = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*[c if c in keys else f"v.{c}" for c in stream.columns])
