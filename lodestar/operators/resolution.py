"""Entity resolution: folds of the rows of one key, in the order in which they came."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scoring import first_reason


def content_hash(name: Column, country: Column) -> Column:
    """The key of an entity across sources: name without case, punctuation and extra space, and country."""
    folded = F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9]+", " "))
    return F.md5(F.concat(folded, F.lit("|"), F.lower(F.coalesce(country, F.lit("")))))


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order; Spark cuts each key to one row in every task before the shuffle."""
    rank = W.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(rank)).filter("`__rn` = 1").drop("__rn")


def _filled(column: str, newest: bool, order: str) -> Column:
    """The first or last value that is not null, as a partial aggregate."""
    pick = F.max_by if newest else F.min_by
    return pick(F.col(column), F.when(F.col(column).isNotNull(), F.col(order)))


def merge_cross_source(rows: DataFrame, key: str = "hash", order: str = "seq") -> DataFrame:
    """One row for each key over all sources: what came first is kept, codes and sources are united.

    Confidence starts with the first row's and with every further source becomes
    min(100, max(so far, new) + 5). The fold is over one row for each source of a
    key, so its list is as short as the sources are few; of code lists each
    different one is held once.
    """
    by_source = rows.groupBy(key, "source").agg(
        F.min(order).alias(order), F.max("confidence").alias("confidence"), F.collect_set("codes").alias("lists"), *[_filled(c, False, order).alias(c) for c in ("name", "email", "phone", "website")],
    )
    fold = F.aggregate(F.array_sort(F.collect_list(F.struct(order, "source", F.col("confidence").cast("long").alias("c")))), F.lit(-1).cast("long"), lambda a, x: F.when(a < 0, x["c"]).otherwise(F.least(F.lit(100).cast("long"), F.greatest(a, x["c"]) + 5)))
    return by_source.groupBy(key).agg(
        *[_filled(c, False, order).alias(c) for c in ("name", "email", "phone", "website")], fold.alias("confidence"),
        F.array_sort(F.array_distinct(F.flatten(F.flatten(F.collect_list("lists"))))).alias("codes"), F.array_sort(F.collect_set("source")).alias("sources"),
    )


def merge_same_source(rows: DataFrame, key: Sequence[str], keep_old: Sequence[str], take_new: Sequence[str], order: str = "seq") -> DataFrame:
    """One row for each key of one source: some columns keep the oldest value, others take the newest, nulls never count."""
    return rows.groupBy(*key).agg(*[_filled(c, False, order).alias(c) for c in keep_old], *[_filled(c, True, order).alias(c) for c in take_new], F.max("confidence").alias("confidence"))


def merge_provenance(rows: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """The first e-mail of each key together with the status and the page that came with it."""
    unit = F.struct("email", "email_status", "email_url")
    first = F.min_by(unit, F.when(F.col("email").isNotNull(), F.col(order)))
    return rows.groupBy(key).agg(first.alias("u")).select(key, "u.email", "u.email_status", "u.email_url")


def insert_ignore(new: DataFrame, existing: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows of `new` whose key is not there yet, one for each key."""
    return latest(new.join(existing.select(*key), list(key), "left_anti"), key, order)


def upsert_status(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Each new row with what a writer does with it: insert, merge (other source), update (same source) or duplicate (seen in this batch)."""
    first = F.row_number().over(W.partitionBy(key, "source").orderBy("seq"))
    old = known.groupBy(key).agg(F.collect_set("source").alias("__sources"))
    same = F.array_contains("__sources", F.col("source"))
    action = F.when(F.col("__first") > 1, "duplicate").when(F.col("__sources").isNull(), "insert").when(same, "update").otherwise("merge")
    return new.withColumn("__first", first).join(old, key, "left").withColumn("action", action).drop("__first", "__sources")


def purge(rows: DataFrame, rules: Sequence[tuple[str, Column]], key: str, order: str) -> DataFrame:
    """`rows` with `reason`: the first rule that removes the row, else `duplicate` if a newer row of its key is left too, else `kept`; a row without a key is no duplicate."""
    judged = rows.withColumn("reason", first_reason(list(rules)))
    newest = judged.filter(F.col("reason").isNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(order).alias("__newest"))
    older = F.col("reason").isNull() & (F.col(order) < F.col("__newest"))
    return judged.join(newest, key, "left").withColumn("reason", F.coalesce("reason", F.when(older, "duplicate").otherwise("kept"))).drop("__newest")


def upsert(stored: DataFrame, batch: DataFrame, key: str = "hash", order: str = "seq") -> DataFrame:
    """The merged table after a batch: `stored` is what merge_cross_source gave before, and its values come first.

    A source that a stored row already counts raises its confidence to the new
    value at most; a new source merges. One shuffle by key for both sides.
    """
    fields = ["name", "email", "phone", "website"]
    by_source = batch.groupBy(key, "source").agg(F.min(order).alias(order), F.max("confidence").cast("long").alias("confidence"), F.collect_set("codes").alias("lists"), *[_filled(c, False, order).alias(c) for c in fields])
    new = by_source.groupBy(key).agg(
        *[_filled(c, False, order).alias(f"__{c}") for c in fields], F.array_sort(F.collect_list(F.struct(order, "source", F.col("confidence").alias("c")))).alias("__steps"),
        F.flatten(F.flatten(F.collect_list("lists"))).alias("__codes"), F.collect_set("source").alias("__sources"),
    )
    both = stored.join(new, key, "full")
    none = F.array().cast("array<string>")
    known = F.coalesce("sources", none)
    step = lambda a, x: F.when(a < 0, x["c"]).when(F.array_contains(known, x["source"]), F.greatest(a, x["c"])).otherwise(F.least(F.lit(100).cast("long"), F.greatest(a, x["c"]) + 5))
    steps = F.coalesce("__steps", F.array().cast(f"array<struct<{order}:bigint,source:string,c:bigint>>"))
    confidence = F.aggregate(steps, F.coalesce("confidence", F.lit(-1)).cast("long"), step)
    union = lambda a, b: F.array_sort(F.array_union(F.coalesce(a, none), F.coalesce(b, none)))
    return both.select(key, *[F.coalesce(c, f"__{c}").alias(c) for c in fields], confidence.alias("confidence"), union("codes", "__codes").alias("codes"), union("sources", "__sources").alias("sources"))


def write_table(table: DataFrame, path: str) -> None:
    """Write the next version of a table beside those before; readers of one see it whole, and a lost job leaves nothing."""
    version = int(current(table.sparkSession, path).rsplit("=", 1)[1]) + 1 if current(table.sparkSession, path) else 1
    table.write.parquet(f"{path}/version={version}")


def current(spark, path: str) -> str | None:
    """The folder of the last version that was written whole; None if there is none."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    folders = [s.getPath() for s in fs.listStatus(root)]
    done = [int(f.getName().split("=")[1]) for f in folders if f.getName().startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]
    return f"{path}/version={max(done)}" if done else None


def append_children(stored: DataFrame, batch: DataFrame, key: Sequence[str], parents: DataFrame, parent: str) -> DataFrame:
    """`stored` and the rows of `batch` that are new by `key` and whose parent is there, each once."""
    new = batch.join(parents.select(parent), parent, "left_semi").dropDuplicates(list(key)).join(stored.select(*key), list(key), "left_anti")
    return stored.unionByName(new)
