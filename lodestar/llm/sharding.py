"""Shards in a global random order, by a two-pass external shuffle (operator 2).

Pass 1 scatters the records uniformly into buckets that fit in memory, by a
seeded hash of key and text, and writes them. Pass 2 shuffles each bucket by
Fisher-Yates with a generator seeded by (seed, bucket). The buckets, one after
the other, are a random permutation of all records; position p goes to shard
p mod n, slot p div n, so shard sizes differ by one at most (law `rows`).

Records of equal key and text are numbered where there are many of them, and the
number joins the hash, so that no bucket grows with a group of copies. The first
place of each bucket comes from a count per bucket (one small row per bucket,
summed in two levels) of what pass 1 wrote, never from a global sort.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .text import materialise, table

#: Bytes of text that a bucket holds on average, at most; and the buckets of a table that would need fewer.
BUCKET_BYTES, LEAST_BUCKETS = 16 << 20, 256
#: Records of equal key and text that share a hash: a bucket takes so many of one group on average.
GROUP_ROWS = 256
#: Groups that may be numbered: those with more than one part in so many of all records.
MOST_GROUPS = 1_000_000
_BLOCK = 1024


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniform permutation of n places."""
    return np.random.Generator(np.random.PCG64(seed)).permutation(n)


def _bucket_starts(sizes: DataFrame) -> DataFrame:
    """(__bucket, __start): records in the buckets before."""
    blocks = sizes.withColumn("block", F.col("__bucket").cast("long") / _BLOCK).withColumn("block", F.floor("block"))
    inner = blocks.withColumn("before", F.sum("n").over(W.partitionBy("block").orderBy("__bucket")) - F.col("n"))
    totals = blocks.groupBy("block").agg(F.sum("n").alias("n"))  # a row for 1,024 buckets, so for about 16 GB of text
    starts = totals.select("block", (F.sum("n").over(W.orderBy("block")) - F.col("n")).alias("base"))
    return inner.join(starts, "block").select("__bucket", (F.col("base") + F.col("before")).alias("__start"))


def _numbered(docs: DataFrame, seed: int, n_rows: int, row: Column) -> DataFrame:
    """`docs` with __row: the hash of a record, and of its number where its group of equals has many records."""
    keyed = docs.withColumn("__row", row)
    least = max(GROUP_ROWS, n_rows // MOST_GROUPS)
    groups = materialise(keyed.groupBy("__row").agg(F.count("*").alias("n")).filter(F.col("n") > least).select("__row"))
    if groups.isEmpty():
        return keyed
    groups = F.broadcast(groups)  # MOST_GROUPS numbers at most
    written = materialise(keyed.join(groups, "__row", "left_semi").withColumn("__at", F.monotonically_increasing_id()))
    # a number within the group: what the parts of the input before hold of it, and the place in the own part
    part = F.shiftright("__at", 33)
    parts = written.groupBy("__row", part.alias("__part")).agg(F.count("*").alias("n"))
    before = parts.select("__row", "__part", (F.sum("n").over(W.partitionBy("__row").orderBy("__part")) - F.col("n")).alias("__before"))
    within = F.row_number().over(W.partitionBy("__row", "__part").orderBy("__at"))
    placed = written.withColumn("__part", part).withColumn("__within", within).join(before, ["__row", "__part"])
    number = F.floor((F.col("__before") + F.col("__within") - 1) / GROUP_ROWS)
    return keyed.join(groups, "__row", "left_anti").unionByName(placed.select(*docs.columns, F.xxhash64(F.lit(seed), "__row", number).alias("__row")))


def shuffle_shards(docs: DataFrame, n_shards: int, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of `docs` with its shard (int) and its slot (long) there, in place of columns of those names.

    The order depends on the seed, the keys and the texts, not on how the input
    is split nor on any setting; rows of equal key and text may take each other's
    places. A null key or text is a value like others; a very long text is one
    record in one bucket. An empty table gives an empty result; further columns
    pass through (names that begin with two underscores are used inside). The
    scattered records are written when this is called.
    """
    docs = docs.select(*[c for c in docs.columns if c not in ("shard", "slot")])
    total = docs.select(F.sum(F.octet_length(text)), F.count("*")).first()
    n_buckets = max(LEAST_BUCKETS, math.ceil(((total[0] or 0) + 64 * total[1]) / bucket_bytes))
    rows = _numbered(docs, seed, total[1], F.xxhash64(F.lit(seed), key, text))
    placed = materialise(rows.withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "__row"), F.lit(n_buckets)).cast("int")))
    starts = _bucket_starts(placed.groupBy("__bucket").agg(F.count("*").alias("n")))
    spread = placed.join(starts, "__bucket")

    columns = docs.columns

    def pass_two(bucket: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((bucket[text].map(lambda t: "" if t is None else t).to_numpy(), bucket["__row"].to_numpy()))
        number = int(bucket["__bucket"].iat[0])
        place = np.empty(len(order), np.int64)
        place[order] = fisher_yates(len(order), seed * 1_000_003 + number)
        place += int(bucket["__start"].iat[0])
        bucket["shard"], bucket["slot"] = (place % n_shards).astype(np.int32), place // n_shards
        return bucket[[*columns, "shard", "slot"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", shard int, slot long"
    return spread.groupBy("__bucket").applyInPandas(pass_two, schema)


def write_shards(docs: DataFrame, path: str, n_shards: int, rows_per_file: int = 1 << 20, **options) -> DataFrame:
    """Write the shards as folders shard=k, each file with consecutive slots in their order (`rows_per_file`, or several such runs); gives what was written."""
    run = F.floor(F.col("slot") / rows_per_file)
    shuffle_shards(docs, n_shards, **options).repartition("shard", run).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards."""
    placed = shuffle_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), 24)
    return placed.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


