"""A keyed table in hash buckets, of which a refresh rewrites only those that it touches.

Rows lie in folders data/version=V/bucket=B. A manifest names, for each bucket, the
version that holds it; it is one small folder, and the version is there when Spark has
marked that folder as written whole. A job that is lost before leaves the version before
as it was, and its files are overwritten by the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialise

#: Keys of a batch, and bytes of them, that are sent to where the stored rows are read; beyond that both sides are shuffled.
SENT_KEYS, SENT_BYTES = 1_000_000, 32 << 20


class BucketedTable:
    """`key` names the table's key; `buckets` is fixed when the table is made, so that a bucket fits a task."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 256):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _folders(self, kind: str, whole: bool) -> list[int]:
        fs, root = self._fs(f"{self.path}/{kind}")
        if not fs.exists(root):
            return []
        found = [s.getPath() for s in fs.listStatus(root) if s.isDirectory()]
        return sorted(int(f.getName().split("=")[1]) for f in found if not whole or fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS")))

    def versions(self) -> list[int]:
        """The versions that were written whole and are still there."""
        return self._folders("manifest", True)

    def manifest(self, version: int | None = None) -> dict[int, int]:
        """The version of each bucket that has rows, as of a version (the last one); `buckets` entries at most."""
        known = self.versions()
        if not known:
            return {}
        at = known[-1] if version is None else version
        if at not in known:
            raise ValueError(f"there is no version {at} of {self.path}")
        return {r["bucket"]: r["held"] for r in self.spark.read.schema("bucket int, held int").json(f"{self.path}/manifest/version={at}").collect()}

    def _rows(self, held: dict[int, int]) -> DataFrame:
        """The rows of some buckets, with their bucket."""
        schema = self.spark.read.schema("fields string").text(f"{self.path}/schema").first()["fields"]
        base = f"{self.path}/data"
        paths = [f"{base}/version={v}/bucket={b}" for b, v in sorted(held.items())]
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, bucket int")
        return self.spark.read.option("basePath", base).schema(f"{schema}, version int, bucket int").parquet(*paths).drop("version")

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, the last one if none is given."""
        return self._rows(self.manifest(version)).drop("bucket")

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def _commit(self, version: int, held: dict[int, int]) -> None:
        self.spark.createDataFrame(sorted(held.items()), "bucket int, held int").coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/version={version}")

    def _write(self, rows: DataFrame, version: int) -> list[int]:
        """Write rows as a version's buckets; gives those that have rows."""
        folder = f"{self.path}/data/version={version}"
        rows.write.mode("overwrite").partitionBy("bucket").parquet(folder)
        return self._folders(f"data/version={version}", False)

    def create(self, rows: DataFrame) -> None:
        """The first version."""
        if self.versions():
            raise ValueError(f"{self.path} is there already")
        self.spark.createDataFrame([(rows.schema.toDDL(),)], "fields string").coalesce(1).write.mode("overwrite").text(f"{self.path}/schema")
        self._commit(1, dict.fromkeys(self._write(rows.withColumn("bucket", self._bucket()).repartition("bucket"), 1), 1))

    def refresh(self, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Write the next version: the stored rows whose keys the batch has go with the batch through `merge`, whose rows take their place; gives the buckets that were rewritten.

        Only the batch's buckets are read. Their other rows are copied as they are,
        where they are read: the keys of a batch of a checked size are broadcast. `merge`
        gets both sides without the bucket and gives rows of the table's columns, in
        any number (none removes a key). An empty batch writes nothing; a row without a key
        has no stored counterpart.
        """
        batch = materialise(batch)
        keys = materialise(batch.select(self.key, self._bucket()).distinct())
        touched = sorted(r["bucket"] for r in keys.select("bucket").distinct().collect())  # `buckets` at most
        if not touched:
            return []
        held, version = self.manifest(), self.versions()[-1] + 1
        size = keys.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col(self.key).cast("string"))), F.lit(0)).alias("b")).first()
        named = keys.select(self.key)
        if size["n"] <= SENT_KEYS and size["b"] <= SENT_BYTES:
            named = F.broadcast(named)
        stored = self._rows({b: held[b] for b in touched if b in held})
        columns = [c for c in stored.columns if c != "bucket"]
        mine = materialise(stored.join(named, self.key, "left_semi").select(*columns))
        merged = merge(mine, batch).select(*columns).withColumn("bucket", self._bucket()).repartition("bucket")
        rest = stored.join(named, self.key, "left_anti").select(*columns, "bucket")
        written = self._write(rest.unionByName(merged), version)
        beyond = set(written) - set(touched)
        if beyond:
            raise ValueError(f"the merge gave rows of keys that the batch does not have (buckets {sorted(beyond)[:5]})")
        self._commit(version, {b: v for b, v in held.items() if b not in touched} | dict.fromkeys(written, version))
        return touched

    def forget(self, keep: int = 2) -> int:
        """Delete all versions but the last `keep`, and the buckets that none of these names; gives how many folders went."""
        known = self.versions()
        last = known[-keep:]
        named = {(v, b) for k in last for b, v in self.manifest(k).items()}
        gone = [f"{self.path}/manifest/version={k}" for k in known if k not in last]
        for v in self._folders("data", False):
            if v <= max(known, default=0):
                gone += [f"{self.path}/data/version={v}/bucket={b}" for b in self._folders(f"data/version={v}", False) if (v, b) not in named]
        for path in gone:
            fs, at = self._fs(path)
            fs.delete(at, True)
        return len(gone)
