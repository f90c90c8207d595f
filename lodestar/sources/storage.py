"""The folder that the driver and all executors share, and steps written to it."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Steps by application, in the order of their writing.
_STEPS: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine only where that is unset and all of Spark runs on it, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = set_dir.get() if set_dir.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + os.path.join(tempfile.mkdtemp(prefix="spark-"), "shared")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write a step once to the shared folder and read it back: lineage is cut and a lost executor loses nothing."""
    path = new_path(df.sparkSession, "step")
    _STEPS.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_steps(spark: SparkSession) -> int:
    """How many steps this application has written and not cleared."""
    return len(_STEPS.get(spark.sparkContext.applicationId, []))


def clear_steps(spark: SparkSession, kept: int = 0, since: int = 0) -> int:
    """Delete the steps that this application has written after its first `since`, but for the last `kept`; gives how many went.

    Call it when the results that read them have been written.
    """
    jvm, written = spark._jvm, _STEPS.get(spark.sparkContext.applicationId, [])
    gone = written[since : max(since, len(written) - kept)]
    for path in gone:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    del written[since : since + len(gone)]
    return len(gone)
