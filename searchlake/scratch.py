"""Tables written to the cluster's shared folder to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .errors import StorageError


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset a local master, as in tests, gets a new one; a cluster must name one that all its machines share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise StorageError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="searchlake-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read from there."""
    path = f"{shared_dir(df.sparkSession)}/searchlake-{name}-{uuid.uuid4().hex[:12]}"
    schema = df.schema
    _written.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


#: What written() made; it stays while the driver lives, since returned DataFrames read it.
_written: list[tuple[SparkSession, str]] = []


@atexit.register
def _clear() -> None:
    for spark, path in _written:
        sc = spark.sparkContext
        if sc._jsc is not None:
            try:
                p = sc._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
            except Exception:  # the JVM is gone; nothing is left to tell
                return
