"""Tables that cut lineage: written to the folder that the whole cluster shares, then read again."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a batch of rows that Spark hands to a Python worker, unless the session's own limit is lower.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches: the default bounds their rows alone, whatever the length of the texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    set_ = re.fullmatch(r"(\d+)b?", spark.conf.get(name).lower())
    if not (set_ and 0 < int(set_[1]) < BATCH_BYTES):
        spark.conf.set(name, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a local one only where none is set and all tasks are local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path that is deleted when the driver ends."""
    path = new_path(spark, name)
    atexit.register(_forget, spark, path)
    return path


def posix_path(path: str) -> str:
    """The mounted path of a file: URI, for files that tasks map into memory."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a mounted shared folder, not {parts.scheme}://")
    return parts.path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back: later jobs start from the files."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files behind a table made by saved() that no later job reads."""
    paths = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for path in paths:
        _forget(df.sparkSession, path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone at exit; the shared folder's own clean-up then applies
        return
