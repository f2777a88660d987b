"""State tables as numbered snapshots: a new one is written whole before the pointer moves to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _names(spark: SparkSession, path: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    done = lambda s: fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
    return sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().startswith("v") and done(s))


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text of the driver in any file system that Spark knows, written anew."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(text.encode("utf-8"))
    finally:
        stream.close()


def read_snapshot(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The newest complete snapshot; an empty table before the first."""
    names = _names(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/{names[-1]}") if names else spark.createDataFrame([], schema)


def write_snapshot(df: DataFrame, path: str) -> int:
    """Write the next snapshot and return its number. It becomes visible when it is complete, so df may read the last one."""
    names = _names(df.sparkSession, path)
    number = int(names[-1][1:]) + 1 if names else 1
    df.write.mode("overwrite").parquet(f"{path}/v{number:08d}")
    return number
