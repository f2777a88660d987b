"""Places of rows in a global order without one task that sorts them all, and draws that hit such places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed

_INSIDE = (1 << 33) - 1  # monotonically_increasing_id() has the partition above these bits


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rows with rank, their place from 0 in the given order, and n, the number of all rows. Ties have any order.

    Rows are range-partitioned and sorted where they are; a table of one row for each partition gives the rows before it.
    """
    placed = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("rank", F.monotonically_increasing_id()))
    counts = placed.groupBy(F.shiftright("rank", 33).alias("part")).agg(F.count("*").alias("own"))
    by = Window.orderBy("part")  # as many rows as partitions
    counts = counts.select("part", (F.sum("own").over(by) - F.col("own")).alias("before"), F.sum("own").over(Window.partitionBy(F.lit(0))).alias("n"))
    out = placed.withColumn("part", F.shiftright("rank", 33)).join(F.broadcast(counts), "part")
    return out.withColumn("rank", F.col("before") + F.col("rank").bitwiseAND(_INSIDE)).select(*rows.columns, "rank", "n")


def drawn_place(size: Column, seed: int, *parts: Column) -> Column:
    """A place below size from the MD5 digest of the parts and the seed, whatever the partitions."""
    text = F.concat_ws("|", *(p.cast("string") for p in parts), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % size
