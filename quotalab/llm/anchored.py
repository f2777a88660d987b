"""Equal windows of a corpus brought together: each window has an anchor, the least gram inside it.

Equal windows have equal anchors at equal places. Windows of a text that follow each other and share an anchor's place
form a run; the words or bytes that its windows cover are its context. Two windows of one run are never equal, since they
see its anchor at different places. So a window can only repeat one of another run with the same anchor: either one with
the same context, which repeats it whole and needs no text at all, or one of a different context. Only the first place of
each distinct context has its text sent to the anchor's task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hashing import tidy
from .store import saved

KEY = ["key", "digest"]  # of a row: its id, and the hash of its text and whether it has an id
RUNS = "key long, digest long, lo int, hi int, anchor long, same long"
#: An anchor or a context with more than this share of all runs is hot: at most as many are, small enough to broadcast.
HOT_SHARE = 1000


def keyed(docs: DataFrame, id_col: str, text_col: str, *others: Column, no_id: int = 0) -> DataFrame:
    """(key, digest, text, ...): rows with one id and one text share their key, and what is found for them."""
    own, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return docs.select(F.coalesce(own, F.lit(no_id).cast("long")).alias("key"), F.xxhash64(text, own.isNull()).alias("digest"), text.alias("text"), *others)


def placed(runs: DataFrame) -> DataFrame:
    """The runs(key, digest, lo, hi, anchor, same) whose anchor has other runs too, with n, m and first.

    lo and hi are the first and last window, same the hash of the context; n counts the runs with this anchor and
    context, m the distinct contexts of the anchor, and first is true where no equal context stands earlier, by key,
    digest and lo. Anchors with few rows meet in one task; a hot anchor's contexts are counted before they meet.
    """
    runs = saved(runs, "runs")
    total = runs.count()
    same, place = ["anchor", "same"], [*KEY, "lo"]
    hot = runs.groupBy("anchor").count().where(F.col("count") * HOT_SHARE > total).select("anchor").collect()  # HOT_SHARE at most
    contexts = saved(runs.where(F.col("anchor").isin([r[0] for r in hot])).groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct(*place)).alias("least")), "contexts")
    distinct = F.broadcast(contexts.groupBy("anchor").agg(F.count("*").alias("of_anchor")))  # a row for each hot anchor
    often = F.broadcast(contexts.where(F.col("n") * HOT_SHARE > total).withColumnsRenamed({"n": "of_context"}))
    runs = runs.join(distinct, "anchor", "left").join(often, same, "left")
    # runs of a hot context are counted already and go anywhere, the others of a hot anchor by context, all else by anchor
    dealt = F.when(F.col("of_context").isNotNull(), F.xxhash64(*place)).when(F.col("of_anchor").isNotNull(), F.xxhash64(*same)).otherwise(F.col("anchor"))
    runs = runs.withColumn("dealt", dealt).repartition("dealt")
    context = Window.partitionBy("dealt", *same)
    in_order = context.orderBy(*place)
    runs = runs.withColumns({"n": F.count("*").over(context), "rank": F.rank().over(in_order), "lead": (F.row_number().over(in_order) == 1).cast("long")})
    runs = runs.withColumn("m", F.coalesce("of_anchor", F.sum("lead").over(Window.partitionBy("dealt", "anchor"))))
    first = F.coalesce(F.struct(*place) == F.col("least"), F.col("rank") == 1)
    return saved(runs.select(*KEY, "lo", "hi", *same, F.coalesce("of_context", "n").alias("n"), "m", first.alias("first")).where("n > 1 or m > 1"), "placed")


def factored(found: DataFrame, texts: DataFrame, contexts: Callable, compare: Callable, schema: str, per_index: int) -> DataFrame:
    """compare() over the contexts of placed() runs that differ, those of an anchor one after the other in their order.

    contexts() gives (key, digest, lo, anchor, part, parts, n, context) of rows (key, digest, text, runs). An anchor with
    more than per_index distinct contexts is dealt over parts by the hash of the context; what stands in two parts is left
    to the caller. Rows that share key and digest send their contexts more than once.
    """
    parts = F.ceil(F.col("m") / per_index).cast("int")
    own = F.struct("lo", "hi", "anchor", F.pmod("same", parts).cast("int").alias("part"), parts.alias("parts"), "n")
    wanted = found.where("first and m > 1").groupBy(*KEY).agg(F.collect_set(own).alias("runs"))
    sent = texts.join(wanted, KEY).select(*KEY, "text", "runs").mapInArrow(tidy(contexts), "key long, digest long, lo int, anchor long, part int, parts int, n long, context binary")
    return sent.repartition("anchor", "part").sortWithinPartitions("anchor", "part", *KEY, "lo").mapInArrow(tidy(compare), schema)
