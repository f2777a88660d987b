"""The drift of a model's errors as the state of a stream: new folds are taken in, old ones are never read again.

What the test needs is small: the number of errors, their sum and sum of squares, and the newest few by the order of fold
and pair. All of it is added up or merged in any order, so that errors may come late, and a model's errors are dealt over
parts that have a state each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import ForecastSettings

#: States that a model's errors are dealt over.
PARTS = 16
_NEWEST = "array<struct<fold:int,unidade:string,produto:string,erro:double>>"
_STATE = f"n long, s double, q double, ultimos {_NEWEST}"
_OUT = f"modelo string, parte int, {_STATE}"


def _update(window: int):
    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, s, q, newest = state.get if state.exists else (0, 0.0, 0.0, [])
        newest = [tuple(x) for x in newest]
        for rows in chunks:
            e = rows["abs_error"].to_numpy()
            n, s, q = n + len(e), s + float(e.sum()), q + float((e * e).sum())
            last = rows.sort_values(["fold", "unidade", "produto"]).tail(window)
            own = zip(last["fold"].tolist(), last["unidade"].tolist(), last["produto"].tolist(), last["abs_error"].tolist(), strict=True)
            newest = sorted([*newest, *own])[-window:]
        state.update((n, s, q, newest))
        yield pd.DataFrame({"modelo": [key[0]], "parte": [key[1]], "n": [n], "s": [s], "q": [q], "ultimos": [[dict(zip(("fold", "unidade", "produto", "erro"), x, strict=True)) for x in newest]]})

    return run


def follow_errors(errors: DataFrame, path: str, checkpoint: str, settings: ForecastSettings = ForecastSettings(), **trigger) -> StreamingQuery:
    """Take a stream of errors(modelo, fold, unidade, produto, abs_error) into the states; path gets those that change.

    Null errors are left out. A micro-batch that runs again replaces its own folder.
    """
    rows = errors.where("abs_error is not null").select("modelo", F.pmod(F.xxhash64("unidade", "produto"), F.lit(PARTS)).cast("int").alias("parte"), F.col("fold").cast("int").alias("fold"), "unidade", "produto", "abs_error")
    states = rows.groupBy("modelo", "parte").applyInPandasWithState(_update(settings.drift_window), _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)
    step = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/lote={number}")
    return states.writeStream.foreachBatch(step).outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def drift_of(spark: SparkSession, path: str, settings: ForecastSettings = ForecastSettings()) -> DataFrame:
    """A row for each model, in the columns of operators.history.drift(), from the newest state of each of its parts."""
    found = spark.read.option("basePath", path).schema(f"{_OUT}, lote long").parquet(path)
    newest = Window.partitionBy("modelo", "parte").orderBy(F.desc("lote"))  # a row for each batch
    parts = found.withColumn("at", F.row_number().over(newest)).where("at = 1")
    whole = parts.groupBy("modelo").agg(F.sum("n").alias("n_erros"), F.sum("s").alias("ws"), F.sum("q").alias("wq"), F.flatten(F.collect_list("ultimos")).alias("u"))
    last = F.slice(F.reverse(F.array_sort("u")), 1, settings.drift_window)
    total = lambda f: F.aggregate("last", F.lit(0.0), lambda a, x: a + f(x["erro"]))
    rows = whole.withColumn("last", last).withColumns({"k": F.size("last"), "rs": total(lambda v: v), "rq": total(lambda v: v * v)})
    n, mean = F.col("n_erros") - F.col("k"), F.col("media_anterior")
    steps = (
        {"media_recente": F.col("rs") / F.col("k"), "media_anterior": F.when(n > 0, (F.col("ws") - F.col("rs")) / n)},
        {"spread": F.when(n > 1, F.sqrt(F.greatest((F.col("wq") - F.col("rq")) / n - mean * mean, F.lit(0.0)))).otherwise(1.0)},
        {"z": F.when(F.col("n_erros") >= settings.drift_window + 2, (F.col("media_recente") - mean) / (F.col("spread") + 1e-9))},
    )
    out = reduce(lambda df, more: df.withColumns(more), steps, rows)
    return out.select("modelo", "n_erros", "media_recente", "media_anterior", "z", F.coalesce(F.abs("z") > settings.drift_z, F.lit(False)).alias("recalibrar"))
