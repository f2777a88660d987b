"""The history kept up to date from a stream of normalised orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.history import HISTORY
from ..operators.orders import consolidated
from ..operators.panel import PAIR, monthly
from ..plans.forecast import HISTORY as SCHEMA


def monthly_totals(orders: DataFrame) -> DataFrame:
    """History rows of a set of orders."""
    rows = monthly(consolidated(orders))
    totals = {"consumo_total": F.col("consumo_reg") + F.col("consumo_extra"), "demanda_total": F.col("demanda_reg") + F.col("demanda_extra")}
    return rows.withColumns(totals).select(*HISTORY)


def follow(orders: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write the sums of each micro-batch, and nothing else, to its own folder under path.

    Months may come in any number of batches, late or split: followed() adds the sums up. A batch that runs again
    replaces its own folder, so that no order counts twice.
    """

    def step(batch: DataFrame, number: int) -> None:
        monthly_totals(batch).write.mode("overwrite").parquet(f"{path}/lote={number}")

    return orders.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def followed(spark: SparkSession, path: str) -> DataFrame:
    """The history from all batches so far, in the columns of the history."""
    found = spark.read.schema(SCHEMA).option("basePath", path).parquet(path)
    keys = [c for c in HISTORY if not c.startswith(("consumo_", "demanda_"))]
    return found.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in HISTORY if c not in keys)).select(*HISTORY)


def windowed_demand(orders: DataFrame, late: str = "7 days", span: str = "7 days") -> DataFrame:
    """Demand of each pair by time window, as a stream: windows close when the watermark has passed them."""
    return (
        orders.withWatermark("data_solic", late)
        .groupBy(F.window("data_solic", span), *PAIR)
        .agg(F.sum("qtd_solic").alias("qtd_solic"), F.count("*").alias("n_pedidos"))
        .select(F.col("window.start").alias("inicio"), F.col("window.end").alias("fim"), *PAIR, "qtd_solic", "n_pedidos")
    )
