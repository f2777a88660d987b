"""The order ledger derived from the warehouse tables lineitem, orders, part, supplier and nation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.numbers import first_match
from ..functions.text import month

#: The last four complete months of the data; 2001-08 has one day.
MONTHS = ("2001-04", "2001-05", "2001-06", "2001-07")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ledger(spark: SparkSession, folder: str, months: tuple[str, ...] | None = None) -> DataFrame:
    """One row for each line item, named and typed as normalised orders.

    With months, which must follow one another, a range of dates that reaches the scan of orders.
    """
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    if months:
        first, last = f"{months[0]}-01", F.add_months(F.lit(f"{months[-1]}-01").cast("date"), 1)
        orders = orders.where((F.col("o_orderdate") >= F.lit(first).cast("timestamp_ntz")) & (F.col("o_orderdate") < last.cast("timestamp_ntz")))
    c, status, sent = F.col, F.col("status"), F.col("qtd_env")
    settings = Settings()
    # small tables are joined one by one, so that Spark knows their sizes; line items are shuffled with few columns
    items = table(spark, folder, "lineitem").join(table(spark, folder, "supplier").select("s_suppkey", "s_nationkey"), c("l_suppkey") == c("s_suppkey"))
    items = items.select("l_orderkey", "l_partkey", "s_nationkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", (c("l_suppkey") % 13 == 0).alias("one_more"))
    rows = items.join(orders, c("l_orderkey") == c("o_orderkey"))
    rows = rows.withColumn(
        "status",
        first_match(
            F.when(c("l_returnflag") == "N", "Pendente").when(c("l_returnflag") == "A", "Aprovado").otherwise("Aguardando Gerente"),
            ((c("o_orderpriority") == "5-LOW") & (c("l_returnflag") == "R"), "Rejeitado"),
            (c("o_orderstatus") == "F", "Finalizado"),
            ((c("o_orderstatus") == "P") & (c("l_linestatus") == "F"), "Enviada"),
            (c("o_orderstatus") == "P", "Recebimento Confirmado"),
        ),
    )
    open_ = status.isin("Rejeitado", *settings.pending)
    rows = rows.withColumn("qtd_env", first_match(c("l_quantity"), (open_, 0.0), (c("l_linenumber") == 7, c("l_quantity") + 2.0), (c("l_linenumber") == 6, F.floor(c("l_quantity") * 0.8).cast("double"))))
    received = first_match(sent, (~status.isin(*settings.finished), 0.0), (c("l_partkey") % 11 == 0, 0.0), (c("one_more"), sent + 1.0))
    rows = rows.select(
        "l_partkey", "s_nationkey", c("o_orderdate").alias("data_solic"), c("l_quantity").alias("qtd_solic"), "qtd_env", received.alias("qtd_rec"), "status",
        (c("o_orderpriority") == "1-URGENT").alias("pedido_extra"),
    )
    rows = rows.join(table(spark, folder, "part").select("p_partkey", "p_brand"), c("l_partkey") == c("p_partkey"))
    rows = rows.join(table(spark, folder, "nation").select("n_nationkey", "n_name"), c("s_nationkey") == c("n_nationkey"))
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int") % 3
    return rows.select(
        c("n_name").alias("unidade"), "data_solic", c("p_brand").alias("produto"),
        F.when(brand == 0, "CATEGORIA_A").when(brand == 1, "CATEGORIA_B").otherwise("CATEGORIA_C").alias("categoria"),
        "qtd_solic", "qtd_env", "qtd_rec", "status", "pedido_extra", month(c("data_solic")).alias("mes"),
    )
