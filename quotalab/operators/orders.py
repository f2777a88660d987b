"""Layer 1: normalised orders, quality flags, consolidated consumption, anonymous units."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import numbers, text


def normalised(raw: DataFrame) -> DataFrame:
    """Ten string columns as typed orders. A malformed date raises; a bad quantity is 0."""
    c = F.col
    return raw.select(
        "unidade", F.to_timestamp("data_solic").alias("data_solic"), "produto", text.category(c("categoria")).alias("categoria"),
        *(numbers.number(c(q)).alias(q) for q in ("qtd_solic", "qtd_env", "qtd_rec")), "status",
        text.yes_no(c("pedido_extra")).alias("pedido_extra"), text.month(F.to_timestamp("data_solic")).alias("mes"),
    )


def flagged(orders: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds the three quality flags and whether any holds."""
    sent, received = F.col("qtd_env"), F.col("qtd_rec")
    flags = {
        "flag_env_maior_solic": sent > F.col("qtd_solic"),
        "flag_rec_maior_env": received > sent,
        "flag_fin_sem_rec": F.col("status").isin(*settings.finished) & (received == 0),
    }
    any_ = flags["flag_env_maior_solic"] | flags["flag_rec_maior_env"] | flags["flag_fin_sem_rec"]
    return orders.withColumns(flags | {"flag_qualquer_erro": any_})


def consolidated(orders: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds qtd_consumo, the best evidence of what was used, and qtd_demanda, what was asked for unless rejected."""
    asked, sent, received, status = (F.col(x) for x in ("qtd_solic", "qtd_env", "qtd_rec", "status"))
    used = numbers.first_match(
        0.0,
        (status == settings.rejected, 0.0),
        (received > 0, F.when(sent > 0, F.least(received, sent)).otherwise(received)),
        (sent > 0, F.when(asked > 0, F.least(sent, asked)).otherwise(sent)),
        (status.isin(*settings.pending), asked),
    )
    return orders.withColumns({"qtd_consumo": used, "qtd_demanda": F.when(status == settings.rejected, 0.0).otherwise(asked)})


def unit_aliases(orders: DataFrame) -> DataFrame:
    """(unidade, n_pedidos, alias): units by orders, most first, names breaking ties. As many rows as units."""
    counts = orders.groupBy("unidade").agg(F.count("*").alias("n_pedidos"))
    rank = F.row_number().over(Window.orderBy(F.desc("n_pedidos"), "unidade"))
    return counts.withColumn("alias", F.format_string("Unidade_%02d", rank))


def anonymised(orders: DataFrame) -> DataFrame:
    """Orders with the units' aliases for their names."""
    aliases = unit_aliases(orders).select("unidade", "alias")
    return orders.join(aliases, "unidade", "left").withColumn("unidade", F.col("alias")).drop("alias").select(*orders.columns)


def error_rates(orders: DataFrame) -> DataFrame:
    """One row: orders, how many have each flag, and the share with any."""
    flags = ["flag_env_maior_solic", "flag_rec_maior_env", "flag_fin_sem_rec", "flag_qualquer_erro"]
    out = orders.agg(F.count("*").alias("n_pedidos"), *(F.count_if(f).alias(f"n_{f[5:]}") for f in flags))
    return out.withColumn("taxa_erro", numbers.round_even(numbers.ratio(F.col("n_qualquer_erro"), F.col("n_pedidos")), 6))
