"""Layer 2: monthly pivot, balanced panel, metrics of each pair, demand classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.numbers import first_match, or_zero, ratio

PAIR = ["unidade", "produto", "categoria"]
MEASURES = {"solic": "qtd_solic", "env": "qtd_env", "rec": "qtd_rec", "consumo": "qtd_consumo", "demanda": "qtd_demanda"}
SPLITS = [f"{m}_{side}" for m in (*MEASURES, "n_pedidos") for side in ("reg", "extra")]


def monthly(orders: DataFrame) -> DataFrame:
    """Sums and counts by pair and month, regular and extra orders apart. Orders of neither kind add nothing."""
    sides = {"reg": ~F.col("pedido_extra"), "extra": F.col("pedido_extra")}
    sums = [or_zero(F.sum(F.when(test, F.col(q)))).alias(f"{m}_{side}") for m, q in MEASURES.items() for side, test in sides.items()]
    counts = [F.count_if(test).cast("double").alias(f"n_pedidos_{side}") for side, test in sides.items()]
    return orders.groupBy(*PAIR, "mes").agg(*sums, *counts)


def balanced(months: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """Every pair with every wanted month, zeros where it has no orders, and the totals of both kinds."""
    spark = months.sparkSession
    months = months.where(F.col("mes").isin(*wanted))
    frame = months.select(*PAIR).distinct().crossJoin(F.broadcast(spark.createDataFrame([(m,) for m in wanted], "mes string")))
    out = frame.join(months, [*PAIR, "mes"], "left").select(*PAIR, "mes", *(or_zero(F.col(x)).alias(x) for x in SPLITS))
    totals = {f"{m}_total": F.col(f"{m}_reg") + F.col(f"{m}_extra") for m in ("solic", "consumo", "demanda")}
    return out.withColumns(totals).withColumn("gap_atendimento", F.col("demanda_total") - F.col("consumo_total"))


def weighted(wanted: tuple[str, ...], weights: tuple[float, ...]) -> Column:
    """The aggregate of consumption by month weights, oldest first; the mean if there are not as many months as weights."""
    if len(wanted) != len(weights):
        return F.avg("consumo_total")
    weight = first_match(0.0, *((F.col("mes") == m, float(w)) for m, w in zip(sorted(wanted), weights, strict=True)))
    return F.sum(F.col("consumo_total") * weight)


def metrics(panel: DataFrame, wanted: tuple[str, ...], settings: Settings = Settings()) -> DataFrame:
    """Sixteen measures of each pair and its class, with the weighted projection, in one aggregation."""
    mean = {
        "consumo_medio_mensal": "consumo_total", "demanda_media_mensal": "demanda_total", "consumo_reg_medio": "consumo_reg",
        "consumo_extra_medio": "consumo_extra", "demanda_reg_media": "demanda_reg", "demanda_extra_media": "demanda_extra", "gap_medio_mensal": "gap_atendimento",
    }
    total = lambda x: F.sum(x)
    out = panel.groupBy(*PAIR).agg(
        *(F.avg(x).alias(name) for name, x in mean.items()),
        F.avg(F.col("env_reg") + F.col("env_extra")).alias("env_medio_mensal"),
        F.avg(F.col("rec_reg") + F.col("rec_extra")).alias("rec_medio_mensal"),
        F.stddev_pop("consumo_total").alias("desvio_padrao"),
        F.count_if(F.col("consumo_total") > 0).alias("meses_com_pedido"),
        F.count_if(F.col("consumo_extra") > 0).alias("meses_com_extra"),
        ratio(total("consumo_total"), total("demanda_total")).alias("taxa_atendimento"),
        ratio(total("consumo_extra"), total("consumo_reg")).alias("razao_extra_regular"),
        ratio(total("consumo_extra"), total("consumo_total")).alias("pct_extra_no_consumo"),
        weighted(wanted, settings.weights).alias("proj_ponderada"),
    )
    out = out.withColumn("cv", ratio(F.col("desvio_padrao"), F.col("consumo_medio_mensal")))
    return out.withColumn("classe_xyz", demand_class(F.col("cv"), F.col("consumo_medio_mensal"), settings))


def demand_class(cv: Column, mean: Column, settings: Settings = Settings()) -> Column:
    return first_match(
        "Z_erratico",
        (cv.isNull(), "sem_consumo"),
        (mean < settings.low_rotation_mean, "baixa_rotatividade"),
        (cv < settings.cv_regular, "X_regular"),
        (cv < settings.cv_moderate, "Y_moderado"),
    )


def counts_by(rows: DataFrame, column: str) -> DataFrame:
    """Rows by value, most first."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
