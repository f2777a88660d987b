"""Layer 5: reliability gate, features of a pair's history, baseline forecast and its interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ForecastSettings, Settings
from ..functions.numbers import first_match, or_zero
from ..functions.text import next_month

KEY = ["unidade", "produto"]
REGIMES = ("X_regular", "Y_moderado", "Z_erratico", "baixa_rotatividade")


def gate(months: int, settings: ForecastSettings = ForecastSettings()) -> str:
    """How far a history of so many months can be trusted."""
    return "insuficiente" if months < settings.preliminary else "preliminar" if months < settings.operational else "operacional"


def gate_table(history: DataFrame, settings: ForecastSettings = ForecastSettings()) -> DataFrame:
    """One row: the number of months and what the gate says."""
    t = F.col("n_meses")
    out = history.agg(F.countDistinct("mes").alias("n_meses"))
    return out.withColumn("confiabilidade", first_match("operacional", (t < settings.preliminary, "insuficiente"), (t < settings.operational, "preliminar")))


def with_next_month(history: DataFrame) -> DataFrame:
    """History and, for each pair, a row of the month after the last one of all; is_future marks it."""
    last = history.agg(next_month(F.max("mes")).alias("mes"))
    future = history.select(*KEY, "categoria").distinct().crossJoin(F.broadcast(last))  # one row
    return history.withColumn("is_future", F.lit(False)).unionByName(future.withColumn("is_future", F.lit(True)), allowMissingColumns=True)


def temporal(history: DataFrame, settings: ForecastSettings = ForecastSettings()) -> DataFrame:
    """Adds lags with their availability, mean and deviation of the months before, and the ordinal. Positions count, not gaps."""
    by = Window.partitionBy(*KEY).orderBy("mes", "categoria")
    before = by.rowsBetween(-settings.window, -1)
    lag = lambda i: F.lag("consumo_total", i).over(by)
    lags = {f"lag_{i}": or_zero(lag(i)) for i in range(1, settings.lags + 1)}
    there = {f"lag_{i}_disp": lag(i).isNotNull().cast("int") for i in range(1, settings.lags + 1)}
    rolling = {"media_3m": or_zero(F.avg("consumo_total").over(before)), "std_3m": or_zero(F.stddev_pop("consumo_total").over(before))}
    return history.withColumns(lags | there | rolling | {"trend_idx": F.row_number().over(by) - 1, "mes_num": F.month(F.to_date("mes", "yyyy-MM"))})


def with_regimes(rows: DataFrame, metrics: DataFrame) -> DataFrame:
    """Adds class, mean and variation of the pair's metrics, and an indicator for each class."""
    known = metrics.select(*KEY, "classe_xyz", F.col("consumo_medio_mensal").alias("consumo_medio_hist"), F.col("cv").alias("cv_hist"))
    out = rows.join(known, KEY, "left")
    flags = {f"regime_{r}": F.coalesce((F.col("classe_xyz") == r).cast("int"), F.lit(0)) for r in REGIMES}
    return out.withColumns({"cv_hist": or_zero(F.col("cv_hist")), "consumo_medio_hist": or_zero(F.col("consumo_medio_hist"))} | flags)


def one_hot(rows: DataFrame, column: str, prefix: str, values: list) -> DataFrame:
    """An indicator column for each of the given values."""
    return rows.withColumns({f"{prefix}_{v}": (F.col(column) == v).cast("int") for v in values})


def feature_columns(columns: list[str]) -> list[str]:
    """Without keys, targets and the availability of lags."""
    other = {*KEY, "categoria", "mes", "classe_xyz", "consumo_total", "consumo_reg", "consumo_extra", "demanda_total", "is_future"}
    return [c for c in columns if c not in other and not c.endswith("_disp")]


def baseline(weights: tuple[float, ...] = Settings().weights, short_history: str = "zero") -> Column:
    """The weighted lags, the newest with the last weight. A missing lag counts as 0, or with 'mean' the weights of
    the lags that are there are scaled to one."""
    terms = [float(w) * F.col(f"lag_{len(weights) - k}") for k, w in enumerate(weights)]
    total = sum(terms[1:], terms[0])
    if short_history == "mean":
        there = [float(w) * F.col(f"lag_{len(weights) - k}_disp") for k, w in enumerate(weights)]
        share = sum(there[1:], there[0])
        total = F.when(share > 0, total / share).otherwise(0.0)
    return F.greatest(total, F.lit(0.0))


def forecast(rows: DataFrame, settings: ForecastSettings = ForecastSettings()) -> DataFrame:
    """The next month of each pair: baseline forecast and the interval from the pooled residuals of its history.

    Resampled residuals tend to their own distribution: its percentiles are added and cut at 0.
    """
    made = rows.withColumn("previsao", baseline())
    low, high = settings.percentiles
    residual = F.col("consumo_total") - F.col("previsao")
    bounds = made.where(~F.col("is_future")).agg(F.percentile(residual, F.array(F.lit(low), F.lit(high))).alias("p"))
    out = made.where("is_future").crossJoin(F.broadcast(bounds))  # one row
    edge = lambda k: F.greatest(F.col("previsao") + F.col("p")[k], F.lit(0.0))
    return out.select(*KEY, "categoria", F.col("mes").alias("mes_previsao"), "previsao", edge(0).alias("intervalo_inferior_90"), edge(1).alias("intervalo_superior_90"))
