"""Layer 6: history upsert, walk-forward backtest, model registry rules, drift, and the closed loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ForecastSettings, Settings
from ..functions.numbers import first_match
from .dominance import COMPARED, POLICIES, costs_of, dominated, expected
from .features import KEY, baseline, temporal

HISTORY = ["unidade", "produto", "categoria", "mes", "consumo_total", "consumo_reg", "consumo_extra", "demanda_total"]


def upserted(old: DataFrame, new: DataFrame, key: tuple[str, ...] = ("unidade", "produto", "mes"), order: str | None = None) -> DataFrame:
    """Both tables with one row for each key: the new table's, if it has one.

    Of a table's own repeats the last by the column order stays (it is dropped), or the largest where none is given.
    """
    rows = old.withColumn("src", F.lit(0)).unionByName(new.withColumn("src", F.lit(1)), allowMissingColumns=True)
    others = [c for c in rows.columns if c not in (*key, "src", order)]
    if order:
        best = rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct("src", order, *others)).alias("r"))
        return best.select(*key, *(F.col(f"r.{c}").alias(c) for c in others)).select(*[c for c in rows.columns if c not in ("src", order)])
    best = rows.groupBy(*key).agg(F.max(F.struct("src", *others)).alias("r"))
    return best.select(*key, *(F.col(f"r.{c}").alias(c) for c in others)).select(*[c for c in rows.columns if c != "src"])


def walk_forward(history: DataFrame, settings: ForecastSettings = ForecastSettings(), short_history: str = "zero") -> DataFrame:
    """The baseline's errors in every month after the first least_training ones, from the months before: one window.

    A pair's first row has no months before it and gives no error.
    """
    months = history.select("mes").distinct().withColumn("fold", F.dense_rank().over(Window.orderBy("mes")) - 1)  # as many rows as months
    rows = temporal(history, settings).withColumn("predicted", baseline(short_history=short_history)).join(F.broadcast(months), "mes")
    rows = rows.where((F.col("fold") >= settings.least_training) & (F.col("trend_idx") >= 1))
    off = F.abs(F.col("consumo_total") - F.col("predicted"))
    return rows.select(
        "fold", F.col("mes").alias("mes_test"), *KEY, F.col("consumo_total").alias("actual"), "predicted", off.alias("abs_error"), (off * off).alias("sq_error"),
        F.when(F.col("consumo_total") > 0, off / F.col("consumo_total")).alias("pct_error"),
    )


def newest_fold(backtest: DataFrame) -> DataFrame:
    """The errors of the last month that was tested."""
    last = backtest.agg(F.max("fold").alias("last"))  # one row
    return backtest.join(F.broadcast(last), F.col("fold") == F.col("last"), "left_semi")


def error_metrics(backtest: DataFrame, *by: str) -> DataFrame:
    """mae, rmse, mape (of the errors that have a share) and how many."""
    return backtest.groupBy(*by).agg(F.avg("abs_error").alias("mae"), F.sqrt(F.avg("sq_error")).alias("rmse"), F.avg("pct_error").alias("mape"), F.count("*").alias("n_obs"))


def drift(errors: DataFrame, order: list[str], settings: ForecastSettings = ForecastSettings(), value: str = "abs_error") -> DataFrame:
    """One row: mean of the last errors against mean and deviation of those before, z, and whether to recalibrate.

    Fewer than two errors before the last ones: not assessed, z is null.
    """
    # only the newest few rows are ranked; all others are aggregated where they are
    last = errors.orderBy(*(F.desc(c) for c in order)).limit(settings.drift_window)
    recent = last.agg(F.avg(value).alias("media_recente"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"), F.count("*").alias("k"))
    whole = errors.agg(F.sum(value).alias("ws"), F.sum(F.col(value) * F.col(value)).alias("wq"), F.count("*").alias("n_erros"))
    n = F.col("n_erros") - F.col("k")
    rows = recent.crossJoin(whole)  # one row each
    enough = F.col("n_erros") >= settings.drift_window + 2
    mean = F.when(n > 0, (F.col("ws") - F.col("s")) / n)
    rows = rows.withColumn("media_anterior", mean)
    spread = F.sqrt(F.greatest((F.col("wq") - F.col("q")) / n - F.col("media_anterior") * F.col("media_anterior"), F.lit(0.0)))
    z = F.when(enough, (F.col("media_recente") - F.col("media_anterior")) / (F.when(n > 1, spread).otherwise(1.0) + 1e-9))
    rows = rows.withColumn("z", z)
    return rows.select("n_erros", "media_recente", "media_anterior", "z", F.coalesce(F.abs("z") > settings.drift_z, F.lit(False)).alias("recalibrar"))


def promotes(challenger: Column, base: Column, champion: Column) -> Column:
    """Whether a challenger's error beats the baseline's and, where there is one, the champion's."""
    bad = lambda x: x.isNull() | F.isnan(x)
    return first_match(True, (bad(challenger) | bad(base), False), (challenger >= base, False), (~bad(champion) & (challenger >= champion), False))


def version(ordinal: Column) -> Column:
    return F.format_string("v%04d", ordinal)


def closed_loop(dominance: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Dominance rows with the forecast that replaces the empirical demand, where one is active."""
    active = forecasts.where("previsao_substitui_c4").select(*KEY, F.col("previsao").alias("demanda_prevista"), F.col("confiabilidade").alias("confiabilidade_ml"), F.col("modelo_usado").alias("modelo_ml"))
    out = dominance.join(active, KEY, "left")
    source = F.when(F.col("demanda_prevista").isNotNull(), "ml_prevista").otherwise("empirica")
    return out.withColumns({"fonte_demanda": source, "confiabilidade_ml": F.coalesce("confiabilidade_ml", F.lit("insuficiente"))})


def predicted_demand(forecasts: DataFrame, residuals: DataFrame, levels: int = 40) -> DataFrame:
    """(unidade, produto, s): of each active forecast the equally likely demands that its residuals leave.

    The levels are the middles of equal parts of the distribution of residuals(residuo), added to the forecast and cut at
    0; without residuals the forecast itself.
    """
    at = F.array(*(F.lit((k + 0.5) / levels) for k in range(levels)))
    steps = residuals.agg(F.coalesce(F.percentile("residuo", at), F.array(F.lit(0.0))).alias("steps"))  # one row
    rows = forecasts.where("previsao_substitui_c4").crossJoin(F.broadcast(steps))
    return rows.select(*KEY, F.transform("steps", lambda r: F.greatest(F.col("previsao") + r, F.lit(0.0))).alias("s"))


def decided_again(dominance: DataFrame, forecasts: DataFrame, residuals: DataFrame, policies: DataFrame, settings: Settings = Settings(), mode: str = "reference", levels: int = 40) -> DataFrame:
    """Dominance rows whose costs, preferred policy and comparisons come from the predicted demand where one is active.

    fonte_demanda says which demand decides; politica_empirica keeps what the observed months prefer, and politica_mudou
    whether the forecast changes it. Pairs without an active forecast, or whose predicted demand is all 0, keep their row.
    """
    names = [*(f"custo_esp_{p}" for p in POLICIES), "politica_preferida", *(n for n, _, _ in COMPARED)]
    made = dominated(expected(costs_of(predicted_demand(forecasts, residuals, levels).where(F.exists("s", lambda d: d > 0)), policies, settings)), settings, mode)
    made = made.select(*KEY, F.struct(*names).alias("novo"))
    out = dominance.withColumn("politica_empirica", F.col("politica_preferida")).join(made, KEY, "left")
    there = F.col("novo").isNotNull()
    out = out.withColumns({n: F.when(there, F.col(f"novo.{n}")).otherwise(F.col(n)) for n in names})
    changed = F.col("politica_preferida") != F.col("politica_empirica")
    return out.withColumns({"fonte_demanda": F.when(there, "ml_prevista").otherwise("empirica"), "politica_mudou": changed}).drop("novo")
