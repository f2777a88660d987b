"""Layer 3: buffer factor, quotas, marginal need and suggested action of each pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.numbers import first_match, round_even


def buffer_factor(cv: Column, mean: Column, settings: Settings = Settings()) -> Column:
    low, mid, high, top = settings.k_steps
    return first_match(
        top,
        (cv.isNull() | (mean < settings.low_rotation_mean), low),
        (cv < settings.cv_regular, low),
        (cv < settings.cv_moderate, mid),
        (cv < settings.cv_upper, high),
    )


def action(mean: Column, quota: Column, regular: Column, extra_share: Column, settings: Settings = Settings()) -> Column:
    """The suggestion from the quota, rounded up, against today's regular consumption, rounded."""
    new, now = F.ceil(quota), F.rint(regular)
    return first_match(
        "manter",
        (mean < settings.least_mean, "baixa_materialidade"),
        ((extra_share >= settings.extra_share) & (new > now), "reforcar"),
        (new > now + 1, "aumentar"),
        (new < now - 1, "reduzir"),
    )


def policies(metrics: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds k, both quotas, what each needs beyond regular consumption, and the action."""
    c = F.col
    out = metrics.withColumn("k", buffer_factor(c("cv"), c("consumo_medio_mensal"), settings))
    out = out.withColumns(
        {"cota_conservadora": round_even(c("proj_ponderada"), 2), "cota_buffer": round_even(c("proj_ponderada") + c("k") * c("desvio_padrao"), 2)}
    )
    return out.withColumns(
        {
            "necessidade_marginal_conserv": round_even(c("cota_conservadora") - c("consumo_reg_medio"), 2),
            "necessidade_marginal_buffer": round_even(c("cota_buffer") - c("consumo_reg_medio"), 2),
            "acao_sugerida": action(c("consumo_medio_mensal"), c("cota_conservadora"), c("consumo_reg_medio"), c("pct_extra_no_consumo"), settings),
        }
    )
