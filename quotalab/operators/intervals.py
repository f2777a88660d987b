"""Seeded prediction intervals: residuals are drawn again and again from the pool of all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ForecastSettings
from ..functions.ranks import drawn_place, ranked
from .features import KEY


def seeded_interval(forecasts: DataFrame, residuals: DataFrame, settings: ForecastSettings = ForecastSettings()) -> DataFrame:
    """forecasts(unidade, produto, previsao, ...) with intervalo_inferior_90 and intervalo_superior_90.

    Each forecast adds settings.draws residuals to itself, drawn with replacement from residuals(residuo), cuts them at 0
    and takes the percentiles in between which nine tenths lie, by linear interpolation. A draw is a rank from the digest
    of pair, replica and seed: the residuals are put in order without a global sort in one task, and draws find theirs by
    a join on the rank. Null residuals are ignored; without residuals the interval is the forecast itself.
    """
    pool = ranked(residuals.select("residuo").where("residuo is not null"), "residuo")
    size = pool.agg(F.max("n").alias("n"))  # one row
    keys = forecasts.select(*KEY, "previsao").crossJoin(F.broadcast(size)).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(settings.draws - 1))))
    draws = keys.withColumn("rank", drawn_place(F.col("n"), settings.seed, F.col("unidade"), F.col("produto"), F.col("r")))
    made = draws.join(pool.select("rank", "residuo"), "rank", "left").withColumn("v", F.greatest(F.col("previsao") + F.coalesce("residuo", F.lit(0.0)), F.lit(0.0)))
    low, high = settings.percentiles
    bounds = made.groupBy(*KEY).agg(F.percentile("v", F.array(F.lit(low), F.lit(high))).alias("p"))
    out = forecasts.join(bounds, KEY)
    return out.withColumns({"intervalo_inferior_90": F.col("p")[0], "intervalo_superior_90": F.col("p")[1]}).drop("p")
