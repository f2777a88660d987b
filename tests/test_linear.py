"""Ridge regression of all folds in one pass, and of many units, against one fit after the other in numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotalab.config import ForecastSettings, Settings
from quotalab.operators import features as X
from quotalab.plans import forecast, linear
from quotalab.plans.models import ordered_folds

HISTORY = "unidade string, produto string, categoria string, mes string, consumo_total double, consumo_reg double, consumo_extra double, demanda_total double"


def history_of(spark, units=6, products=4, months=22, seed=1, gaps=0.2):
    r = random.Random(seed)
    names = [f"{2020 + k // 12}-{k % 12 + 1:02d}" for k in range(months)]
    rows = []
    for u in range(units):
        for p in range(products):
            base, first = r.uniform(0.2, 30), r.choice([0, 0, 5, months - 2])
            for k, mes in enumerate(names[first:]):
                if r.random() > gaps:
                    v = max(0.0, 1.0 * round(base + r.gauss(0, base / 2) + 3 * u + k * 0.1))
                    rows.append((f"u{u}", f"p{p}", f"c{p % 2}", mes, v, v, 0.0, v))
    rows.append(("only", "p0", "c0", names[min(8, months - 1)], 3.0, 3.0, 0.0, 3.0))
    past = spark.createDataFrame(rows, HISTORY).repartition(5)
    metrics = past.groupBy("unidade", "produto").agg(F.avg("consumo_total").alias("consumo_medio_mensal"), (F.stddev_pop("consumo_total") / F.avg("consumo_total")).alias("cv"))
    return past, metrics.withColumn("classe_xyz", F.when(F.col("cv") < 0.3, "X_regular").when(F.col("cv") < 0.7, "Y_moderado").otherwise("Z_erratico"))


def dense_ridge(x, y, alphas):
    """(alpha, mean, spread, intercept, coefficients) of one training table, its rows in the order of pairs."""
    mean, spread = x.mean(0), x.std(0)
    spread = np.where(spread > 1e-9, spread, 1)
    z = (x - mean) / spread

    def fit(k, alpha):
        own, target = z[k], y[k]
        beta = np.linalg.solve((own - own.mean(0)).T @ (own - own.mean(0)) + alpha * np.eye(z.shape[1]), (own - own.mean(0)).T @ (target - target.mean()))
        return target.mean() - own.mean(0) @ beta, beta

    def r2(k, b0, beta):
        spread_y = ((y[k] - y[k].mean()) ** 2).sum()
        error = ((y[k] - b0 - z[k] @ beta) ** 2).sum()
        return 1 - error / spread_y if spread_y > 0 else float(error == 0)

    folds = ordered_folds(len(y))
    scores = [np.mean([r2(slice(a, b), *fit(slice(0, a), alpha)) for a, b in folds]) for alpha in alphas] if folds else [0]
    alpha = alphas[int(np.argmax(scores))]
    return alpha, mean, spread, *fit(slice(0, len(y)), alpha)


def plain_backtest(given, as_of, settings):
    rows = sorted((r.asDict() for r in given.rows.collect()), key=lambda r: (r["unidade"], r["produto"], r["t"]))
    units = sorted({r["unidade"] for r in rows})
    out = {}
    for fold in range(settings.least_training, len(given.months)):
        used = [k for k, n in enumerate([*given.dense, *linear.METRIC]) if X.gate(fold, settings) == "operacional" or not (n.startswith("mes_") and n != "mes_num")]

        def metric(r, fold=fold):
            if not as_of:
                return r["m"]
            v = np.array([o["y"] for o in rows if (o["unidade"], o["produto"]) == (r["unidade"], r["produto"]) and o["t"] < fold])
            cv = v.std() / v.mean() if v.mean() > 0 else 0.0
            low = 0 < v.mean() < 1
            other = v.mean() > 0 and not low
            return [v.mean(), cv, other and cv < 0.3, other and 0.3 <= cv < 0.7, other and cv >= 0.7, low]

        row = lambda r: np.array([*np.array([*r["x"], *map(float, metric(r))])[used], *(float(r["unidade"] == u) for u in units)])  # noqa: E731, B023
        train = [r for r in rows if r["t"] < fold]
        alpha, mean, spread, b0, beta = dense_ridge(np.array([row(r) for r in train]), np.array([r["y"] for r in train]), settings.alphas)
        for r in rows:
            if r["t"] == fold and r["trend_idx"] >= 1:
                out[fold, r["unidade"], r["produto"]] = (alpha, max(0.0, b0 + ((row(r) - mean) / spread) @ beta))
    return out


@pytest.mark.parametrize("as_of", [None, Settings()])
def test_backtest_equals_one_fit_for_each_fold(spark, as_of):
    settings = ForecastSettings()
    past, metrics = history_of(spark)
    want = plain_backtest(linear.design(past, metrics, settings), as_of, settings)
    got = {(r["fold"], r["unidade"], r["produto"]): (r["alpha"], r["predicted"]) for r in linear.walk_forward_ridge(past, metrics, settings, as_of).collect()}
    assert got.keys() == want.keys() and len({f for f, *_ in got}) == 19 and len({a for a, _ in want.values()}) > 1
    for k, (alpha, value) in want.items():
        assert got[k][0] == alpha and abs(got[k][1] - value) < 1e-5 * max(1, value), (k, got[k], value)


def test_backtest_of_short_and_empty_histories(spark):
    past, metrics = history_of(spark, months=3)
    assert linear.walk_forward_ridge(past, metrics).count() == 0
    past, metrics = history_of(spark, units=1, products=1, months=5, gaps=0)
    rows = linear.walk_forward_ridge(past, metrics).collect()
    assert {r["fold"] for r in rows} <= {3, 4} and all(np.isfinite(r["predicted"]) for r in rows)


def test_next_month_equals_the_model_with_a_column_for_each_unit(spark):
    past, metrics = history_of(spark, seed=4)
    months = past.select("mes").distinct().count()
    rows, made = forecast.predicted_with("ridge", past, metrics, months)
    want = {(r["unidade"], r["produto"]): r["previsao"] for r in made.where("is_future").collect()}
    _, future = linear.next_month_ridge(past, metrics)
    got = {(r["unidade"], r["produto"]): r["previsao"] for r in future.collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert abs(got[k] - v) < 1e-5 * max(1, v), (k, got[k], v)


def test_ten_thousand_units(spark):
    n = 10_000
    ids = spark.range(n * 4)
    past = ids.select(
        F.format_string("u%05d", F.col("id") % n).alias("unidade"), F.lit("p").alias("produto"), F.lit("c").alias("categoria"), F.format_string("2020-%02d", (F.col("id") / n).cast("int") + 1).alias("mes"),
        (F.pmod(F.xxhash64("id"), F.lit(9)) + F.col("id") % 7).cast("double").alias("consumo_total"),
    ).withColumns({c: F.col("consumo_total") for c in ("consumo_reg", "consumo_extra", "demanda_total")})
    metrics = past.groupBy("unidade", "produto").agg(F.avg("consumo_total").alias("consumo_medio_mensal"), F.lit(0.1).alias("cv"), F.lit("X_regular").alias("classe_xyz"))
    rows = linear.walk_forward_ridge(past, metrics)
    assert rows.count() == n and rows.where("predicted is null or isnan(predicted)").count() == 0


def test_metrics_as_of_use_earlier_months_alone(spark):
    past, _ = history_of(spark, units=3, products=2, months=9)
    rows = [r.asDict() for r in past.collect()]
    months = sorted({r["mes"] for r in rows})
    got = {(r["unidade"], r["produto"], r["mes"]): r for r in linear.metrics_as_of(past).collect()}
    n = 0
    for u, p in {(r["unidade"], r["produto"]) for r in rows}:
        for mes in months:
            v = np.array([r["consumo_total"] for r in rows if (r["unidade"], r["produto"]) == (u, p) and r["mes"] < mes])
            if len(v):
                row, n = got[u, p, mes], n + 1
                assert row["n_meses"] == len(v) and np.isclose(row["consumo_medio_hist"], v.mean()) and np.isclose(row["cv_hist"], v.std() / v.mean() if v.mean() else 0.0)
    assert n == len(got)
