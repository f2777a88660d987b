"""The generator, the learnt models, the whole run and the streams."""

import csv
import json
import random
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotalab import cli
from quotalab.config import ForecastSettings, Settings
from quotalab.operators import history, orders
from quotalab.plans import forecast, models
from quotalab.sources import synthetic
from quotalab.sources.ledger import COLUMNS
from quotalab.streaming.history import follow, followed, monthly_totals, windowed_demand


@pytest.fixture(scope="module")
def ledger_csv(spark, tmp_path_factory):
    """The synthetic ledger as a CSV file."""
    folder = tmp_path_factory.mktemp("synthetic")
    synthetic.write_synthetic(spark, str(folder / "out"))
    (part,) = (folder / "out").glob("part-*.csv")
    return part


def test_generator_is_on_target(spark, ledger_csv):
    rows = list(csv.DictReader(ledger_csv.open(encoding="utf-8")))
    keys = [(r["data_solic"], r["unidade"], r["produto"]) for r in rows]
    assert list(rows[0]) == COLUMNS and keys == sorted(keys)
    assert min(k[0] for k in keys if k[0] >= "2026-05") >= "2026-05-02" and {r["mes_ref"] for r in rows} == {m[-1] for m in synthetic.MONTHS}
    factors = [r["fator"] for r in synthetic.units(spark).orderBy("unidade").collect()]
    assert factors == sorted(factors, reverse=True) and len(factors) == 15
    row = synthetic.calibration(orders.normalised(synthetic.synthetic_ledger(spark))).first()
    assert row["no_alvo"] and abs(row["pct_extra"] - 0.21) < 0.03 and row["pares_materiais"] == 600
    assert abs(row["pct_x"] - 0.40) < 0.05 and abs(row["pct_y"] - 0.30) < 0.05 and abs(row["pct_z"] - 0.30) < 0.05


def numbers_table(spark, n, seed=0):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        a, b = r.gauss(3, 2), r.choice([0.0, 1.0])
        rows.append((f"u{k % 7}", f"p{k // 7 % 5}", f"20{10 + k // 35:02d}-01", max(0.0, 2 * a - b + r.gauss(0, 1)), a, b, None if k % 11 == 0 else r.random() * 1000, 5.0))
    return spark.createDataFrame(rows, "unidade string, produto string, mes string, consumo_total double, a double, b double, c double, fixed double").repartition(5)


@pytest.mark.parametrize("n", [200, 23, 9, 2])
def test_ridge_equals_numpy(spark, n):
    names = ["a", "b", "c", "fixed"]
    rows = numbers_table(spark, n)
    model = models.Ridge().fit(rows, names)
    table = rows.orderBy("unidade", "produto", "mes").toPandas().fillna(0)
    x, y = table[names].to_numpy(), table.consumo_total.to_numpy()
    spread = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(spread > 0, spread, 1)

    def plain(z, y, alpha):
        m = z.mean(axis=0)
        beta = np.linalg.solve((z - m).T @ (z - m) + alpha * np.eye(z.shape[1]), (z - m).T @ (y - y.mean()))
        return y.mean() - m @ beta, beta

    folds = min(3, max(2, n // 10))
    size = n // (folds + 1)
    scores = []
    for alpha in ForecastSettings().alphas if size else []:
        own = []
        for k in range(folds, 0, -1):
            a, b = n - k * size, n - (k - 1) * size
            start, beta = plain(z[:a], y[:a], alpha)
            spread_y = ((y[a:b] - y[a:b].mean()) ** 2).sum()
            own.append(1 - ((y[a:b] - start - z[a:b] @ beta) ** 2).sum() / spread_y if spread_y > 0 else 0.0)
        scores.append(np.mean(own))
    best = ForecastSettings().alphas[int(np.argmax(scores))] if scores else ForecastSettings().alphas[0]
    assert model.alpha == best
    start, beta = plain(z, y, best)
    got = model.predict(rows).orderBy("unidade", "produto", "mes").toPandas().previsao.to_numpy()
    assert np.allclose(got, np.maximum(start + z @ beta, 0), atol=1e-8)
    assert models.ordered_folds(42) == [(12, 22), (22, 32), (32, 42)] and models.ordered_folds(2) == []


def test_ridge_without_rows_and_columns_that_are_missing(spark):
    rows = numbers_table(spark, 40)
    assert {r[0] for r in models.Ridge().fit(rows.limit(0), ["a"]).predict(rows).select("previsao").distinct().collect()} == {0.0}
    made = models.Ridge().fit(rows, ["a", "b"])
    one, other = (made.predict(x).orderBy("unidade", "produto", "mes").toPandas().previsao for x in (rows.withColumn("b", F.lit(0.0)), rows.drop("b")))
    assert np.allclose(one, other)


def test_poisson_and_boosted(spark):
    past = spark.createDataFrame([("u", "p", f"m{k}", float(k % 2), float(k % 2), float(k)) for k in range(30)], "unidade string, produto string, mes string, consumo_total double, lag_1 double, z double")
    model = models.Poisson().fit(past, ["lag_1", "z"])
    made = {r["lag_1"]: r["previsao"] for r in model.predict(past).collect()}  # few rows: lags alone
    assert made[1.0] == pytest.approx(1.0, abs=0.05) and made[0.0] < 0.05
    none = models.Poisson().fit(past.withColumn("consumo_total", F.lit(0.0)), ["lag_1"])
    assert all(r["previsao"] == pytest.approx(0.0, abs=1e-3) for r in none.predict(past).collect())
    boosted = models.Boosted(trees=5).fit(past, ["lag_1", "z"]).predict(past)
    assert {c for c in boosted.columns} == {*past.columns, "y", "previsao"} - {"y"} and boosted.agg(F.min("previsao")).first()[0] >= 0
    assert models.available(7) == ["baseline_mmp"] and models.available(8) == list(models.MODELS)


def test_verdicts_and_drift_status(spark):
    base = {"mae": 1.2}
    assert forecast.verdict(spark, {"mae": 1.0}, base, None) == (True, "mae=1.0000 base=1.2000 champion=-")
    assert forecast.verdict(spark, {"mae": 1.2}, base, None) == (False, "mae=1.2000 base=1.2000 champion=-")
    assert forecast.verdict(spark, {"mae": 1.0}, base, ("ridge", 0.9)) == (False, "mae=1.0000 base=1.2000 champion=0.9000")
    assert forecast.verdict(spark, {"mae": 1.0}, base, ("ridge", None))[0] and not forecast.verdict(spark, {"mae": None}, base, None)[0]
    assert forecast.drift_status({"z": None, "recalibrar": False, "n_erros": 4}) == {"recalibrar": False, "motivo": "errors=4 needed=5", "z_score": None, "media_recente": None, "media_historica": None}
    found = forecast.drift_status({"z": -2.51, "recalibrar": True, "media_recente": 1.0, "media_anterior": 2.0})
    assert found == {"recalibrar": True, "z_score": -2.51, "media_recente": 1.0, "media_historica": 2.0, "motivo": "z=-2.51 limit=2.0"}


def test_registry_keeps_the_rows_of_all_writers(spark, tmp_path):
    path, error = str(tmp_path / "registry"), {"mae": 1.0, "rmse": None, "mape": 0.5, "n_obs": 3}
    assert forecast.registry(spark, path).count() == 0 and forecast.champion(spark, path) is None
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: forecast.register(spark, path, f"m{k}", 9, error, k == 2, "x"), range(4)))
    rows = forecast.registry(spark, path).orderBy("versao").collect()
    assert [r["versao"] for r in rows] == ["v0001", "v0002", "v0003", "v0004"] and {r["modelo"] for r in rows} == {"m0", "m1", "m2", "m3"}
    assert forecast.champion(spark, path) == ("m2", 1.0)


def read(folder: Path) -> list[dict]:
    (part,) = folder.glob("part-*.csv")
    return list(csv.DictReader(part.open(encoding="utf-8")))


def test_whole_run_from_a_csv_file(spark, ledger_csv, tmp_path):
    out = tmp_path / "out"
    cli.main(["--input", str(ledger_csv), "--output", str(out), "--anonimizar", "--ml", "--data-dir", str(tmp_path / "data")])
    n = sum(1 for _ in csv.DictReader(ledger_csv.open(encoding="utf-8")))
    metrics, quotas, dominance = (read(out / name) for name in ("02_metricas_por_par", "03_politicas_cota", "04_dominancia"))
    assert len(metrics) == len(quotas) == 600 and 0 < len(dominance) <= 600
    keys = [(r["unidade"], r["produto"]) for r in metrics]
    assert keys == sorted(keys) and spark.read.parquet(str(out / "01_dataset_consolidado.parquet")).count() == n
    trail = {r["etapa"]: r for r in read(out / "log_auditoria")}
    assert trail["1.1_carga_e_normalizacao"]["linhas_entrada"] == str(n) == trail["1.1_carga_e_normalizacao"]["linhas_saida"]
    assert trail["2.1_agregacao_mensal"]["linhas_saida"] == "2400" and trail["3_politica_cota"]["delta"] == "0" and trail["4_dominancia_estocastica"]["linhas_saida"] == str(len(dominance))
    names = json.loads((out / "mapa_unidades.json").read_text(encoding="utf-8"))
    assert sorted(names.values()) == [f"Unidade_{k:02d}" for k in range(1, 16)]
    log = (out / "pipeline.log").read_text(encoding="utf-8")
    assert f"{n} linhas, 15 unidades, 110 produtos" in log and "modelo em uso: baseline_mmp" in log and "| INFO |" in log
    made, tested = read(out / "05_previsoes"), read(out / "06_backtest_walkforward")
    assert len(made) == 600 and {r["mes_previsao"] for r in made} == {"2026-05"} and {r["confiabilidade"] for r in made} == {"insuficiente"}
    assert {r["modelo"] for r in tested} == {"baseline_mmp"} and {r["fold"] for r in tested} == {"3"}
    assert {r["fonte_demanda"] for r in read(out / "04_dominancia_ml")} == {"empirica"}
    assert len(read(out / "historico_mensal")) == 2400
    registry = forecast.registry(spark, str(tmp_path / "data" / "model_registry")).collect()
    assert [(r["versao"], r["modelo"], r["promovido"]) for r in registry] == [("v0001", "baseline_mmp", False)]


def test_forecast_run_with_learnt_models_and_without_folds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(models, "MODELS", {"baseline_mmp": models.Baseline, "ridge": models.Ridge})
    monkeypatch.setattr(forecast, "MODELS", models.MODELS)
    r = random.Random(1)
    rows = [(f"u{u}", f"p{p}", "c", f"2025-{m:02d}", v, v, 0.0, v) for u in range(2) for p in range(3) for m in range(1, 10) for v in [float(r.randrange(1, 20))]]
    painel = spark.createDataFrame(rows, "unidade string, produto string, categoria string, mes string, consumo_total double, consumo_reg double, consumo_extra double, demanda_total double")
    metricas = painel.groupBy("unidade", "produto").agg(F.lit("X_regular").alias("classe_xyz"), F.avg("consumo_total").alias("consumo_medio_mensal"), F.lit(0.5).alias("cv"))
    dominancia = painel.select("unidade", "produto").distinct()
    made = forecast.run_forecast(spark, painel, metricas, dominancia, str(tmp_path / "a"))
    assert {x["modelo"] for x in made.backtest.select("modelo").distinct().collect()} == {"baseline_mmp", "ridge"}
    registry = forecast.registry(spark, str(tmp_path / "a" / "model_registry")).orderBy("versao").collect()
    assert [(x["versao"], x["modelo"]) for x in registry] == [("v0001", "baseline_mmp"), ("v0002", "ridge")] and all(x["notas"] for x in registry)
    assert made.campeao == ("ridge" if registry[1]["promovido"] else "baseline_mmp") and made.drift["motivo"]
    assert made.previsoes.where("previsao_substitui_c4 and confiabilidade = 'preliminar'").count() == 6 == made.dominancia_ml.where("fonte_demanda = 'ml_prevista'").count()
    few = forecast.run_forecast(spark, painel.where("mes <= '2025-03'"), metricas, dominancia, str(tmp_path / "b"))
    assert few.backtest is None and few.drift["recalibrar"] is False and few.previsoes.count() == 6


def test_upsert_by_order(spark):
    schema = "unidade string, produto string, mes string, v double, n int"
    old = spark.createDataFrame([("u", "p", "m", 9.0, 1), ("u", "p", "m", 5.0, 2)], schema)
    assert [r["v"] for r in history.upserted(old, old.limit(0), order="n").collect()] == [5.0]
    assert history.upserted(old, spark.createDataFrame([("u", "p", "m", 1.0, 0)], schema), order="n").columns == ["unidade", "produto", "mes", "v"]


def test_streams_add_up_late_and_split_months(spark, tmp_path):
    ledger = orders.normalised(synthetic.synthetic_ledger(spark)).where("produto < 'Produto_020'")
    source, path = tmp_path / "in", str(tmp_path / "state")
    for k in range(3):  # each month is split over three files
        ledger.where(F.pmod(F.xxhash64("unidade", "produto", "data_solic", "pedido_extra"), F.lit(3)) == k).coalesce(1).write.parquet(str(source / f"f{k}"))
        stream = spark.readStream.schema(ledger.schema).parquet(str(source / "*"))
        follow(stream, path, str(tmp_path / "check")).awaitTermination()
    plain = lambda df: {tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()}
    assert plain(followed(spark, path)) == plain(monthly_totals(ledger)) and len(list((tmp_path / "state").glob("lote=*"))) == 3
    stream = spark.readStream.schema(ledger.schema).parquet(str(source / "*"))
    query = windowed_demand(stream).writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert 0 < spark.table("windows").count()
    assert spark.table("windows").agg(F.sum("n_pedidos")).first()[0] <= ledger.count()
    assert Settings().months == tuple(m for m, *_ in synthetic.MONTHS[:4])
