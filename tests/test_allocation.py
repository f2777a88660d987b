"""Layers 1 to 6 on hand-computed fixtures."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quotalab import queries
from quotalab.config import Settings
from quotalab.functions.numbers import number, round_even
from quotalab.functions.text import category, next_month, yes_no
from quotalab.operators import dominance, features, history, orders, panel, policy
from quotalab.sources.ledger import COLUMNS, html_rows, read_ledger
from quotalab.sources.snapshots import read_snapshot, write_snapshot


def one(spark, **columns):
    row = spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()
    return tuple(row)


@pytest.mark.parametrize(
    "status,solic,env,rec,consumo,demanda",
    [
        ("Rejeitado", 10, 10, 10, 0, 0), ("Finalizado", 10, 8, 9, 8, 10), ("Finalizado", 10, 0, 6, 6, 10), ("Finalizado", 10, 12, 0, 10, 10),
        ("Enviada", 0, 5, 0, 5, 0), ("Pendente", 7, 0, 0, 7, 7), ("Finalizado", 7, 0, 0, 0, 7),
    ],
)
def test_consumption_tree(spark, status, solic, env, rec, consumo, demanda):
    rows = spark.createDataFrame([(status, float(solic), float(env), float(rec))], "status string, qtd_solic double, qtd_env double, qtd_rec double")
    row = orders.consolidated(orders.flagged(rows)).first()
    assert (row["qtd_consumo"], row["qtd_demanda"]) == (consumo, demanda)
    assert row["flag_env_maior_solic"] == (env > solic) and row["flag_rec_maior_env"] == (rec > env)


@pytest.mark.parametrize(
    "values,mean,cv,kind,k,projected,buffered",
    [
        ((10, 10, 10, 10), 10, 0, "X_regular", 0.5, 10, 10), ((4, 6, 4, 6), 5, 0.2, "X_regular", 0.5, 5.2, 5.7), ((2, 6, 2, 6), 4, 0.5, "Y_moderado", 1.0, 4.4, 6.4),
        ((0, 8, 0, 8), 4, 1.0, "Z_erratico", 1.25, 4.8, 9.8), ((0, 0, 12, 0), 3, 1.7321, "Z_erratico", 1.5, 3.6, 11.39), ((0, 1, 0, 2), 0.75, 1.1055, "baixa_rotatividade", 0.5, 1.0, 1.41),
        ((0, 0, 0, 0), 0, None, "sem_consumo", 0.5, 0, 0),
    ],
)
def test_metrics_and_policy(spark, values, mean, cv, kind, k, projected, buffered):
    months = ("2026-01", "2026-02", "2026-03", "2026-04")
    rows = [("u", "p", "c", m, *([0.0] * len(panel.SPLITS))) for m in months]
    names = ["unidade", "produto", "categoria", "mes", *panel.SPLITS]
    at = names.index("consumo_reg")
    rows = [(*r[:at], float(v), *r[at + 1 :]) for r, v in zip(rows, values)]
    frame = panel.balanced(spark.createDataFrame(rows, names), months)
    assert frame.count() == 4
    row = policy.policies(panel.metrics(frame, months)).first()
    assert row["consumo_medio_mensal"] == mean and row["classe_xyz"] == kind and row["k"] == k
    assert row["cv"] == (None if cv is None else pytest.approx(cv, abs=1e-4))
    assert (row["cota_conservadora"], row["cota_buffer"]) == (projected, buffered)


@pytest.mark.parametrize(
    "mean,quota,regular,share,action",
    [
        (0.49, 5.0, 1.0, 0.9, "baixa_materialidade"), (5.0, 5.2, 5.0, 0.40, "reforcar"), (5.0, 5.2, 5.0, 0.39, "manter"), (5.0, 6.2, 5.0, 0.10, "aumentar"),
        (5.0, 3.0, 5.0, 0.10, "reduzir"), (5.0, 3.0, 4.5, 0.10, "manter"), (5.0, 5.2, 5.0, None, "manter"),
    ],
)
def test_action(spark, mean, quota, regular, share, action):
    assert one(spark, a=policy.action(F.lit(mean), F.lit(quota), F.lit(regular), F.lit(share).cast("double"))) == (action,)


def test_rounding_and_text(spark):
    assert one(spark, a=round_even(F.lit(1.015), 2), b=round_even(F.lit(2.675), 2), c=round_even(F.lit(0.125), 2)) == (1.01, 2.68, 0.12)
    assert one(spark, a=number(F.lit("x")), b=number(F.lit("NaN")), c=number(F.lit("2.5"))) == (0.0, 0.0, 2.5)
    assert one(spark, a=category(F.lit(" categÓria_a\t")), b=yes_no(F.lit("Não")), c=yes_no(F.lit("?")), d=next_month(F.lit("2026-12"))) == ("CATEGORIA_A", False, None, "2027-01")


def test_cost_and_dominance(spark):
    assert one(spark, a=dominance.cost(F.lit(10.0), F.lit(7.0)), b=dominance.cost(F.lit(7.0), F.lit(10.0))) == pytest.approx((3.0, 0.9))
    array = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    high, low, mixed = array(10, 10), array(0, 0), array(0, 3, 7)
    assert one(spark, a=dominance.dominance(high, low), b=dominance.dominance(low, high), c=dominance.dominance(mixed, mixed), d=dominance.dominance(high, high)) == ("A", "B", "nenhuma", "nenhuma")
    assert one(spark, a=dominance.cheaper(high, low), b=dominance.cheaper(low, high), c=dominance.cheaper(mixed, mixed)) == ("B", "A", "nenhuma")


def test_features_and_baseline(spark):
    past = spark.createDataFrame([("u", "p", "c", f"2026-0{k + 1}", v) for k, v in enumerate((1.0, 2.0, 4.0, 8.0))], "unidade string, produto string, categoria string, mes string, consumo_total double")
    rows = features.temporal(features.with_next_month(past)).orderBy("mes").collect()
    assert [r["lag_1"] for r in rows] == [0, 1, 2, 4, 8] and [r["trend_idx"] for r in rows] == [0, 1, 2, 3, 4]
    assert [round(r["media_3m"], 4) for r in rows] == [0, 1, 1.5, 2.3333, 4.6667] and [round(r["std_3m"], 4) for r in rows] == [0, 0, 0.5, 1.2472, 2.4944]
    made = features.forecast(features.temporal(features.with_next_month(past))).first()
    assert made["previsao"] == pytest.approx(4.9) and made["mes_previsao"] == "2026-05" and made["intervalo_inferior_90"] <= made["intervalo_superior_90"]
    assert [features.gate(t) for t in (7, 8, 17, 18)] == ["insuficiente", "preliminar", "preliminar", "operacional"]
    assert history.walk_forward(past.where("mes < '2026-04'")).count() == 0
    fold = history.walk_forward(past).collect()
    assert [(r["fold"], r["predicted"]) for r in fold] == [(3, pytest.approx(2.4))]


def test_upsert_drift_promotion_cycle(spark, tmp_path):
    schema = "unidade string, produto string, mes string, v double"
    old, new = spark.createDataFrame([("u", "p", "m", 5.0), ("u", "q", "m", 1.0)], schema), spark.createDataFrame([("u", "p", "m", 7.0)], schema)
    once = history.upserted(old, new)
    assert {tuple(r) for r in once.collect()} == {("u", "p", "m", 7.0), ("u", "q", "m", 1.0)} == {tuple(r) for r in history.upserted(once, new).collect()}
    errors = spark.createDataFrame([(k, v) for k, v in enumerate((1.0, 2.0, 3.0, 4.0, 10.0, 10.0, 10.0))], "k int, abs_error double")
    row = history.drift(errors, ["k"]).first()
    assert row["z"] == pytest.approx(6.7082, abs=1e-4) and row["recalibrar"]
    row = history.drift(errors.where("k < 4"), ["k"]).first()
    assert row["z"] is None and row["recalibrar"] is False
    null = F.lit(None).cast("double")
    for c, b, h, want in ((1.0, 1.2, None, True), (1.2, 1.2, None, False), (1.0, 1.2, 0.9, False), (float("nan"), 1.2, None, False)):
        assert one(spark, p=history.promotes(F.lit(c), F.lit(b), null if h is None else F.lit(h))) == (want,)
    schema = old.schema
    path = str(tmp_path / "state")
    assert read_snapshot(spark, path, schema).count() == 0
    assert write_snapshot(old, path) == 1 and write_snapshot(history.upserted(read_snapshot(spark, path, schema), new), path) == 2
    assert read_snapshot(spark, path, schema).where("v = 7").count() == 1


def test_sources(spark, tmp_path):
    row = ["u", "2026-01-03", "p", "c", "5", "x", "", "Pendente", "Sim", "Janeiro/2026"]
    (tmp_path / "a.csv").write_text(",".join(COLUMNS) + "\n" + ",".join(row) + "\n")
    (tmp_path / "a.xls").write_text("<table><tr>" + "".join(f"<th>{c}</th>" for c in COLUMNS) + "</tr><tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr></table>")
    for name in ("a.csv", "a.xls"):
        made = orders.normalised(read_ledger(spark, str(tmp_path / name))).first()
        assert (made["qtd_solic"], made["qtd_env"], made["qtd_rec"], made["pedido_extra"], made["mes"]) == (5.0, 0.0, 0.0, True, "2026-01")
    with pytest.raises(ValueError):
        html_rows("<p>none</p>")


def test_entry_is_whole_without_the_text_operators(spark):
    found = entry.queries()
    assert set(entry.oracle_sql()) <= set(found)
    assert entry.entry(spark).columns[:3] == ["unidade", "produto", "categoria"]
    assert Settings().weights == (0.10, 0.20, 0.30, 0.40)


def test_no_python_in_core_plans(spark):
    for name in ("suggested_action", "ssd_reference", "walk_forward_baseline"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_models_learn_from_all_months_with_all_indicators(spark, monkeypatch):
    seen = {}

    class Recorder:
        def fit(self, rows, features):
            seen["months"], seen["features"] = {r[0] for r in rows.select("mes").distinct().collect()}, features
            return self

        def predict(self, rows):
            return rows.withColumn("previsao", F.lit(0.0))

    folder = "/root/testdata/sf0.001"
    monkeypatch.setitem(queries.MODELS, "poisson", Recorder)
    pairs = queries.QUERIES["forecast_poisson"](spark, folder).count()
    past = spark.read.parquet(f"{folder}/orders.parquet").join(spark.read.parquet(f"{folder}/lineitem.parquet"), F.col("o_orderkey") == F.col("l_orderkey"))
    assert seen["months"] == {r[0] for r in past.select(F.date_format("o_orderdate", "yyyy-MM")).distinct().collect()} and len(seen["months"]) > 19
    given = queries.L.design(queries._history(spark, folder), queries._metrics(spark, folder))
    assert set(given.months) == seen["months"] and {r[0] for r in given.rows.select("mes").distinct().collect()} == seen["months"]
    assert queries.QUERIES["forecast_ridge"](spark, folder).count() == pairs
    units = queries.ledger(spark, folder).select("unidade").distinct().collect()
    assert {f"unit_{r[0]}" for r in units} | {f"mes_{m}" for m in range(1, 13)} <= set(seen["features"])
    assert pairs == queries.ledger(spark, folder).select("unidade", "produto", "categoria").distinct().count()


def test_close_cycle_takes_every_forecast_by_the_gate(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    rows = queries.close_cycle(spark, folder).collect()
    made = {(r["unidade"], r["produto"]) for r in queries.forecast_baseline(spark, folder).collect()}
    assert {(r["unidade"], r["produto"]) for r in rows if r["fonte_demanda"] == "ml_prevista"} == {(r["unidade"], r["produto"]) for r in rows} & made
    assert any(int(r["produto"].split("#")[1]) % 2 and r["confiabilidade_ml"] == "operacional" for r in rows)
    few = queries._history(spark, folder, queries.MONTHS)
    monkeypatch.setattr(queries, "_history", lambda *_: few)
    rows = queries.close_cycle(spark, folder).collect()
    assert {(r["fonte_demanda"], r["confiabilidade_ml"], r["demanda_prevista"]) for r in rows} == {("empirica", "insuficiente", None)}
