"""Declared constraints, and decisions that are made again from forecasts, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotalab.config import Settings
from quotalab.operators import dominance as D
from quotalab.operators import history, rules

def plain_breaks(rows):
    """The names of the rules that each row breaks."""
    out = []
    for a, b, c, v in rows:
        names = [] if v is None or v >= 0 else ["positive"]
        names += ["key"] if a is not None and b is not None and sum((x, y) == (a, b) for x, y, *_ in rows) > 1 else []
        values = {z for x, _, z, _ in rows if x == a and a is not None and z is not None}
        names += ["one_c"] if len(values) > 1 and c is not None else []
        out.append(sorted(names + (["known"] if c is None else [])))
    return out


def test_rules_equal_plain_checks(spark):
    r = random.Random(1)
    rows = [(r.choice(["x", "y", "z", None]), r.choice([*range(40), None]), r.choice(["p", "p", "p", "q", None]), r.choice([1.0, 0.0, -1.0, None])) for _ in range(120)]
    rows += [("w", k, "p", 1.0) for k in range(100, 130)]
    table = spark.createDataFrame(rows, "a string, b long, c string, v double").repartition(6)
    declared = [rules.Check("positive", F.col("v") < 0), rules.Unique("key", ("a", "b")), rules.Depends("one_c", ("a",), "c"), rules.Check("known", F.col("c").isNull())]
    want = plain_breaks(rows)
    got = rules.judged(table, declared).collect()
    assert [(x["regra"], x["n_linhas"], x["n_violacoes"], x["valida"]) for x in got] == [(n, len(rows), k, not k) for n in ("positive", "key", "one_c", "known") for k in [sum(n in w for w in want)]]
    good, bad = rules.parted(table, declared)
    assert good.columns == table.columns and sorted(map(str, map(tuple, good.collect()))) == sorted(str(x) for x, w in zip(rows, want, strict=True) if not w)
    assert sorted(str((*x[:4], sorted(x["regras"]))) for x in bad.collect()) == sorted(str((*x, w)) for x, w in zip(rows, want, strict=True) if w)
    assert [x["n_violacoes"] for x in rules.judged(table.limit(0), declared).collect()] == [0, 0, 0, 0]
    assert rules.judged(table, declared[1:3]).count() == 2 and rules.parted(table.limit(0), declared)[1].count() == 0


@pytest.mark.parametrize("mode", ["reference", "cost"])
def test_decisions_from_forecasts(spark, mode):
    settings, levels = Settings(grid=40), 8
    r = random.Random(5)
    pairs = [(f"u{k}", f"p{k}") for k in range(20)]
    quota = [(u, p, "c", 5.0, float(r.randrange(1, 9)), float(r.randrange(1, 9)), float(r.randrange(5, 15))) for u, p in pairs]
    policies = spark.createDataFrame(quota, "unidade string, produto string, categoria string, consumo_medio_mensal double, consumo_reg_medio double, cota_conservadora double, cota_buffer double")
    series = {x: [float(r.randrange(12)) for _ in range(4)] for x in pairs}
    panel = spark.createDataFrame([(u, p, f"2026-0{m + 1}", v) for (u, p), s in series.items() for m, v in enumerate(s)], "unidade string, produto string, mes string, consumo_total double")
    made = [(u, p, r.uniform(0, 30), k % 3 > 0) for k, (u, p) in enumerate(pairs[:-2])] + [(*pairs[-2], -50.0, True)]
    forecasts = spark.createDataFrame(made, "unidade string, produto string, previsao double, previsao_substitui_c4 boolean")
    pool = [r.gauss(0, 4) for _ in range(60)]
    residuals = spark.createDataFrame([(x,) for x in pool], "residuo double")
    observed = D.dominated(D.expected(D.costs(panel, policies, settings)), settings, mode)
    before = {(x["unidade"], x["produto"]): x for x in observed.collect()}
    rows = {(x["unidade"], x["produto"]): x for x in history.decided_again(observed, forecasts, residuals, policies, settings, mode, levels).collect()}
    assert rows.keys() == before.keys() and any(x["politica_mudou"] for x in rows.values())
    active = {(u, p): v for u, p, v, on in made if on and v > -50}
    for (u, p), row in rows.items():
        assert row["fonte_demanda"] == ("ml_prevista" if (u, p) in active else "empirica") and row["politica_empirica"] == before[u, p]["politica_preferida"]
        if (u, p) not in active:
            assert all(row[c] == before[u, p][c] for c in before[u, p].asDict() if c.startswith(("custo_esp", "dom_", "politica_pref"))) and not row["politica_mudou"]
            continue
        demand = np.maximum(active[u, p] + np.percentile(pool, [100 * (k + 0.5) / levels for k in range(levels)]), 0)
        for name in D.POLICIES:
            q = row[f"q_{name}"]
            assert np.isclose(row[f"custo_esp_{name}"], (np.maximum(demand - q, 0) + 0.3 * np.maximum(q - demand, 0)).mean())
        best = min(D.POLICIES, key=lambda n: round(row[f"custo_esp_{n}"], 9))
        assert row["politica_preferida"] == {"buffer": "com_buffer"}.get(best, best) and row["politica_mudou"] == (row["politica_preferida"] != row["politica_empirica"])


def test_offending_equals_parted_rows(spark):
    r = random.Random(2)
    rows = [(r.choice(["x", "y", "z", None]), r.choice([*range(30), None]), r.choice(["p", "p", "p", "q", None]), float(r.randrange(-1, 4))) for _ in range(150)]
    table = spark.createDataFrame(rows, "a string, b long, c string, v double").repartition(5)
    declared = [rules.Check("positive", F.col("v") < 0), rules.Unique("key", ("a", "b")), rules.Depends("one_c", ("b",), "c"), rules.Check("known", F.col("c").isNull())]
    plain = rules.parted(table, declared)[1].select("a", "v", F.explode("regras").alias("regra")).groupBy("a", "regra").agg(F.count("*").alias("n"), F.sum("v").alias("v"))
    got = rules.offending(table, declared, "a", "v")
    assert got.columns == ["a", "regra", "n", "v"] and plain.count() > 10
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    for group in (rules._groups(table, declared[2]), rules.judged(table, declared)):
        assert "SortAggregate" not in group._jdf.queryExecution().executedPlan().toString()


def test_summary_sorts_no_rows(spark):
    from quotalab.queries import QUERIES

    made = QUERIES["ledger_summary"](spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Expand [[unidade" not in plan


def test_history_and_panel_are_made_once(spark):
    from quotalab.queries import QUERIES

    for name in ("close_cycle", "metrics_as_of", "forecast_interval_exact", "drift_zscore_rows"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "lineitem" not in plan and "l_orderkey" not in plan, name


def test_models_pass_over_parts_by_rows(spark, monkeypatch):
    from quotalab import queries

    seen = []

    class Fake:
        def fit(self, rows, features):
            seen.append((rows.rdd.getNumPartitions(), rows.count()))
            return self

        def predict(self, rows):
            return rows.withColumn("previsao", F.lit(0.0))

    monkeypatch.setitem(queries.MODELS, "lgbm", Fake)
    monkeypatch.setattr(queries, "ROWS_OF_A_PART", 700)
    made = queries.QUERIES["forecast_gbt"](spark, "/root/testdata/sf0.001").count()
    assert made and seen[0][0] == -(-(seen[0][1] + made) // 700) > 1
