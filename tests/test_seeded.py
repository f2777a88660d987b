"""Seeded draws, ranks and weighted dominance against plain versions."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from quotalab.config import SEED, ForecastSettings, Settings
from quotalab.functions.ranks import ranked
from quotalab.operators import dominance as D
from quotalab.operators.intervals import seeded_interval


def test_ranks_are_places_in_the_sorted_order(spark):
    r = random.Random(1)
    values = [r.choice([r.random(), 0.5, -1.0]) for _ in range(500)]
    rows = ranked(spark.createDataFrame([(v, k) for k, v in enumerate(values)], "v double, k int").repartition(7), "v", "k").collect()
    assert [(x["v"], x["k"]) for x in sorted(rows, key=lambda x: x["rank"])] == sorted((v, k) for k, v in enumerate(values))
    assert sorted(x["rank"] for x in rows) == list(range(500)) and {x["n"] for x in rows} == {500}
    assert ranked(spark.createDataFrame([], "v double"), "v").count() == 0


def plain_place(size, *parts):
    return int(hashlib.md5("|".join(map(str, [*parts, SEED])).encode()).hexdigest()[:15], 16) % size


def test_seeded_interval_equals_numpy(spark):
    r = random.Random(2)
    pool = [r.gauss(0, 5) for _ in range(200)]
    forecasts = [(f"u{k}", f"p{k % 3}", float(k)) for k in range(12)]
    made = spark.createDataFrame(forecasts, "unidade string, produto string, previsao double")
    residuals = spark.createDataFrame([(x,) for x in pool] + [(None,)], "residuo double").repartition(5)
    rows = {(x["unidade"], x["produto"]): x for x in seeded_interval(made, residuals).collect()}
    again = {(x["unidade"], x["produto"]): x for x in seeded_interval(made, residuals.repartition(2)).collect()}
    pool.sort()
    for u, p, v in forecasts:
        sample = [max(v + pool[plain_place(200, u, p, k)], 0.0) for k in range(500)]
        got = rows[u, p]
        assert np.allclose([got["intervalo_inferior_90"], got["intervalo_superior_90"]], np.percentile(sample, [5, 95])) and got == again[u, p]
    alone = seeded_interval(made, residuals.limit(0), ForecastSettings(draws=9)).collect()
    assert all(x["intervalo_inferior_90"] == x["previsao"] == x["intervalo_superior_90"] for x in alone)


def plain_dominance(a, b, points):
    """Cumulated counts on a grid of equally spaced points."""
    low, high = min(a.min(), b.min()), max(a.max(), b.max())
    grid = np.array([i * ((high - low) / (points - 1)) + low for i in range(points - 1)] + [high])
    x, y = (np.cumsum([(c <= z).sum() for z in grid]) for c in (a, b))
    return "A" if (x <= y).all() and (x < y).any() else "B" if (y <= x).all() and (y < x).any() else "nenhuma"


def test_drawn_dominance_equals_all_draws(spark):
    r = random.Random(3)
    settings = Settings(replicas=300, grid=50)
    series = [[float(r.choice([0, 1, 2, 5, 9, 30])) for _ in range(4)] for _ in range(25)] + [[3.0] * 4]
    quota = [[float(r.randrange(12)) for _ in range(3)] for _ in range(25)] + [[3.0, 3.0, 3.0]]
    rows = [(f"u{k}", f"p{k}", "C", s, *q) for k, (s, q) in enumerate(zip(series, quota, strict=True))]
    table = spark.createDataFrame(rows, "unidade string, produto string, categoria string, s array<double>, q_atual double, q_conservadora double, q_buffer double")
    table = table.withColumns({f"c_{p}": F.transform("s", lambda d: D.cost(d, F.col(f"q_{p}"), settings)) for p in D.POLICIES})  # noqa: B023
    found = {x["unidade"]: x for x in D.drawn_dominance(D.drawn(table, settings), settings).collect()}
    right = {x["unidade"]: x for x in D.drawn_dominance(D.drawn(table, settings), settings, "cost").collect()}
    assert len(found) == len(rows)
    for u, p, c, s, *q in rows:
        costs = {}
        for name, own in zip(D.POLICIES, q, strict=True):
            places = [int(hashlib.md5(f"{u}|{p}|{c}|{name}|{k}|{SEED}".encode()).hexdigest()[:8], 16) % 4 for k in range(300)]
            v = np.array([s[i] for i in places])
            costs[name] = np.maximum(v - own, 0) + 0.3 * np.maximum(own - v, 0)
            assert np.isclose(found[u][f"custo_esp_{name}"], costs[name].mean())
        assert found[u]["politica_preferida"] == {"buffer": "com_buffer"}.get(x := min(D.POLICIES, key=lambda n: round(costs[n].mean(), 9)), x)
        for name, a, b in D.COMPARED:
            assert found[u][name] == plain_dominance(costs[a], costs[b], 50), (u, name)
            levels = np.union1d(costs[a], costs[b])
            x, y = (np.array([round(np.maximum(costs[n] - z, 0).sum(), 6) for z in levels]) for n in (a, b))
            assert right[u][name] == ("A" if (x <= y).all() and (x < y).any() else "B" if (y <= x).all() and (y < x).any() else "nenhuma")
