"""Ridge regression for every month of a walk-forward backtest from one pass over the features.

A fold trains on all months before it, so its sums of products are cumulated ones: each task walks over its pairs in
order, cumulates the products of a pair's months, and adds the part before each fold's month to that fold's matrix. The
rows of a fold are also dealt to its ordered cross-validation parts by their place in the order of pairs. Units have no
columns of their own: an indicator's products are a count and the sums of the unit's rows, and the normal equations are
solved by eliminating the units first. Folds are solved apart from each other, in tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ForecastSettings, Settings
from ..functions.numbers import or_zero
from ..functions.shared import checkpointed
from ..operators.features import KEY, REGIMES, gate, one_hot, temporal, with_next_month, with_regimes
from .models import ordered_folds

METRIC = ["consumo_medio_hist", "cv_hist", *(f"regime_{r}" for r in REGIMES)]
_MODELS = "fold int, alpha double, n long, unidade string, value double, coef array<double>"


@dataclass(frozen=True)
class Design:
    """rows(unidade, produto, categoria, mes, t, trend_idx, is_future, y, x, m): x has the features named in dense, m the
    metrics of the pair; t is the place of the month among months."""

    rows: DataFrame
    dense: list[str]
    months: list[str]


def design(past: DataFrame, metrics: DataFrame, settings: ForecastSettings = ForecastSettings(), future: bool = False) -> Design:
    """The features of a history, with a row of the next month for each pair if future. Missing values count as 0."""
    # as many values as categories and months
    categories, months = past.agg(F.sort_array(F.collect_set("categoria")), F.sort_array(F.collect_set("mes"))).first()
    rows = with_next_month(past) if future else past.withColumn("is_future", F.lit(False))
    rows = one_hot(one_hot(with_regimes(temporal(rows, settings), metrics), "categoria", "cat", categories), "mes_num", "mes", list(range(1, 13)))
    dense = [*(f"lag_{i}" for i in range(1, settings.lags + 1)), "media_3m", "std_3m", "trend_idx", "mes_num", *(f"cat_{c}" for c in categories), *(f"mes_{m}" for m in range(1, 13))]
    value = lambda names: F.array(*(F.nanvl(or_zero(F.col(c).cast("double")), F.lit(0.0)) for c in names))
    place = F.when(F.col("is_future"), F.lit(len(months))).otherwise(F.array_position(F.lit(months), F.col("mes")) - 1).cast("int")
    y = F.when(~F.col("is_future"), F.greatest(F.nanvl(or_zero(F.col("consumo_total")), F.lit(0.0)), F.lit(0.0)))
    return Design(rows.select(*KEY, "categoria", "mes", place.alias("t"), "trend_idx", "is_future", y.alias("y"), value(dense).alias("x"), value(METRIC).alias("m")), dense, months)


def _regimes(n: np.ndarray, total: np.ndarray, squares: np.ndarray, settings: Settings) -> np.ndarray:
    """METRIC of a pair from how many months it has, their sum and their sum of squares: one row for each entry."""
    mean = total / np.maximum(n, 1)
    cv = np.where(mean > 0, np.sqrt(np.maximum(squares / np.maximum(n, 1) - mean**2, 0)) / np.where(mean > 0, mean, 1), 0.0)
    low = (mean > 0) & (mean < settings.low_rotation_mean)
    other = (mean > 0) & ~low
    x, y = other & (cv < settings.cv_regular), other & (cv >= settings.cv_regular) & (cv < settings.cv_moderate)
    return np.stack([mean, cv, x, y, other & ~x & ~y, low], axis=1).astype(float)


def metrics_as_of(past: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(unidade, produto, mes, n_meses, consumo_medio_hist, cv_hist, classe_xyz) of each pair and each month after its first.

    Mean and variation of the pair's own months before that month; nothing of the month itself or later is used.
    """
    months = past.select("mes").distinct()  # a small table
    grid = past.select(*KEY).distinct().crossJoin(F.broadcast(months)).join(past.select(*KEY, "mes", "consumo_total"), [*KEY, "mes"], "left")
    before = Window.partitionBy(*KEY).orderBy("mes").rowsBetween(Window.unboundedPreceding, -1)
    v = F.col("consumo_total")
    rows = grid.withColumns({"n_meses": F.count(v).over(before), "mean": F.avg(v).over(before), "q": F.avg(v * v).over(before)}).where("n_meses > 0")
    cv = F.when(F.col("mean") > 0, F.sqrt(F.greatest(F.col("q") - F.col("mean") * F.col("mean"), F.lit(0.0))) / F.col("mean"))
    rows = rows.withColumn("cv", F.round(cv, 12))
    kind = (
        F.when(F.col("cv").isNull(), "sem_consumo").when(F.col("mean") < settings.low_rotation_mean, "baixa_rotatividade")
        .when(F.col("cv") < settings.cv_regular, "X_regular").when(F.col("cv") < settings.cv_moderate, "Y_moderado").otherwise("Z_erratico")
    )
    return rows.select(*KEY, "mes", "n_meses", F.col("mean").alias("consumo_medio_hist"), or_zero(F.col("cv")).alias("cv_hist"), kind.alias("classe_xyz"))


def _lists(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten()).reshape(len(column), -1)


def _products(folds: list[int], starts: np.ndarray, before: dict[int, np.ndarray], centre: np.ndarray, scale: np.ndarray, as_of: Settings | None) -> Callable:
    """(fold, part, unit, i, v): row i of the products of (1, features, y) of a fold's part; i is -1 for sums of a unit.

    Rows come by pair and month, all rows of a pair in one task. starts has a row for each fold: the places where its parts
    begin, and the end. before has for each partition the rows of each month in the partitions before it.
    """
    at = np.array(folds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense: np.ndarray | float = 0.0
        units: dict[str, np.ndarray] = {}
        place = None  # rows before this pair, by fold

        def pair(table: pa.Table) -> None:
            nonlocal dense, place
            t, y = table.column("t").to_numpy(), table.column("y").to_numpy()
            if place is None:
                own = np.concatenate([[0], np.cumsum(before[table.column("part")[0].as_py()])])
                place = own[at]
            u = np.column_stack([np.ones(len(t)), _lists(table.column("x")), y])
            count = np.searchsorted(t, at)  # of each fold the months before it
            m = np.broadcast_to(_lists(table.column("m"))[0], (len(at), len(METRIC)))
            if as_of:
                n, s, q = (np.concatenate([[0.0], np.cumsum(v)])[count] for v in (np.ones(len(t)), y, y * y))
                m = _regimes(n, s, q, as_of)
            u[:, 1:-1] = (u[:, 1:-1] - centre[: u.shape[1] - 2]) / scale[: u.shape[1] - 2]
            m = (m - centre[u.shape[1] - 2 :]) / scale[u.shape[1] - 2 :]
            size = u.shape[1] + m.shape[1]
            sums = np.concatenate([np.zeros((1, u.shape[1] ** 2)), np.cumsum(np.einsum("ri,rj->rij", u, u).reshape(len(u), -1), axis=0)]).reshape(-1, u.shape[1], u.shape[1])
            if not isinstance(dense, np.ndarray):
                dense = np.zeros((len(at), starts.shape[1] - 1, size, size))
            unit = units.setdefault(table.column("unidade")[0].as_py(), np.zeros((len(at), starts.shape[1] - 1, size)))
            temporal_, metric = [0, *range(1, u.shape[1] - 1), size - 1], list(range(u.shape[1] - 1, size - 1))
            for j in range(starts.shape[1] - 1):
                lo, hi = (np.clip(starts[:, k] - place, 0, count) for k in (j, j + 1))
                k = np.flatnonzero(hi > lo)
                if not len(k):
                    continue
                part = np.zeros((len(k), size, size))
                own = sums[hi[k]] - sums[lo[k]]
                part[np.ix_(range(len(k)), temporal_, temporal_)] = own
                cross = own[:, 0, :, None] * m[k][:, None, :]
                part[np.ix_(range(len(k)), temporal_, metric)] = cross
                part[np.ix_(range(len(k)), metric, temporal_)] = cross.transpose(0, 2, 1)
                part[np.ix_(range(len(k)), metric, metric)] = own[:, 0, 0, None, None] * m[k][:, :, None] * m[k][:, None, :]
                dense[k, j] += part
                unit[k, j] += part[:, 0]
            place = place + count

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key = np.asarray(held.column("pair").combine_chunks())
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                pair(held.slice(a, b - a))
            held = held.slice(cuts[-1])
        if held is not None:
            pair(held)
        columns: list[list] = [[], [], [], [], []]

        def add(*row: object) -> None:
            for c, v in zip(columns, row, strict=True):
                c.append(v)

        if isinstance(dense, np.ndarray):
            for k, j in zip(*np.nonzero(dense[:, :, 0, 0]), strict=True):
                for i in range(dense.shape[2]):
                    add(int(at[k]), int(j), None, i, dense[k, j, i])
            for name, sums in units.items():
                for k, j in zip(*np.nonzero(sums[:, :, 0]), strict=True):
                    add(int(at[k]), int(j), name, -1, sums[k, j])
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["fold", "part", "unit", "i", "v"])

    return run


def ridge_with_units(g: np.ndarray, w: np.ndarray, spread: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(intercept and coefficients, offset of each unit) of ridge regression on features and unit indicators.

    g has the products of (1, features, y), w for each unit the sums of its rows, spread the variance of each indicator:
    the penalty is on standardised coefficients, so that of an offset is alpha * spread. Units are eliminated first; as
    each row has one unit, the intercept's equation is formed without cancellation.
    """
    load = alpha * spread
    share = w / (w[:, 0] + load)[:, None]
    inner = g - w.T @ share
    inner[0] = inner[:, 0] = load @ share
    s = inner[:-1, :-1] + alpha * np.diag([0.0] + [1.0] * (len(g) - 2))
    theta = np.linalg.solve(s, inner[:-1, -1])
    return theta, share[:, -1] - share[:, :-1] @ theta


def _determination(g: np.ndarray, w: np.ndarray, theta: np.ndarray, offset: np.ndarray) -> float:
    """R squared on the rows behind the sums; of a constant target 1 if it is met, else 0."""
    r = np.concatenate([-theta, [1.0]])
    error = max(float(r @ g @ r - 2 * offset @ (w @ r) + offset**2 @ w[:, 0]), 0.0)
    spread = max(float(g[-1, -1] - g[0, -1] ** 2 / g[0, 0]), 0.0)
    return 1 - error / spread if spread > 0 else float(error == 0)


def _solver(names: list[str], centre: np.ndarray, scale: np.ndarray, settings: ForecastSettings) -> Callable:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        fold, size = int(rows["fold"].iloc[0]), len(names) + 2
        known = sorted(rows["unit"].dropna().unique())
        number = {u: k for k, u in enumerate(known)}
        g, w = np.zeros((rows["part"].max() + 1, size, size)), np.zeros((rows["part"].max() + 1, len(known), size))
        for part, unit, i, v in zip(rows["part"], rows["unit"], rows["i"], rows["v"], strict=True):
            if i >= 0:
                g[part, i] = v
            else:
                w[part, number[unit]] = v
        # months have indicators once the history is long enough
        seasonal = gate(fold, settings) == "operacional"
        used = [k for k, name in enumerate(names) if seasonal or not (name.startswith("mes_") and name != "mes_num")]
        keep = [0, *(k + 1 for k in used), size - 1]
        g, w = g[np.ix_(range(len(g)), keep, keep)], w[:, :, keep]
        total, n = g.sum(0), g[:, 0, 0].sum()
        mean, square = total[0, 1:-1] / n, np.diag(total)[1:-1] / n
        var = square - mean**2
        spread = np.sqrt(np.where(var > 1e-12 * square, var, 1.0))  # a constant feature stays as it is
        to = np.eye(len(keep))
        to[1:-1, 0] = -mean / spread
        to[range(1, len(keep) - 1), range(1, len(keep) - 1)] = 1 / spread
        g, w = to @ g @ to.T, w @ to.T
        share = w[:, :, 0].sum(0) / n
        indicator = np.where(share < 1, share * (1 - share), 1.0)
        alpha = settings.alphas[0]
        if ordered_folds(int(n)):
            score = lambda a: np.mean([_determination(g[k], w[k], *ridge_with_units(g[:k].sum(0), w[:k].sum(0), indicator, a)) for k in range(1, len(g))])
            alpha = settings.alphas[int(np.argmax([score(a) for a in settings.alphas]))]
        theta, offset = ridge_with_units(g.sum(0), w.sum(0), indicator, alpha)
        coef = np.zeros(len(names))
        coef[used] = theta[1:] / spread / scale[used]
        start = theta[0] - theta[1:] @ (mean / spread) - coef @ centre
        out = [(fold, alpha, int(n), None, float(start), coef.tolist())] + [(fold, alpha, int(n), u, float(x), None) for u, x in zip(known, offset, strict=True)]
        return pd.DataFrame(out, columns=["fold", "alpha", "n", "unidade", "value", "coef"])

    return run


def fold_models(given: Design, folds: list[int], settings: ForecastSettings = ForecastSettings(), as_of: Settings | None = None) -> DataFrame:
    """(fold, alpha, n, unidade, value, coef): for each fold the intercept with the coefficients of dense and METRIC, where
    unidade is null, and the offset of each unit. A fold trains on the months before it, in one pass for all folds.

    Each fold takes the penalty of best mean R squared over its ordered parts, as plans.models.Ridge does, on features
    standardised over its own rows. With as_of, METRIC of a pair comes from its months before the fold. The driver gets a
    row for each month and partition; sums are added up by fold, part and feature or unit.
    """
    names = [*given.dense, *METRIC]
    placed = given.rows.where(~F.col("is_future")).repartitionByRange(*KEY).sortWithinPartitions(*KEY, "t")
    placed = checkpointed(placed.withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33)))
    counts = placed.groupBy("part", "t").count().collect()  # partitions x months
    per_part = {p: np.zeros(len(given.months), np.int64) for p in sorted({r["part"] for r in counts})}
    for r in counts:
        per_part[r["part"]][r["t"]] = r["count"]
    before, so_far = {}, np.zeros(len(given.months), np.int64)
    for p, own in per_part.items():
        before[p], so_far = so_far, so_far + own
    rows_of = np.concatenate([[0], np.cumsum(so_far)])  # of each fold
    parts = [[0, *(start for start, _ in ordered_folds(int(rows_of[f]))), int(rows_of[f])] for f in folds]
    most = max(map(len, parts), default=2)
    starts = np.array([p + [p[-1]] * (most - len(p)) for p in parts], np.int64)
    every = F.concat("x", "m")
    moments = placed.select(F.posexplode(every).alias("k", "v")).groupBy("k").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("spread")).collect()  # a row for each feature
    centre, scale = np.zeros(len(names)), np.ones(len(names))
    for r in moments:
        centre[r["k"]], scale[r["k"]] = r["mean"], r["spread"] or 1.0
    run = _products(folds, starts, before, centre, scale, as_of)
    sums = placed.select("part", F.xxhash64(*KEY).alias("pair"), "unidade", "t", "y", "x", "m").mapInArrow(run, "fold int, part int, unit string, i int, v array<double>")
    sums = sums.groupBy("fold", "part", "unit", "i").agg(Summarizer.sum(array_to_vector("v")).alias("v")).withColumn("v", vector_to_array("v"))
    return checkpointed(sums.groupBy("fold").applyInPandas(_solver(names, centre, scale, settings), _MODELS))


def predicted(rows: DataFrame, models: DataFrame) -> DataFrame:
    """rows(unidade, fold, x, m) with raw, what the fold's model says, and predicted, the same but never below 0."""
    fits = F.broadcast(models.where("coef is not null").select("fold", "alpha", "n", F.col("value").alias("start"), "coef"))  # a row for each fold
    offsets = models.where("coef is null").select("fold", "unidade", F.col("value").alias("offset"))
    sums = F.aggregate(F.zip_with(F.concat("x", "m"), "coef", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    out = rows.join(fits, "fold").join(offsets, ["fold", "unidade"], "left").withColumn("raw", F.col("start") + sums + or_zero(F.col("offset")))
    return out.withColumn("predicted", F.greatest("raw", F.lit(0.0))).drop("start", "offset")


def _as_of_rows(rows: DataFrame, settings: Settings) -> DataFrame:
    """rows with m from the pair's months before each row."""
    before = Window.partitionBy(*KEY).orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    n, s, q = F.count("y").over(before), or_zero(F.sum("y").over(before)), or_zero(F.sum(F.col("y") * F.col("y")).over(before))
    mean = F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0)
    out = rows.withColumns({"n": n, "s": s, "q": q}).withColumn("mean", mean)
    out = out.withColumn("cv", F.when(F.col("mean") > 0, F.sqrt(F.greatest(F.col("q") / F.col("n") - F.col("mean") * F.col("mean"), F.lit(0.0))) / F.col("mean")).otherwise(0.0))
    some, low, cv = F.col("mean") > 0, F.col("mean") < settings.low_rotation_mean, F.col("cv")
    flags = (some & ~low & (cv < settings.cv_regular), some & ~low & (cv >= settings.cv_regular) & (cv < settings.cv_moderate), some & ~low & (cv >= settings.cv_moderate), some & low)
    return out.withColumn("m", F.array("mean", "cv", *(f.cast("double") for f in flags))).drop("n", "s", "q", "mean", "cv")


def walk_forward_ridge(past: DataFrame, metrics: DataFrame, settings: ForecastSettings = ForecastSettings(), as_of: Settings | None = None) -> DataFrame:
    """The errors of ridge regression in every month after the first least_training ones, trained on the months before it.

    The columns are those of operators.history.walk_forward(), with alpha. A pair's first row gives no error; a history
    of too few months gives an empty table. With as_of, the metrics of pairs are those of the months before each fold.
    """
    given = design(past, metrics, settings)
    folds = list(range(settings.least_training, len(given.months)))
    rows = _as_of_rows(given.rows, as_of) if as_of else given.rows
    tested = rows.where((F.col("t") >= settings.least_training) & (F.col("trend_idx") >= 1)).withColumn("fold", F.col("t"))
    if folds:
        made = predicted(tested, fold_models(given, folds, settings, as_of))
    else:
        made = tested.where("false").withColumns({"alpha": F.lit(0.0), "predicted": F.lit(0.0)})
    off = F.abs(F.col("y") - F.col("predicted"))
    return made.select(
        "fold", F.col("mes").alias("mes_test"), *KEY, F.col("y").alias("actual"), "predicted", off.alias("abs_error"), (off * off).alias("sq_error"),
        F.when(F.col("y") > 0, off / F.col("y")).alias("pct_error"), "alpha",
    )


def next_month_ridge(past: DataFrame, metrics: DataFrame, settings: ForecastSettings = ForecastSettings()) -> tuple[DataFrame, DataFrame]:
    """(all rows of the history with previsao, the next month of each pair with previsao), by a model of the whole history."""
    given = design(past, metrics, settings, future=True)
    last = len(given.months)
    made = predicted(given.rows.withColumn("fold", F.lit(last)), fold_models(given, [last], settings)).withColumnRenamed("predicted", "previsao")
    return made.where(~F.col("is_future")), made.where("is_future")


def normal_equations(past: DataFrame, metrics: DataFrame, settings: ForecastSettings = ForecastSettings()) -> DataFrame:
    """(fold, feature, n, value): the left side of each fold's normal equations, from what its model says of its rows.

    For a standardised feature z with coefficient b it is (sum of z times the fitted values + alpha * b) / n; for the
    intercept, feature '1', the mean of the fitted values. The right side is the mean of z times the target.
    """
    given = design(past, metrics, settings)
    folds = list(range(settings.least_training, len(given.months)))
    models = fold_models(given, folds, settings)
    names = [*given.dense, *METRIC]
    ids = F.explode(F.sequence(F.col("t") + 1, F.lit(len(given.months) - 1)))
    rows = given.rows.where(F.col("t") < len(given.months) - 1).withColumn("fold", ids).where(F.col("fold") >= settings.least_training)
    every = F.concat("x", "m")
    parts = F.concat(every, F.transform(every, lambda v: v * v), F.transform(every, lambda v: v * F.col("raw")), F.array("raw"))
    made = predicted(rows, models).groupBy("fold").agg(Summarizer.sum(array_to_vector(parts)).alias("s"), *(F.first(c).alias(c) for c in ("n", "alpha", "coef")))
    sums = made.withColumn("s", vector_to_array("s")).select("fold", "n", "alpha", "coef", "s", F.posexplode(F.lit(names)).alias("k", "feature"))
    at = lambda block: F.get("s", F.col("k") + block * len(names)) / F.col("n")
    fitted = F.get("s", F.lit(3 * len(names))) / F.col("n")
    sums = sums.withColumns({"v": at(0), "vv": at(1), "vf": at(2), "f": fitted}).withColumn("var", F.col("vv") - F.col("v") * F.col("v"))
    left = (F.col("vf") - F.col("v") * F.col("f")) / F.sqrt("var") + F.col("alpha") * F.get("coef", F.col("k")) * F.sqrt("var") / F.col("n")
    name = F.col("feature")
    used = (F.col("var") > 1e-9 * F.col("vv")) & ((F.col("fold") >= settings.operational) | ~(name.startswith("mes_") & (name != "mes_num")))
    terms = sums.where(used).select("fold", "feature", "n", left.alias("value"))
    return terms.unionByName(sums.where("k = 0").select("fold", F.lit("1").alias("feature"), "n", F.col("f").alias("value")))
