"""Forecast models over feature tables: the baseline as a column, the others by pyspark.ml."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.errors import IllegalArgumentException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ForecastSettings
from ..functions.numbers import first_match, or_zero
from ..operators.features import baseline


class ForecastModel(Protocol):
    """fit() on rows with features and consumo_total; predict() adds the column previsao, never below 0."""

    name: str

    def fit(self, rows: DataFrame, features: list[str]) -> ForecastModel: ...

    def predict(self, rows: DataFrame) -> DataFrame: ...


class Baseline:
    """Weighted lags: nothing is learnt."""

    name = "baseline_mmp"

    def fit(self, rows: DataFrame, features: list[str]) -> Baseline:
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("previsao", baseline())


class _Learnt:
    model: PipelineModel

    def _target(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("y", F.greatest(F.col("consumo_total"), F.lit(0.0)))

    def predict(self, rows: DataFrame) -> DataFrame:
        other = [c for c in ("features", "x", "prediction") if c in self.model.transform(rows.limit(0)).columns]
        return self.model.transform(rows).withColumn("previsao", F.greatest(F.col("prediction"), F.lit(0.0))).drop(*other)


def ordered_folds(n: int, most: int = 3) -> list[tuple[int, int]]:
    """(first, last + 1) of the rows that each fold is tested on, trained on all before: equal parts at the end.

    As many folds as min(most, max(2, n // 10)); none if a fold would have no rows.
    """
    folds = min(most, max(2, n // 10))
    size = n // (folds + 1)
    return [(n - k * size, n - (k - 1) * size) for k in range(folds, 0, -1)] if size else []


def _moments(features: list[str], mean: np.ndarray, spread: np.ndarray):
    """By part: the sums of products of (1, standardised features, y), a row for each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.stack([batch.column(f).to_numpy(zero_copy_only=False) for f in features], axis=1)
            z = np.column_stack([np.ones(len(x)), (x - mean) / spread, batch.column("y").to_numpy(zero_copy_only=False)])
            part = batch.column("part").to_numpy()
            for k in np.unique(part).tolist():
                own = z[part == k]
                sums[k] = sums.get(k, 0.0) + own.T @ own
        for k, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(m), pa.int32()), pa.array(range(len(m)), pa.int32()), pa.array(list(m), pa.list_(pa.float64()))], ["part", "i", "v"])

    return run


def solved(m: np.ndarray, alpha: float) -> np.ndarray:
    """Intercept and coefficients of ridge regression from the sums of products; the intercept bears no penalty."""
    n = m[0, 0]
    centre = m[0, 1:-1] / n
    a = m[1:-1, 1:-1] - n * np.outer(centre, centre)
    b = m[1:-1, -1] - m[0, -1] * centre
    beta = np.linalg.solve(a + alpha * np.eye(len(a)), b)
    return np.concatenate([[m[0, -1] / n - centre @ beta], beta])


def determination(m: np.ndarray, beta: np.ndarray) -> float:
    """R squared of a solution on the rows behind the sums; of a constant target 1 if it is met, else 0."""
    w = np.concatenate([-beta, [1.0]])
    error, spread = max(float(w @ m @ w), 0.0), max(float(m[-1, -1] - m[0, -1] ** 2 / m[0, 0]), 0.0)
    return 1 - error / spread if spread > 0 else float(error == 0)


class Ridge(_Learnt):
    """Ridge regression on standardised features; the penalty of best mean R squared over ordered folds.

    Rows are ordered by pair and month. One pass over range-partitioned rows sums the products of each fold's rows;
    all penalties and folds are solved from these sums, which have a row for each feature. Missing values count as 0.
    With too few rows for a fold the first penalty is taken.
    """

    name = "ridge"

    def __init__(self, settings: ForecastSettings = ForecastSettings(), order: tuple[str, ...] = ("unidade", "produto", "mes")) -> None:
        self.alphas, self.order = settings.alphas, list(order)

    def fit(self, rows: DataFrame, features: list[str]) -> Ridge:
        order = self.order
        rows = self._target(rows).select(*order, or_zero(F.col("y")).alias("y"), *(F.nanvl(or_zero(F.col(f).cast("double")), F.lit(0.0)).alias(f) for f in features))
        stats = rows.agg(F.count("*"), *(F.avg(f) for f in features), *(F.stddev_pop(f) for f in features)).first()
        n, d = stats[0], len(features)
        self.features, self.alpha = features, self.alphas[0]
        self.mean = np.array([x or 0.0 for x in stats[1 : d + 1]])
        self.spread = np.array([x or 1.0 for x in stats[d + 1 :]])  # a constant feature stays as it is
        if not n:
            self.beta = np.zeros(d + 1)
            return self
        placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).persist(StorageLevel.MEMORY_AND_DISK)
        partition, inside = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
        counts = sorted(placed.groupBy(partition.alias("p")).count().collect())  # a row for each partition
        offsets = rows.sparkSession.createDataFrame([(p, sum(c for _, c in counts[:k])) for k, (p, _) in enumerate(counts)], "p long, before long")
        folds = ordered_folds(n)
        part = first_match(0, *((F.col("before") + inside >= start, k + 1) for k, (start, _) in reversed([*enumerate(folds)])))
        parts = placed.join(F.broadcast(offsets), partition == F.col("p")).withColumn("part", part).select("part", "y", *features)
        made = parts.mapInArrow(_moments(features, self.mean, self.spread), "part int, i int, v array<double>")
        made = made.select("part", "i", F.posexplode("v").alias("j", "v")).groupBy("part", "i", "j").agg(F.sum("v").alias("v")).collect()  # products of features
        m = np.zeros((len(folds) + 1, d + 2, d + 2))
        for r in made:
            m[r["part"], r["i"], r["j"]] = r["v"]
        placed.unpersist()
        if folds:
            scores = [np.mean([determination(m[k], solved(m[:k].sum(0), alpha)) for k in range(1, len(m))]) for alpha in self.alphas]
            self.alpha = self.alphas[int(np.argmax(scores))]
        self.beta = solved(m.sum(0), self.alpha)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        there = set(rows.columns)
        value = lambda f: F.nanvl(or_zero(F.col(f).cast("double")), F.lit(0.0)) if f in there else F.lit(0.0)
        terms = [(value(f) - float(m)) * float(b / s) for f, m, s, b in zip(self.features, self.mean, self.spread, self.beta[1:], strict=True)]
        return rows.withColumn("previsao", F.greatest(sum(terms, F.lit(float(self.beta[0]))), F.lit(0.0)))


class Boosted(_Learnt):
    """Gradient boosted trees for the absolute error."""

    name = "lgbm"

    def __init__(self, settings: ForecastSettings = ForecastSettings(), trees: int = 100) -> None:
        self.seed, self.trees = settings.seed, trees

    def fit(self, rows: DataFrame, features: list[str]) -> Boosted:
        trees = GBTRegressor(labelCol="y", lossType="absolute", maxIter=self.trees, stepSize=0.05, maxDepth=4, minInstancesPerNode=10, seed=self.seed)
        self.model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), trees]).fit(self._target(rows))
        return self


class Poisson(_Learnt):
    """Poisson regression; of few rows only lags and trend; if it cannot be fitted, the mean of the target."""

    name = "poisson"

    def fit(self, rows: DataFrame, features: list[str]) -> Poisson:
        rows = self._target(rows)
        n, mean = rows.agg(F.count("*"), F.avg("y")).first()
        if n < 50:
            features = [f for f in features if f.startswith("lag_") or f == "trend_idx"]
        self.mean, self.model = mean or 0.0, None
        glm = GeneralizedLinearRegression(labelCol="y", family="poisson", link="log", regParam=1e-6, maxIter=50)
        try:
            self.model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), glm]).fit(rows)
        except IllegalArgumentException as why:  # a target without any demand, or features that cannot be solved
            self.failure = str(why)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        return super().predict(rows) if self.model else rows.withColumn("previsao", F.lit(float(self.mean)))


#: Models by name; add one here to extend the set.
MODELS = {"baseline_mmp": Baseline, "ridge": Ridge, "lgbm": Boosted, "poisson": Poisson}


def available(months: int, settings: ForecastSettings = ForecastSettings()) -> list[str]:
    """Models worth training on so many months: the baseline alone below the preliminary gate."""
    return list(MODELS) if months >= settings.preliminary else ["baseline_mmp"]
