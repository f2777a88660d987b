"""The ridge regression as a pyspark.ml Estimator: usable in pipelines and cross-validation, saved and loaded with them."""

from __future__ import annotations

from dataclasses import replace

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ForecastSettings
from ..functions.numbers import or_zero
from .models import Ridge


class PanelRidgeModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds predictionCol, never below 0; missing and non-finite entries of the features count as 0."""

    intercept = Param(Params._dummy(), "intercept", "what a row of zeros gets", TypeConverters.toFloat)
    coefficients = Param(Params._dummy(), "coefficients", "one for each feature, on its own scale", TypeConverters.toListFloat)
    alpha = Param(Params._dummy(), "alpha", "the penalty that was chosen", TypeConverters.toFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        x = F.transform(vector_to_array(self.getFeaturesCol()), lambda v: F.nanvl(or_zero(v), F.lit(0.0)))
        own = F.array(*(F.lit(c) for c in self.getOrDefault(self.coefficients)))
        total = F.aggregate(F.zip_with(x, own, lambda a, b: a * b), F.lit(self.getOrDefault(self.intercept)), lambda s, v: s + v)
        return dataset.withColumn(self.getPredictionCol(), F.greatest(total, F.lit(0.0)))


class PanelRidge(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Ridge regression on standardised features, with the penalty of best mean R squared over ordered folds.

    orderCols give the order of the folds. The features' size is taken from the first row; an empty table gives a model
    that predicts 0.
    """

    alphas = Param(Params._dummy(), "alphas", "penalties to choose from", TypeConverters.toListFloat)
    orderCols = Param(Params._dummy(), "orderCols", "columns that order the rows", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", labelCol: str = "label", predictionCol: str = "prediction", alphas: list[float] | None = None, orderCols: list[str] | None = None) -> None:
        super().__init__()
        self._setDefault(alphas=list(ForecastSettings().alphas), orderCols=["unidade", "produto", "mes"])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def setParams(self, **given: object) -> PanelRidge:
        return self._set(**given)

    def _fit(self, dataset: DataFrame) -> PanelRidgeModel:
        order, features = self.getOrDefault(self.orderCols), vector_to_array(self.getFeaturesCol())
        first = dataset.select(F.size(features)).first()
        names = [f"f{k}" for k in range(first[0] if first else 0)]
        table = dataset.select(*(F.col(c).alias(f"o{k}") for k, c in enumerate(order)), F.col(self.getLabelCol()).cast("double").alias("consumo_total"), *(features[k].alias(n) for k, n in enumerate(names)))
        settings = replace(ForecastSettings(), alphas=tuple(self.getOrDefault(self.alphas)))
        made = Ridge(settings, tuple(f"o{k}" for k in range(len(order)))).fit(table, names)
        coefficients = [float(b / s) for b, s in zip(made.beta[1:], made.spread, strict=True)]
        model = PanelRidgeModel()._set(intercept=float(made.beta[0] - sum(c * m for c, m in zip(coefficients, made.mean, strict=True))), coefficients=coefficients, alpha=float(made.alpha))
        return model._set(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol())
