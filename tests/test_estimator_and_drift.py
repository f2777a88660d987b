"""The estimator in pipelines and cross-validation, and drift states of a stream, against plain versions."""

import random

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from quotalab.operators import history
from quotalab.plans.estimator import PanelRidge, PanelRidgeModel
from quotalab.plans.models import Ridge
from quotalab.streaming.drift import drift_of, follow_errors


def table_of(spark, n=150):
    r = random.Random(3)
    rows = [(f"u{k % 5}", f"p{k % 3}", f"{2000 + k}-01", a, b, None if k % 13 == 0 else a * b, 3 * a - b + r.gauss(0, 1) + 9) for k in range(n) for a, b in [(r.gauss(2, 1), r.random() * 50)]]
    return spark.createDataFrame(rows, "unidade string, produto string, mes string, a double, b double, c double, label double").repartition(4)


def test_estimator_equals_ridge_and_survives_saving(spark, tmp_path):
    rows = table_of(spark)
    stages = [VectorAssembler(inputCols=["a", "b", "c"], outputCol="features", handleInvalid="keep"), PanelRidge(predictionCol="previsao")]
    pipeline = Pipeline(stages=stages)
    pipeline.write().save(str(tmp_path / "pipeline"))
    model = Pipeline.load(str(tmp_path / "pipeline")).fit(rows)
    model.write().save(str(tmp_path / "model"))
    values = lambda df: df.orderBy("mes").toPandas().previsao.to_numpy()
    made, again = values(model.transform(rows)), values(PipelineModel.load(str(tmp_path / "model")).transform(rows))
    plain = Ridge().fit(rows.withColumn("consumo_total", F.col("label")), ["a", "b", "c"])
    assert np.array_equal(made, again) and np.allclose(made, values(plain.predict(rows)))
    assert model.stages[-1].getOrDefault("alpha") == plain.alpha and isinstance(model.stages[-1], PanelRidgeModel)
    empty = pipeline.fit(rows.limit(0))
    assert set(values(empty.transform(rows))) == {0.0}


def test_estimator_in_cross_validation(spark):
    rows = table_of(spark)
    ridge = PanelRidge(orderCols=["mes"])
    grid = ParamGridBuilder().addGrid(ridge.alphas, [[0.01], [1e6]]).build()
    table = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)
    best = CrossValidator(estimator=ridge, estimatorParamMaps=grid, evaluator=RegressionEvaluator(), numFolds=3, seed=1).fit(table)
    assert best.bestModel.getOrDefault("alpha") == 0.01 and best.avgMetrics[0] < best.avgMetrics[1]


def test_drift_states_equal_the_batch_rows(spark, tmp_path):
    r = random.Random(7)
    rows = [("m", f, f"u{u}", f"p{p}", abs(r.gauss(3, 1)) + (f == 11 and u == 5) * 40) for f in range(3, 12) for u in range(6) for p in range(5)]
    rows += [("few", 3, "u0", f"p{p}", 1.0 + p) for p in range(4)] + [("five", 3, "u0", f"p{p}", 1.0 + p) for p in range(5)] + [("m", 4, "u0", "px", None)]
    schema = "modelo string, fold int, unidade string, produto string, abs_error double"
    source, path = tmp_path / "in", str(tmp_path / "state")
    r.shuffle(rows)
    for k in range(4):  # late folds and any order, a run of the stream for each part
        spark.createDataFrame(rows[k::4], schema).write.parquet(str(source / f"f{k}"))
        follow_errors(spark.readStream.schema(schema).parquet(str(source / "*")), path, str(tmp_path / "log")).awaitTermination()
    got = {x["modelo"]: x for x in drift_of(spark, path).collect()}
    assert set(got) == {"m", "few", "five"}
    for name, own in got.items():
        errors = spark.createDataFrame([x for x in rows if x[0] == name and x[4] is not None], schema)
        want = history.drift(errors, ["fold", "unidade", "produto"]).first()
        for c in ("n_erros", "media_recente", "media_anterior", "z", "recalibrar"):
            assert own[c] == want[c] or np.isclose(own[c], want[c]), (name, c)
    assert got["few"]["z"] is None and not got["few"]["recalibrar"] and got["m"]["recalibrar"]
