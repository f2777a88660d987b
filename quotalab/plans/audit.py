"""The audit trail: rows in and out of each step, counted while the step's own job runs."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class AuditTrail:
    """Steps with the observations of their rows; records() waits for those that a job has filled."""

    def __init__(self) -> None:
        self.steps: list[tuple[str, str, Observation, Observation, str]] = []

    def watched(self, df: DataFrame, name: str, *more: Column) -> tuple[DataFrame, Observation]:
        seen = Observation(name)
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *more), seen

    def log(self, step: str, seen_in: Observation, seen_out: Observation, why: str) -> None:
        self.steps.append((datetime.now(timezone.utc).isoformat(), step, seen_in, seen_out, why))

    def records(self) -> list[tuple]:
        out = []
        for when, step, a, b, why in self.steps:
            n, m = a.get["rows"], b.get["rows"]
            out.append((when, step, n, m, m - n, why))
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.records(), "timestamp string, etapa string, linhas_entrada long, linhas_saida long, delta long, justificativa string")
