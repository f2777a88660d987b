"""spark-submit entry: the allocation run, and with --ml the forecast run after it."""

from __future__ import annotations

import argparse
import io
import logging
import sys
from dataclasses import asdict

from pyspark.sql import SparkSession

from .config import SEED, Settings
from .operators.history import HISTORY
from .plans.allocation import run_allocation
from .plans.forecast import run_forecast
from .shipping import ship
from .sources.ledger import write_csv
from .sources.snapshots import write_text


def handlers_of(text: io.StringIO) -> list[logging.Handler]:
    """The console, and the text that becomes the run's log file."""
    handlers = [logging.StreamHandler(text), logging.StreamHandler(sys.stdout)]
    log = logging.getLogger("quotalab")
    log.setLevel(logging.INFO)
    for handler in handlers:
        handler.setFormatter(logging.Formatter("%(asctime)s | %(levelname)s | %(message)s"))
        log.addHandler(handler)
    return handlers


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--anonimizar", action="store_true")
    parser.add_argument("--ml", action="store_true")
    parser.add_argument("--data-dir")
    given = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    text = io.StringIO()
    log, handlers = logging.getLogger("quotalab"), handlers_of(text)
    try:
        log.info("Início: seed %d, %s", SEED, asdict(Settings()))
        made = run_allocation(spark, given.input, given.output, anonymous=given.anonimizar)
        if given.ml:
            learnt = run_forecast(spark, made.painel, made.metricas, made.dominancia, given.data_dir or f"{given.output}/data")
            write_csv(learnt.previsoes.orderBy("unidade", "produto"), f"{given.output}/05_previsoes")
            if learnt.backtest is not None:  # without a tested month there is no such table
                write_csv(learnt.backtest.orderBy("modelo", "fold", "unidade", "produto"), f"{given.output}/06_backtest_walkforward")
            write_csv(learnt.dominancia_ml.orderBy("unidade", "produto"), f"{given.output}/04_dominancia_ml")
            write_csv(learnt.historico.select(*HISTORY).orderBy("unidade", "produto", "mes"), f"{given.output}/historico_mensal")
        log.info("Fim")
    finally:
        for handler in handlers:
            log.removeHandler(handler)
            handler.flush()
        write_text(spark, f"{given.output}/pipeline.log", text.getvalue())


if __name__ == "__main__":
    main()
