"""Layers 1 to 4 as one lazy plan over the ledger, and the run that writes them."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import dominance, orders, panel, policy
from ..sources.ledger import read_ledger, write_csv, write_json
from .audit import AuditTrail

log = logging.getLogger("quotalab")


@dataclass
class Allocation:
    """The tables of layers 1 to 4."""

    consolidado: DataFrame
    painel: DataFrame
    metricas: DataFrame
    politicas: DataFrame
    dominancia: DataFrame


def allocation(ledger: DataFrame, settings: Settings = Settings(), mode: str = "reference") -> Allocation:
    """All layers from normalised orders; nothing runs until a table is used."""
    return layers(orders.consolidated(orders.flagged(ledger, settings), settings), settings, mode)


def layers(rows: DataFrame, settings: Settings = Settings(), mode: str = "reference") -> Allocation:
    """Layers 2 to 4 from consolidated orders."""
    months = panel.balanced(panel.monthly(rows), settings.months)
    return after_panel(Allocation(rows, months, months, months, months), settings, mode)


def after_panel(made: Allocation, settings: Settings = Settings(), mode: str = "reference") -> Allocation:
    """Metrics, quotas and dominance from the panel of made."""
    measured = panel.metrics(made.painel, settings.months, settings)
    quotas = policy.policies(measured, settings)
    costs = dominance.dominated(dominance.expected(dominance.costs(made.painel, quotas, settings)), settings, mode)
    names = {"q_atual": "cota_atual", "q_conservadora": "cota_conservadora", "q_buffer": "cota_buffer", "custo_esp_conservadora": "custo_esp_conserv"}
    return Allocation(made.consolidado, made.painel, measured.drop("proj_ponderada"), quotas, costs.drop("s", "c_atual", "c_conservadora", "c_buffer").withColumnsRenamed(names))


def run_allocation(spark: SparkSession, source: str, target: str, settings: Settings = Settings(), anonymous: bool = False) -> Allocation:
    """Read a ledger and write its tables under target, with the audit trail and, if asked, the alias map.

    The consolidated ledger, as large as the input, is written in parallel, as Parquet and as CSV parts; the tables of
    pairs are sorted CSV parts. Rows are counted, and the log's figures taken, while these jobs run.
    """
    trail = AuditTrail()
    log.info("Camada 1: %s", source)
    raw, read = trail.watched(read_ledger(spark, source), "lidas", F.min("data_solic").alias("de"), F.max("data_solic").alias("ate"))
    ledger = orders.normalised(raw)
    if anonymous:
        aliases = orders.unit_aliases(ledger).collect()  # as many rows as units
        write_json(spark, {r["unidade"]: r["alias"] for r in aliases}, f"{target}/mapa_unidades.json")
        ledger = orders.anonymised(ledger)
        log.info("%d unidades anonimizadas", len(aliases))
    made = allocation(ledger, settings)
    flags = ("flag_env_maior_solic", "flag_rec_maior_env", "flag_fin_sem_rec", "flag_qualquer_erro")
    made.consolidado, kept = trail.watched(made.consolidado, "consolidadas", F.sum("qtd_consumo").alias("consumo"), *(F.count_if(f).alias(f) for f in flags))
    made.consolidado.write.mode("overwrite").parquet(f"{target}/01_dataset_consolidado.parquet")
    rows = spark.read.parquet(f"{target}/01_dataset_consolidado.parquet")  # later layers start from the file
    rows.write.mode("overwrite").option("header", True).csv(f"{target}/01_dataset_consolidado")
    trail.log("1.1_carga_e_normalizacao", read, kept, "leitura, normalização, flags de qualidade e consumo consolidado")
    values = rows.agg(F.countDistinct("unidade"), F.countDistinct("produto")).first()
    log.info("%d linhas, %d unidades, %d produtos, de %s a %s", read.get["rows"], *values, read.get["de"], read.get["ate"])
    log.info("erros: %s; consumo total %.0f", {f[5:]: kept.get[f] for f in flags}, kept.get["consumo"] or 0)
    made = layers(rows, settings)
    made.painel, months = trail.watched(made.painel, "painel")
    made.painel.persist(StorageLevel.MEMORY_AND_DISK)
    made.painel.count()
    trail.log("2.1_agregacao_mensal", kept, months, "pivô mensal e painel balanceado")
    made = after_panel(made, settings)
    before = months
    for name, table, step, why in (
        ("02_metricas_por_par", "metricas", "2.2_metricas_por_par", "métricas e tipologia XYZ"), ("03_politicas_cota", "politicas", "3_politica_cota", "média ponderada e buffer"),
        ("04_dominancia", "dominancia", "4_dominancia_estocastica", "pares materiais, custos esperados e dominância"),
    ):
        # counted behind the sort, which samples what comes before it
        watched, seen = trail.watched(getattr(made, table).orderBy(*panel.PAIR), table)
        write_csv(watched, f"{target}/{name}")
        trail.log(step, before, seen, why)
        before = seen
    for label, counts in (("XYZ", panel.counts_by(made.metricas, "classe_xyz")), ("ações", panel.counts_by(made.politicas, "acao_sugerida")), ("preferidas", panel.counts_by(made.dominancia, "politica_preferida"))):
        log.info("%s: %s", label, {r[0]: r[1] for r in counts.collect()})  # as many rows as classes
    write_csv(trail.frame(spark).coalesce(1), f"{target}/log_auditoria")  # a row for each step
    return made
