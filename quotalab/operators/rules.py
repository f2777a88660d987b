"""Declared constraints of a table: what breaks them is counted, and the rows that do are set apart."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.shared import checkpointed


@dataclass(frozen=True)
class Check:
    """Each row by itself: broken says which rows break it; null counts as unbroken."""

    name: str
    broken: Column


@dataclass(frozen=True)
class Unique:
    """No two rows have one key; rows with a null in the key are left out."""

    name: str
    key: tuple[str, ...]


@dataclass(frozen=True)
class Depends:
    """All rows with one key have one value in column; nulls in key or column are left out."""

    name: str
    key: tuple[str, ...]
    column: str


Rule = Check | Unique | Depends


def _groups(rows: DataFrame, rule: Unique | Depends, n: Column | None = None) -> DataFrame:
    """(key, n__): the groups that break a rule, with their rows. Counted before anything is shuffled.

    n says for how many rows a row stands.
    """
    some = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in rule.key))
    total = F.count("*") if n is None else F.sum(n)
    if isinstance(rule, Unique):
        return rows.where(some).groupBy(*rule.key).agg(total.alias("n__")).where("n__ > 1")
    some &= F.col(rule.column).isNotNull()
    # values are grouped and counted, not compared as least and greatest: for those of strings Spark sorts all rows
    values = rows.where(some).groupBy(*rule.key, F.col(rule.column).alias("value__")).agg(total.alias("n__"))
    return values.groupBy(*rule.key).agg(F.count("*").alias("values__"), F.sum("n__").alias("n__")).where("values__ > 1").drop("values__")


def cells(rows: DataFrame, rules: list[Rule], *others: str, total: str | None = None) -> DataFrame:
    """rows put together that no rule tells apart, written once: the columns of the rules on groups and the others,
    quebras__ (for each Check whether it is broken), n__ rows, and their total__ of a column.

    All rules are judged from these, so that a table that is costly to make is made once.
    """
    columns = dict.fromkeys(others)
    for rule in (r for r in rules if not isinstance(r, Check)):
        columns |= dict.fromkeys((*rule.key, *((rule.column,) if isinstance(rule, Depends) else ())))
    flags = [F.coalesce(r.broken, F.lit(False)) for r in rules if isinstance(r, Check)]
    marked = rows.withColumn("quebras__", F.array(*flags).cast("array<boolean>"))
    sums = [F.sum(total).alias("total__")] if total else []
    return checkpointed(marked.groupBy(*columns, "quebras__").agg(F.count("*").alias("n__"), *sums))


def judged(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """(regra, n_linhas, n_violacoes, valida): a row for each rule, in their order.

    All rules are counted from the cells of the table. Of an empty table every rule is valid.
    """
    checks = [r for r in rules if isinstance(r, Check)]
    made, zero = cells(rows, rules), F.lit(0).cast("long")
    sums = [F.coalesce(F.sum(F.when(F.get("quebras__", F.lit(k)), F.col("n__"))), zero).alias(f"v{k}") for k in range(len(checks))]
    counts = made.agg(F.coalesce(F.sum("n__"), zero).alias("n_linhas"), *sums)  # one row
    listed = F.array(*(F.struct(F.lit(rules.index(r)).alias("ordem"), F.lit(r.name).alias("regra"), F.col(f"v{k}").alias("n_violacoes")) for k, r in enumerate(checks)))
    out = counts.select("n_linhas", F.explode(listed).alias("r")).select("r.ordem", "r.regra", "n_linhas", "r.n_violacoes") if checks else None
    for rule in (r for r in rules if not isinstance(r, Check)):
        found = _groups(made, rule, F.col("n__")).agg(F.coalesce(F.sum("n__"), zero).alias("n_violacoes"))  # one row
        row = counts.select("n_linhas").crossJoin(found).select(F.lit(rules.index(rule)).alias("ordem"), F.lit(rule.name).alias("regra"), "n_linhas", "n_violacoes")
        out = row if out is None else out.unionByName(row)
    return out.orderBy("ordem").select("regra", "n_linhas", "n_violacoes", (F.col("n_violacoes") == 0).alias("valida"))


def parted(rows: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(rows that break no rule, the others with regras, the names of those that they break). Each row is in one of both."""
    marked = rows.withColumn("regras", F.array(*(F.when(r.broken, F.lit(r.name)) for r in rules if isinstance(r, Check))).cast("array<string>"))
    marked = _with_groups(marked, rules)
    return marked.where(F.size("regras") == 0).drop("regras"), marked.where(F.size("regras") > 0)


def offending(rows: DataFrame, rules: list[Rule], by: str, total: str) -> DataFrame:
    """(by, regra, n, total): of the rows that parted() sets apart how many break which rule, and their sum of total.

    Counted from the cells of the table: its rows are never joined with the groups that break a rule.
    """
    made = cells(rows, rules, by, total=total)
    names = [r.name for r in rules if isinstance(r, Check)]
    marked = _with_groups(made.withColumn("regras", F.array(*(F.when(F.get("quebras__", F.lit(k)), F.lit(n)) for k, n in enumerate(names))).cast("array<string>")), rules, F.col("n__"))
    return marked.select(by, "n__", "total__", F.explode("regras").alias("regra")).groupBy(by, "regra").agg(F.sum("n__").alias("n"), F.sum("total__").alias(total))


def _with_groups(marked: DataFrame, rules: list[Rule], n: Column | None = None) -> DataFrame:
    """marked with the names of the rules on groups that its rows break in regras, too."""
    rows = marked
    for rule in (r for r in rules if not isinstance(r, Check)):
        # the groups that break a rule are joined on their key; most keys are in none
        broken = _groups(rows, rule, n).select(*(F.col(k).alias(f"{k}_") for k in rule.key), F.lit(rule.name).alias("quebra"))
        on = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"{k}_") for k in rule.key))
        hit = F.col("quebra")
        if isinstance(rule, Depends):
            hit = F.when(F.col(rule.column).isNotNull(), hit)
        marked = marked.join(broken, on, "left").withColumn("regras", F.array_append("regras", hit)).drop("quebra", *(f"{k}_" for k in rule.key))
    return marked.withColumn("regras", F.array_compact("regras"))


def order_rules(settings: Settings = Settings()) -> list[Rule]:
    """What the ledger's columns promise: key, domains, and one category for each product."""
    statuses = (*settings.pending, *settings.finished, settings.rejected, "Enviada")
    amounts = [Check(f"{q}_nao_negativa", F.col(q) < 0) for q in ("qtd_solic", "qtd_env", "qtd_rec")]
    return [
        Check("chave_completa", F.col("unidade").isNull() | F.col("produto").isNull() | F.col("data_solic").isNull()),
        Check("status_conhecido", ~F.coalesce(F.col("status").isin(*statuses), F.lit(False))),
        Check("categoria_conhecida", ~F.coalesce(F.col("categoria").rlike("^CATEGORIA_[A-Z]$"), F.lit(False))),
        *amounts,
        Check("envio_ate_solicitado", F.col("qtd_env") > F.col("qtd_solic")),
        Unique("pedido_unico", ("unidade", "produto", "data_solic", "pedido_extra", "status")),
        Depends("uma_categoria_por_produto", ("produto",), "categoria"),
        Depends("um_status_por_dia", ("unidade", "produto", "data_solic"), "status"),
    ]
