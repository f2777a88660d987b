"""Text and month functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(x: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def category(x: Column) -> Column:
    """Upper case, Ó as O, trimmed."""
    return trimmed(F.translate(F.upper(x), "Ó", "O"))


def yes_no(x: Column) -> Column:
    """Sim and Não as a boolean; anything else is null."""
    return F.when(x == "Sim", True).when(x == "Não", False)


def month(x: Column) -> Column:
    return F.date_format(x, "yyyy-MM")


def next_month(x: Column) -> Column:
    return F.date_format(F.add_months(F.to_date(x, "yyyy-MM"), 1), "yyyy-MM")
