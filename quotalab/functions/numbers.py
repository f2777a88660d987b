"""Rounding and safe arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(x: Column, places: int = 0) -> Column:
    """Scaled rounding, halves to even: 1.015 to 1.01 at two places, unlike round() and bround()."""
    return F.rint(x * float(10**places)) / float(10**places) if places else F.rint(x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null unless b is above 0."""
    return F.when(b > 0, a / b)


def number(x: Column) -> Column:
    """A number; what is none, or not a number, is 0."""
    value = x.try_cast("double")
    return F.when(value.isNull() | F.isnan(value), 0.0).otherwise(value)


def or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def first_match(default: object, *cases: tuple[Column, object]) -> Column:
    """The value of the first true case; without cases the default."""
    out = None
    for test, value in cases:
        out = F.when(test, value) if out is None else out.when(test, value)
    return F.lit(default) if out is None else out.otherwise(default)
