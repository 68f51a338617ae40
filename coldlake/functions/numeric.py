"""Numeric column helpers shared by the reports (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_even(c: str | Column, digits: int) -> Column:
    """Round half to even (the reference's ``round``), returned as double."""
    return F.bround(col(c).cast("double"), digits)


def money(c: str | Column, digits: int = 2) -> Column:
    """Decimal money aggregate -> double rounded half-even."""
    return F.bround(col(c), digits).cast("double")


def pct(num: str | Column, den: str | Column) -> Column:
    """100 * num / den; NULL when den is 0."""
    return F.try_divide(F.lit(100.0) * col(num).cast("double"), col(den).cast("double"))


def count_when(cond: Column) -> Column:
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0)))


def truncate_bucket(c: str | Column, width: int) -> Column:
    """CAST(x / width AS INTEGER) * width: truncation toward zero."""
    return (col(c) / F.lit(width)).cast("int") * F.lit(width)


def clamp(c: Column, bound: float) -> Column:
    return F.greatest(F.least(c, F.lit(bound)), F.lit(-bound))


def floor_div(a: Column, b: Column) -> Column:
    """Python float ``a // b`` for a >= 0, b > 0: (a - a % b) / b, rounded to the integer it is.

    ``floor(a / b)`` differs from Python when a / b rounds up to an integer.
    """
    safe_b = F.when(b != 0, b)     # NULL divisor -> NULL result instead of an ANSI error
    return F.round((a - a % safe_b) / safe_b)
