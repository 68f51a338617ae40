"""Period labels and calendar helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from coldlake.config import WEEKDAYS


def period_label(date_col: str | Column, period: str = "month") -> Column:
    """'YYYY-MM' for month, 'YYYYQn' for quarter, 'YYYY' for year."""
    d = F.col(date_col) if isinstance(date_col, str) else date_col
    if period == "month":
        return F.date_format(d, "yyyy-MM")
    if period == "quarter":
        return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))
    if period == "year":
        return F.year(d).cast("string")
    raise ValueError(f"unknown period {period!r}")


def week_label(date_col: str | Column) -> Column:
    """Monday-to-Sunday week as 'YYYY-MM-DD/YYYY-MM-DD'."""
    d = F.col(date_col) if isinstance(date_col, str) else date_col
    start = F.to_date(F.date_trunc("week", d))
    return F.concat(F.date_format(start, "yyyy-MM-dd"), F.lit("/"), F.date_format(F.date_add(start, 6), "yyyy-MM-dd"))


def weekday_name(date_col: str | Column) -> Column:
    d = F.col(date_col) if isinstance(date_col, str) else date_col
    return F.date_format(d, "EEEE")


def weekday_position(name_col: str | Column) -> Column:
    """Monday = 1 ... Sunday = 7, for ordering weekday names."""
    c = F.col(name_col) if isinstance(name_col, str) else name_col
    return F.array_position(F.array(*[F.lit(w) for w in WEEKDAYS]), c)


def hash_hour(order_id: str | Column) -> Column:
    """First 8 hex digits of SHA-256(order_id) as an integer, modulo 24."""
    c = F.col(order_id) if isinstance(order_id, str) else order_id
    return (F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("bigint") % F.lit(24)).cast("int")


def minute_label(ts: str | Column) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm")


def hour_label(ts: str | Column) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(c, "yyyy-MM-dd'T'HH")
