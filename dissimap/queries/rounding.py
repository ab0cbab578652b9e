"""Rounding for comparison with SQL: sums in another order differ in their last bits, so values are shifted off the half-way
decimals before they are rounded; -0.0 becomes 0.0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHIFT = 1.3e-8


def near(c: Column, digits: int = 6) -> Column:
    return F.round(c + F.lit(SHIFT), digits) + F.lit(0.0)


def near_binary(c: Column, digits: int = 6) -> Column:
    """near() without Spark's decimal numbers, as DuckDB rounds: for very many rows."""
    return F.rint((c + F.lit(SHIFT)) * F.lit(10.0**digits)) / F.lit(10.0**digits) + F.lit(0.0)


def near_sql(sql: str, digits: int = 6) -> str:
    return f"(round(({sql}) + CAST({SHIFT} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"
