"""Rounding on whole numbers: the same digits in every engine and row order.

All functions take SQL texts of whole-number expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _whole(numerator: str, denominator: str) -> str:
    """numerator / denominator to the nearest whole number, halves away from zero.

    NULL when either side is NULL; a zero denominator is an error (ANSI mode).
    """
    size, by = f"abs({numerator})", f"abs({denominator})"
    quotient = f"((2 * {size} + {by}) div (2 * {by}))"
    opposed = f"({numerator} < 0) <> ({denominator} < 0)"
    return f"CASE WHEN {opposed} THEN -{quotient} ELSE {quotient} END"


def percent(part: str, total: str) -> Column:
    """100 * part / total with one digit after the point, as a double.

    Decimals hold 2000 * part for every bigint; used on aggregated rows only. A total
    of zero is an error.
    """
    tenths = _whole(f"1000 * CAST({part} AS DECIMAL(20, 0))", f"CAST({total} AS DECIMAL(20, 0))")
    return F.expr(f"CAST({tenths} AS DOUBLE) / 10")


def percent_or_null(part: str, total: str) -> Column:
    return percent(part, f"nullif({total}, 0)")


def mean(total: str, n: str) -> Column:
    """total / n as a whole number, NULL when there is nothing to average."""
    return F.expr(_whole(total, f"nullif({n}, 0)"))


def mean_or_zero(total: str, n: str) -> Column:
    return F.coalesce(mean(total, n), F.lit(0).cast("bigint"))
