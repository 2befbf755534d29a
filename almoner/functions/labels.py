"""Text forms used by the reports, from SQL texts of whole numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def month_name(month: str) -> Column:
    """'Jan' .. 'Dec' of a month number; applied after grouping, not per row."""
    return F.expr(f"date_format(make_date(2000, {month}, 1), 'MMM')").alias("month_name")


def minutes_seconds(seconds: str) -> Column:
    """75 -> '1:15', 4500 -> '75:00'."""
    return F.expr(f"concat({seconds} div 60, ':', lpad({seconds} % 60, 2, '0'))")
