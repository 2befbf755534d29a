"""Filters on gift and call time that prune month folders when there are any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from almoner.model import PERIOD_COLUMN


def since(df: DataFrame, time_column: str, day: Column) -> DataFrame:
    """Rows at or after ``day`` (a date)."""
    rows = df.where(F.col(time_column) >= day)
    if PERIOD_COLUMN in df.columns:
        rows = rows.where(F.col(PERIOD_COLUMN) >= F.trunc(day, "month"))
    return rows


def on_days_of(df: DataFrame, batch: DataFrame, day_column: str) -> DataFrame:
    """Rows of ``df`` that may share a day with ``batch``: between its first and last
    day and, in month folders, in its months only, so that one very old row does not
    open all folders in between. Runs a job over ``batch``."""
    first, last, months = batch.agg(
        F.min(day_column), F.max(day_column), F.collect_set(F.trunc(day_column, "month"))
    ).first()
    rows = df.where(F.col(day_column).between(F.lit(first), F.lit(last)))
    if PERIOD_COLUMN in df.columns:
        rows = rows.where(F.col(PERIOD_COLUMN).isin(months))
    return rows


def newest_months(df: DataFrame, n: int) -> DataFrame:
    """The newest month folders that hold ``n`` rows together, else all rows. Runs a job
    that counts rows per month; without month folders there is nothing to do."""
    if PERIOD_COLUMN not in df.columns:
        return df
    counted = df.groupBy(PERIOD_COLUMN).agg(F.expr("count(1) AS held"))
    # One row per month.
    running = counted.selectExpr(
        PERIOD_COLUMN, f"sum(held) OVER (ORDER BY {PERIOD_COLUMN} DESC) AS total"
    )
    month = running.where(F.col("total") >= n).agg(F.max(PERIOD_COLUMN)).first()[0]
    return df if month is None else df.where(F.col(PERIOD_COLUMN) >= F.lit(month))
