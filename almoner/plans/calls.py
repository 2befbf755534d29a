"""Reports over call-center calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from almoner.functions.exact import mean, percent_or_null
from almoner.functions.labels import minutes_seconds, month_name
from almoner.functions.order import sorted_few
from almoner.model import Tables
from almoner.operators.periods import newest_months
from almoner.plans.donations import DEFAULT_LIMIT, check_limit

PLACED = "count(1)"
CONNECTED = "count_if(outcome = 'answered')"
PLEDGED = "count_if(pledge > 0)"


def call_summary(tables: Tables) -> DataFrame:
    """One row; rates and mean are NULL when there is nothing to divide by."""
    talked = "CASE WHEN outcome = 'answered' THEN duration_sec END"
    return tables.calls.agg(
        F.expr(f"{PLACED} AS calls_placed"),
        F.expr(f"{CONNECTED} AS calls_connected"),
        F.expr(f"{PLEDGED} AS pledged_calls"),
        F.expr(f"sum({talked}) AS seconds"),
        F.expr(f"count({talked}) AS timed"),
    ).select(
        "calls_placed",
        "calls_connected",
        percent_or_null("calls_connected", "calls_placed").alias("connect_rate_pct"),
        "pledged_calls",
        percent_or_null("pledged_calls", "calls_connected").alias("pledge_conv_pct"),
        mean("seconds", "timed").alias("avg_duration_sec"),
    )


def call_outcomes(tables: Tables) -> DataFrame:
    # One row per outcome: the unpartitioned window sees a handful of rows.
    shares = (
        tables.calls.groupBy("outcome")
        .agg(F.expr(f"{PLACED} AS count"))
        .selectExpr("*", "sum(count) OVER () AS total")
        .select("outcome", "count", percent_or_null("count", "total").alias("pct"))
    )
    return shares.orderBy(F.desc("count"), "outcome")


def _by_caller(tables: Tables) -> DataFrame:
    return tables.calls.groupBy(F.expr("caller_name AS name")).agg(
        F.expr(f"{PLACED} AS calls_placed"),
        F.expr(f"{CONNECTED} AS connected"),
        F.expr(f"{PLEDGED} AS pledges"),
        F.expr("sum(pledge) AS total_pledged"),
    )


def caller_leaderboard(tables: Tables) -> DataFrame:
    """Every caller; rates are NULL for those without calls."""
    counts = ("calls_placed", "connected", "pledges", "total_pledged")
    return (
        tables.callers.join(_by_caller(tables), "name", "left")
        .selectExpr("name", "role", "tenure", *(f"coalesce({c}, 0) AS {c}" for c in counts))
        .select(
            "*",
            percent_or_null("connected", "calls_placed").alias("connect_rate_pct"),
            percent_or_null("pledges", "connected").alias("conv_rate_pct"),
        )
        .orderBy(F.desc("total_pledged"), "name")
    )


def caller_totals(tables: Tables) -> DataFrame:
    """Callers that have calls, from the calls alone."""
    return (
        _by_caller(tables)
        .withColumnRenamed("name", "caller_name")
        .withColumn("connect_rate_pct", percent_or_null("connected", "calls_placed"))
        .orderBy(F.desc("total_pledged"), "caller_name")
    )


def _listed(calls: DataFrame, time_format: str) -> DataFrame:
    return calls.select(
        F.date_format("call_time", time_format).alias("call_time"),
        "caller_name",
        "contact",
        minutes_seconds("duration_sec").alias("duration_label"),
        "outcome",
        "pledge",
        "note_text",
    )


def call_rows(tables: Tables, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The newest calls. On a stored table a job counts the calls of each month."""
    recent = newest_months(tables.calls, check_limit(limit))
    newest = recent.orderBy(F.desc("call_time"), F.desc("id")).limit(limit)
    return _listed(newest, "dd MMM HH:mm")


def calls_export(tables: Tables) -> DataFrame:
    """All calls, newest first. Sorted on (time, id): a busy minute spans many tasks."""
    return _listed(tables.calls.orderBy(F.desc("call_time"), F.desc("id")), "yyyy-MM-dd HH:mm")


def monthly_calls(tables: Tables) -> DataFrame:
    by_month = tables.calls.groupBy(F.expr("month(call_time) AS month")).agg(
        F.expr(f"{PLACED} AS placed"), F.expr(f"{CONNECTED} AS connected")
    )
    rate = percent_or_null("connected", "placed").alias("connect_rate")
    return sorted_few(
        by_month.select("month", month_name("month"), "placed", "connected", rate), "month"
    )


def hour_heatmap(tables: Tables) -> DataFrame:
    """Hours of the day that have calls."""
    by_hour = tables.calls.groupBy(F.expr("hour(call_time) AS hour")).agg(
        F.expr(f"{PLACED} AS total"), F.expr(f"{CONNECTED} AS connected")
    )
    rate = percent_or_null("connected", "total").alias("connect_rate")
    return sorted_few(by_hour.select("*", rate), "hour")
