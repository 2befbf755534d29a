"""Reports over gifts."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from almoner.functions.exact import mean, mean_or_zero, percent, percent_or_null
from almoner.functions.labels import month_name
from almoner.functions.order import sorted_few
from almoner.model import Tables
from almoner.operators import lookup as joins
from almoner.operators.periods import since

# Fixed values of the reports.
COMPLETED = "completed"
RECURRING = "recurring"
DEFAULT_LIMIT = 100
TREND_DAYS = 30
PLEDGE_FACTOR = Decimal("0.22")


def completed(tables: Tables) -> DataFrame:
    return tables.donations.where(F.col("status") == COMPLETED)


def check_limit(limit: int) -> int:
    if limit < 0:
        raise ValueError(f"limit must not be negative: {limit}")
    return limit


def _raised(name: str) -> Column:
    return F.expr("coalesce(sum(amount), 0)").alias(name)


def _gifts() -> Column:
    return F.expr("count(1)").alias("gifts")


def overview(tables: Tables) -> DataFrame:
    """One row of headline numbers. Pledges count on calls of any outcome."""
    gifts = completed(tables).agg(
        _raised("total_raised"), F.count_distinct("donor_name").alias("donor_count")
    )
    calls = tables.calls.agg(
        F.expr("count(1) AS calls_placed"),
        F.expr("count_if(pledge > 0) AS pledged"),
        F.expr("count_if(outcome = 'answered') AS answered"),
    )
    # Two one-row aggregates laid side by side: each column is set in one of them.
    both = gifts.unionByName(calls, allowMissingColumns=True)
    row = both.agg(*(F.expr(f"max({c}) AS {c}") for c in both.columns))
    conversion = F.coalesce(percent_or_null("pledged", "answered"), F.lit(0.0))
    return row.select(
        "total_raised", "donor_count", "calls_placed", conversion.alias("pledge_conversion_pct")
    )


def donation_summary(tables: Tables) -> DataFrame:
    return (
        completed(tables)
        .agg(
            _raised("total_raised"),
            F.expr("count(1) AS total_gifts"),
            F.count_distinct("donor_name").alias("unique_donors"),
        )
        .withColumn("avg_gift_size", mean_or_zero("total_raised", "total_gifts"))
    )


def raised_totals(tables: Tables) -> DataFrame:
    """Sum, donors and mean of completed gifts; NULL, not 0, without gifts."""
    return (
        completed(tables)
        .agg(
            F.expr("sum(amount) AS total_raised"),
            F.count_distinct("donor_name").alias("active_donors"),
            _gifts(),
        )
        .select("total_raised", "active_donors", mean("total_raised", "gifts").alias("avg_gift"))
    )


def monthly_donations(tables: Tables) -> DataFrame:
    """By calendar month; the same month of several years is one row."""
    by_month = (
        completed(tables).groupBy(F.expr("month(gift_date) AS month")).agg(_raised("revenue"), _gifts())
    )
    return sorted_few(by_month.select("month", month_name("month"), "revenue", "gifts"), "month")


def monthly_trend(
    tables: Tables, recurring: str = RECURRING, pledge_factor: Decimal = PLEDGE_FACTOR
) -> DataFrame:
    """One-time against recurring givers by calendar month, plus a pledge estimate.

    Gifts are summed per donor into twelve months at once before they meet the donors, so the one shuffle of gifts is by
    donor, a donor with very many gifts is one row per task in it, and the join needs no other.
    """
    months = [*range(1, 13), None]
    of = {m: "gift_date IS NULL" if m is None else f"month(gift_date) = {m}" for m in months}
    per_donor = (
        completed(tables)
        .groupBy("donor_name")
        # NULL for a month without gifts.
        .agg(*(F.expr(f"sum(CASE WHEN {of[m]} THEN coalesce(amount, 0) END) AS raised_{m}") for m in months))
    )
    givers = tables.donors.select(
        F.col("name").alias("donor_name"), (F.col("segment_id") == recurring).alias("recurs")
    )
    sums = []
    for m in months:
        sums += [
            f"sum(CASE WHEN NOT recurs THEN raised_{m} END) AS one_time_{m}",
            f"sum(CASE WHEN recurs THEN raised_{m} END) AS recurring_{m}",
            f"sum(raised_{m}) AS total_{m}",
        ]
    row = per_donor.join(givers, "donor_name").agg(*map(F.expr, sums))
    listed = ", ".join(f"{m or 'CAST(NULL AS INT)'}, one_time_{m}, recurring_{m}, total_{m}" for m in months)
    by_month = row.selectExpr(
        f"stack({len(months)}, {listed}) AS (month, one_time, recurring, total)"
    ).where("total IS NOT NULL")
    pledges = (F.col("total") * F.lit(pledge_factor)).cast("decimal(28,2)").cast("double")
    return sorted_few(
        by_month.select(
            "month",
            month_name("month"),
            F.expr("coalesce(one_time, 0) AS one_time"),
            F.expr("coalesce(recurring, 0) AS recurring"),
            pledges.alias("pledges"),
        ),
        "month",
    )


def daily_trend(tables: Tables, as_of: date | None = None, days: int = TREND_DAYS) -> DataFrame:
    """Days with completed gifts from ``days`` before ``as_of`` on, later days too."""
    today = F.current_date() if as_of is None else F.lit(as_of)
    recent = since(completed(tables), "gift_date", F.date_sub(today, days))
    by_day = recent.groupBy(F.expr("gift_date AS date")).agg(_raised("revenue"), _gifts())
    return sorted_few(by_day, "date")


def _raised_by(tables: Tables, key: str) -> DataFrame:
    return (
        completed(tables)
        .groupBy(F.col(key).alias("id"))
        .agg(F.expr("sum(amount) AS raised"), _gifts())
    )


def campaign_breakdown(tables: Tables) -> DataFrame:
    """Every campaign against its goal. A goal of 0 is an error."""
    return (
        tables.campaigns.join(_raised_by(tables, "campaign_id"), "id", "left")
        .selectExpr("id AS campaign_id", "label", "color", "goal", "coalesce(raised, 0) AS raised")
        .withColumn("pct_of_goal", percent("raised", "goal"))
        .orderBy(F.desc("raised"), "campaign_id")
    )


def campaign_vs_goal(tables: Tables) -> DataFrame:
    """As the breakdown, without campaigns that have no completed gift."""
    return (
        tables.campaigns.join(_raised_by(tables, "campaign_id"), "id")
        .selectExpr("id AS campaign_id", "label", "goal", "raised")
        .withColumn("pct_of_goal", percent("raised", "goal"))
        .orderBy(F.desc("raised"), "campaign_id")
    )


def channel_breakdown(tables: Tables) -> DataFrame:
    """Every channel with its share of all revenue, NULL when there is none."""
    # One row per channel: the unpartitioned window sees a handful of rows.
    return (
        tables.channels.join(_raised_by(tables, "channel_id"), "id", "left")
        .selectExpr(
            "id AS channel_id",
            "label",
            "color",
            "coalesce(raised, 0) AS revenue",
            "coalesce(gifts, 0) AS gifts",
            "sum(raised) OVER () AS total",
        )
        .withColumn("pct_of_total", percent_or_null("revenue", "total"))
        .drop("total")
        .orderBy(F.desc("revenue"), "channel_id")
    )


def channel_totals(tables: Tables) -> DataFrame:
    """Channels that have gifts, from the gifts alone."""
    return (
        _raised_by(tables, "channel_id")
        .selectExpr("id AS channel_id", "raised AS revenue", "gifts")
        .orderBy(F.desc("revenue"), "channel_id")
    )


def _labelled(tables: Tables, gifts: DataFrame) -> DataFrame:
    """Gifts with campaign and channel labels; gifts without either are left out."""
    campaigns = tables.campaigns.selectExpr("id AS campaign_id", "label AS campaign")
    channels = tables.channels.selectExpr("id AS channel_id", "label AS channel")
    return joins.lookup(joins.lookup(gifts, campaigns, "campaign_id"), channels, "channel_id")


def donation_rows(tables: Tables, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The newest gifts of any status that have a donor, a campaign and a channel.

    One plan, and no job while it is made: gifts get their short labels and are kept if their donor is known, each task keeps its
    newest ``limit`` rows, and only the newest of all are joined to the donors for what is shown of them. Spark broadcasts what
    its size allows.
    """
    newest = [F.desc("gift_date"), F.desc("id")]
    givers = tables.donors.selectExpr("name AS donor_name", "segment_id")
    gifts = (
        tables.donations.join(tables.campaigns.selectExpr("id AS campaign_id", "label AS campaign"), "campaign_id")
        .join(tables.channels.selectExpr("id AS channel_id", "label AS channel"), "channel_id")
        .join(givers.select("donor_name"), "donor_name", "left_semi")
    )
    shown = gifts.orderBy(*newest).limit(check_limit(limit)).join(givers, "donor_name")
    return shown.orderBy(*newest).select(
        F.date_format("gift_date", "dd MMM").alias("gift_date"),
        "donor_name",
        "segment_id",
        "campaign",
        "channel",
        "amount",
        "status",
    )


def donations_export(tables: Tables) -> DataFrame:
    """All gifts, newest first. Sorted on (date, id): a busy day spans many tasks."""
    return (
        _labelled(tables, tables.donations)
        .orderBy(F.desc("gift_date"), F.desc("id"))
        .select(
            F.date_format("gift_date", "yyyy-MM-dd").alias("gift_date"),
            "donor_name",
            "campaign",
            "channel",
            "amount",
            "status",
        )
    )
