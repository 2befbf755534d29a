"""Reports over donors. All of them start from completed gifts per donor."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, functions as F

from almoner.functions.exact import mean_or_zero
from almoner.functions.order import sorted_few
from almoner.model import Tables
from almoner.operators.lookup import lookup
from almoner.plans.donations import check_limit, completed

LAPSED = "lapsed"
TOP_DONORS = 10


def gifts_by_donor(tables: Tables) -> DataFrame:
    """name, total, gifts of donors with a completed gift.

    The sums are built before the shuffle, so a donor that holds a third of all
    gifts reaches its task as one row per input partition.
    """
    if tables.by_donor is not None:
        return tables.by_donor
    return (
        completed(tables)
        .groupBy(F.expr("donor_name AS name"))
        .agg(F.expr("coalesce(sum(amount), 0) AS total"), F.expr("count(1) AS gifts"))
    )


@contextmanager
def shared(tables: Tables) -> Iterator[Tables]:
    """Keeps the sums per donor while several reports use them."""
    by_donor = gifts_by_donor(tables).persist()
    try:
        yield tables.sharing(by_donor)
    finally:
        by_donor.unpersist()


def _with_label(tables: Tables, donors: DataFrame) -> DataFrame:
    """Donors with their segment's label; donors of an unknown segment are left out."""
    labels = tables.segments.selectExpr("id AS segment_id", "label AS segment_label")
    return lookup(donors, labels, "segment_id")


def donor_segments(tables: Tables) -> DataFrame:
    """Every segment: donors that gave, what they gave and the mean gift."""
    givers = tables.donors.select("name", "segment_id").join(gifts_by_donor(tables), "name")
    per_segment = givers.groupBy(F.expr("segment_id AS id")).agg(
        F.expr("count(1) AS donors"), F.expr("sum(total) AS total"), F.expr("sum(gifts) AS gifts")
    )
    return (
        tables.segments.join(per_segment, "id", "left")
        .select(
            F.expr("id AS segment_id"),
            "label",
            "color",
            F.expr("coalesce(donors, 0) AS donors"),
            F.expr("coalesce(total, 0) AS total_raised"),
            mean_or_zero("total", "gifts").alias("avg_gift"),
        )
        .orderBy(F.desc("total_raised"), "segment_id")
    )


def donor_lifecycle(tables: Tables) -> DataFrame:
    counts = tables.donors.groupBy("lifecycle").agg(F.expr("count(1) AS count"))
    return sorted_few(counts, F.desc("count"), "lifecycle")


def donor_roster(tables: Tables) -> DataFrame:
    """Donors with at least one completed gift, largest total first."""
    donors = tables.donors.select("name", "segment_id", "first_gift", "lifecycle")
    return (
        _with_label(tables, donors)
        .join(gifts_by_donor(tables), "name")
        .select(
            "name",
            "segment_id",
            "segment_label",
            "first_gift",
            "lifecycle",
            "gifts",
            "total",
            mean_or_zero("total", "gifts").alias("avg_gift"),
        )
        .orderBy(F.desc("total"), "name")
    )


def at_risk_donors(tables: Tables) -> DataFrame:
    """Lapsed donors by lifetime value, those without gifts included."""
    lapsed = tables.donors.where(F.col("lifecycle") == LAPSED)
    return (
        _with_label(tables, lapsed.select("name", "segment_id", "first_gift"))
        .join(gifts_by_donor(tables), "name", "left")
        .selectExpr(
            "name",
            "segment_label",
            "first_gift",
            "coalesce(total, 0) AS lifetime_value",
            "coalesce(gifts, 0) AS gift_count",
        )
        .orderBy(F.desc("lifetime_value"), "name")
    )


def lapsed_by_segment_id(tables: Tables) -> DataFrame:
    """As the at-risk list, with the segment's id and no look at the segments."""
    return (
        tables.donors.where(F.col("lifecycle") == LAPSED)
        .join(gifts_by_donor(tables), "name", "left")
        .selectExpr(
            "name",
            "segment_id",
            "first_gift",
            "lifecycle",
            "coalesce(total, 0) AS lifetime_value",
        )
        .orderBy(F.desc("lifetime_value"), "name")
    )


def top_donors(tables: Tables, limit: int = TOP_DONORS) -> DataFrame:
    return (
        gifts_by_donor(tables)
        .selectExpr("name AS donor_name", "total", "gifts")
        .orderBy(F.desc("total"), "donor_name")
        .limit(check_limit(limit))
    )
