"""Set-based upserts that give what applying the rows one by one in ``seq`` order
would give. Replaying a batch changes nothing."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from almoner.model import BUCKET_COLUMN, PERIOD_COLUMN, TABLES, Tables
from almoner.operators.ids import assign_ids, largest_id
from almoner.operators.lookup import fits_broadcast, lookup, without
from almoner.operators.periods import on_days_of
from almoner.session import checkpointed

NATURAL_KEY = ("donor_name", "gift_date", "amount", "campaign_id", "channel_id")


class Merge(NamedTuple):
    """``rows`` is the new table (or the rows to add), ``changed`` what of it differs
    from the old one; ``checked`` is the batch, staged, with the ``reason`` for which a row is rejected."""

    rows: DataFrame
    changed: DataFrame
    checked: DataFrame

    @property
    def rejected(self) -> DataFrame:
        return self.checked.where(F.col("reason").isNotNull())

    @property
    def accepted(self) -> DataFrame:
        return self.checked.where(F.col("reason").isNull()).drop("reason")


def _broken_rule(table: str, skip: tuple[str, ...] = ()) -> str:
    """SQL text: the first NOT NULL or length rule a row breaks, else NULL."""
    spec = TABLES[table]
    rules = [f"WHEN {c} IS NULL THEN '{c} missing'" for c in spec.required if c not in skip]
    rules += [f"WHEN length({c}) > {n} THEN '{c} too long'" for c, n in spec.lengths.items()]
    return f"CASE {' '.join(rules)} END"


def _with_reason(
    rows: DataFrame, table: str, parents: Tables, skip: tuple[str, ...] = ()
) -> DataFrame:
    """``rows`` plus ``reason``: the broken rule or the parent that is missing."""
    columns = rows.columns
    reasons = [_broken_rule(table, skip)]
    for column, parent in TABLES[table].references.items():
        found = f"_known_{column}"
        known = parents[parent].selectExpr(f"{TABLES[parent].key} AS {column}", f"true AS {found}")
        rows = lookup(rows, known, column, "left")
        reasons.append(f"CASE WHEN {found} IS NULL THEN '{column} unknown' END")
    return rows.selectExpr(*columns, f"coalesce({', '.join(reasons)}) AS reason")


def curable() -> Column:
    """True for rows whose missing parent may still come; other faults stay."""
    return F.col("reason").endswith(" unknown")


def first_per_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row with the lowest seq of each key; copies collapse before the shuffle."""
    others = [c for c in rows.columns if c not in keys and c != "seq"]
    # seq stands alone, so that the plan leaves it out where nobody asks for it.
    first = [F.min_by(F.struct(*others), "seq").alias("first")] if others else []
    found = rows.groupBy(*keys).agg(F.min("seq").alias("seq"), *first)
    return found.select(*keys, "seq", *(["first.*"] if others else [])).select(*rows.columns)


def upsert_donors(tables: Tables, batch: DataFrame, bucket: Callable[[Column], Column] | None = None) -> Merge:
    """The donors after the batch: on a known name segment and lifecycle are taken
    from the last row, max_gift is the largest seen and first_gift stays.

    With ``bucket`` (a stored table's bucket of a name) only buckets that a batch's name falls into are read, and
    ``rows`` holds those only. Rows with an unknown segment or a broken rule are rejected. Runs jobs.
    """
    target = tables.donors
    checked = checkpointed(_with_reason(batch, "donors", tables))
    accepted = checked.where(F.col("reason").isNull()).drop("reason")
    last, first = "max_by({0}, seq) AS new_{0}", "min_by({0}, seq) AS new_{0}"
    incoming = accepted.groupBy("name").agg(
        F.expr(last.format("segment_id")),
        F.expr("max(max_gift) AS new_max_gift"),
        F.expr(first.format("first_gift")),
        F.expr(last.format("lifecycle")),
    )
    if bucket is not None and BUCKET_COLUMN in target.columns:
        # At most as many as there are buckets.
        touched = [r[0] for r in accepted.select(bucket(F.col("name"))).distinct().collect()]
        target = target.where(F.col(BUCKET_COLUMN).isin(touched))
    target = target.select(*TABLES["donors"].schema.names)
    if fits_broadcast(accepted.select("name", "segment_id", "first_gift", "lifecycle")):
        # The target is scanned twice but not shuffled.
        names = target.select("name").join(F.broadcast(incoming.select("name")), "name", "left_semi")
        added = incoming.join(F.broadcast(names), "name", "left_anti")
        merged = target.join(F.broadcast(incoming), "name", "left").unionByName(
            added, allowMissingColumns=True
        )
    else:
        merged = target.join(incoming, "name", "full_outer")
    result = (
        "name",
        "coalesce(new_segment_id, segment_id) AS segment_id",
        "greatest(max_gift, new_max_gift) AS max_gift",
        "coalesce(first_gift, new_first_gift) AS first_gift",
        "coalesce(new_lifecycle, lifecycle) AS lifecycle",
    )
    changed = merged.where(
        "new_segment_id <> segment_id OR new_lifecycle <> lifecycle OR new_max_gift > max_gift"
        " OR segment_id IS NULL"
    )
    return Merge(merged.selectExpr(*result), changed.selectExpr(*result), checked)


def insert_new_donations(
    tables: Tables,
    batch: DataFrame,
    key: tuple[str, ...] = NATURAL_KEY,
    last_id: int | None = None,
) -> Merge:
    """The gifts of the batch to append, with ids: those whose key is neither in the
    donations nor earlier in the batch. The status is not part of the key.

    Amounts become whole before keys are compared. With ``key=('source_ref',)`` the
    donations must carry that column; it then keeps real repeated gifts apart.
    ``last_id`` spares the scan for the largest id. Rows with an unknown donor, campaign or
    channel are rejected, with the amount that came in. Runs jobs.
    """
    keys = list(key)
    target = tables.donations
    whole = batch.withColumns({"_given": F.col("amount"), "amount": F.round("amount").try_cast("int")})
    # Ids come last, so they cannot be missing yet.
    checked = checkpointed(_with_reason(whole, "donations", tables, skip=("id",)))
    accepted = checked.where(F.col("reason").isNull()).drop("reason", "_given")
    fresh = first_per_key(accepted, keys)
    # Months can be left out only where gifts are stored by month.
    by_month = "gift_date" in keys and PERIOD_COLUMN in target.columns
    existing = on_days_of(target, accepted, "gift_date") if by_month else target
    stored = [c for c in TABLES["donations"].schema.names if c != "id"]
    extra = ["source_ref"] if "source_ref" in target.columns else []
    new = without(fresh, existing, keys, wanted=accepted).select(*stored, *extra)
    rows = assign_ids(new, largest_id(target) if last_id is None else last_id)
    given = F.when(F.col("reason").isNull(), F.col("amount")).otherwise(F.col("_given"))
    return Merge(rows, rows, checked.withColumn("amount", given).drop("_given"))


def insert_ignore(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` plus the rows of ``batch`` (which has ``seq``) with a new key: rows
    already there win, then the first of the batch. Runs jobs."""
    batch = checkpointed(batch)
    added = without(first_per_key(batch, keys), target, keys, wanted=batch)
    return target.unionByName(added.select(*target.columns))
