"""Segment, campaign and channel filters applied before any report."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, functions as F

from almoner.model import Tables
from almoner.operators.lookup import fits_broadcast


def scoped(
    tables: Tables,
    segment: str | None = None,
    campaign: str | None = None,
    channel: str | None = None,
) -> Tables:
    """Tables narrowed to one segment's donors (their gifts, the calls to them),
    one campaign and one channel. Lookup tables stay whole, so a breakdown still
    shows every campaign, channel and segment.

    A table is narrowed when first asked for, so a report pays for what it reads; the
    segment's donors are measured once."""

    @cache
    def names() -> DataFrame:
        chosen = tables.donors.where(F.col("segment_id") == segment).select("name")
        return F.broadcast(chosen) if fits_broadcast(chosen) else chosen

    def narrowed(table: str) -> DataFrame:
        rows = tables[table]
        if table == "donations":
            if campaign is not None:
                rows = rows.where(F.col("campaign_id") == campaign)
            if channel is not None:
                rows = rows.where(F.col("channel_id") == channel)
        if segment is None:
            return rows
        if table == "donors":
            return rows.where(F.col("segment_id") == segment)
        person = {"donations": "donor_name", "calls": "contact"}.get(table)
        if person is None:
            return rows
        return rows.join(names().withColumnRenamed("name", person), person, "left_semi")

    return Tables(narrowed)
