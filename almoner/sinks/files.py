"""Reports and exports as files."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, functions as F

# Fixed column order and header of the two exports.
DONATION_HEADER = {
    "gift_date": "Date",
    "donor_name": "Donor",
    "campaign": "Campaign",
    "channel": "Channel",
    "amount": "Amount",
    "status": "Status",
}
CALL_HEADER = {
    "call_time": "Time",
    "caller_name": "Caller",
    "contact": "Contact",
    "duration_label": "Duration",
    "outcome": "Outcome",
    "pledge": "Pledge",
}


def write_csv(export: DataFrame, header: Mapping[str, str], folder: str) -> None:
    """A folder of CSV parts in export order, each with the header. Values that hold
    a comma or a quote are quoted and quotes doubled."""
    columns = [F.col(c).alias(title) for c, title in header.items()]
    export.select(*columns).write.mode("overwrite").csv(folder, header=True, escape='"')


def publish(
    reports: Mapping[str, DataFrame],
    folder: str,
    fmt: str = "parquet",
    computed_at: datetime | None = None,
) -> None:
    """Each report as a table of its own, with the time of the run."""
    stamp = computed_at or datetime.now(timezone.utc)
    for name, report in reports.items():
        stamped = report.withColumn("computed_at", F.lit(stamp))
        stamped.write.mode("overwrite").format(fmt).save(f"{folder}/{name}")
