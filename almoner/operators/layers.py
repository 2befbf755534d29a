"""Replacing the rows from a cut-off day on."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F


def replace_live_layer(
    target: DataFrame, layer: DataFrame, time_column: str, since: date
) -> DataFrame:
    """``target`` before ``since`` as it is, and from then on only ``layer``.

    Every row of ``target`` from that day on goes, wherever it came from. Rows of ``target`` without a
    time stay: they are not known to be that late.
    """
    day = F.lit(since)
    history = target.where((F.col(time_column) < day) | F.col(time_column).isNull())
    return history.unionByName(layer.where(F.col(time_column) >= day).select(*target.columns))
