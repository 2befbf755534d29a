"""Surrogate ids for new rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from almoner.session import checkpointed


def largest_id(target: DataFrame, column: str = "id") -> int:
    """Runs a scan of one column."""
    return target.agg(F.max(column)).first()[0] or 0


def assign_ids(rows: DataFrame, last_id: int, column: str = "id") -> DataFrame:
    """``rows`` with the ids that follow ``last_id``, without gaps.

    Runs jobs. No sort and no shuffle of the rows: they are checkpointed so that
    their partitions stay as they are, each partition gets an offset from the
    partition sizes (one row per partition), and a row adds its position.
    """
    rows = checkpointed(rows.drop(column))
    numbered = rows.withColumn("_serial", F.monotonically_increasing_id()).select(
        "*",
        F.shiftright("_serial", 33).alias("_part"),
        F.col("_serial").bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos"),
    )
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    return numbered.join(F.broadcast(offsets), "_part").select(
        (F.col("_offset") + F.col("_pos") + (last_id + 1)).alias(column), *rows.columns
    )
