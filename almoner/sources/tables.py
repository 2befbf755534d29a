"""Reading the seven tables from files, a catalog or a database."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from almoner.model import TABLES, Tables, conform

# A wrong value in a text file fails the read: it must not turn into NULL.
_FILE_OPTIONS = {
    "parquet": {},
    "orc": {},
    "json": {"mode": "FAILFAST"},
    "csv": {"mode": "FAILFAST", "header": "true", "enforceSchema": "false"},
}


def load_table(
    spark: SparkSession,
    table: str,
    location: str,
    fmt: str = "parquet",
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """One table.

    ``fmt``: parquet, orc, json or csv (``location`` is a folder with one folder
    per table), table (``location`` is a catalog schema) or jdbc (``location`` is
    the URL). For jdbc, pass lowerBound, upperBound and numPartitions to read the
    tables that have a numeric id in parallel.
    """
    options = dict(options or {})
    if fmt in _FILE_OPTIONS:
        reader = spark.read.schema(TABLES[table].schema)
        return reader.options(**(_FILE_OPTIONS[fmt] | options)).format(fmt).load(f"{location}/{table}")
    if fmt == "table":
        return conform(spark.table(f"{location}.{table}"), table)
    if fmt == "jdbc":
        if "id bigint" in TABLES[table].ddl and "numPartitions" in options:
            options["partitionColumn"] = "id"
        else:
            for bound in ("lowerBound", "upperBound", "numPartitions"):
                options.pop(bound, None)
        reader = spark.read.format("jdbc").options(url=location, dbtable=table, **options)
        return conform(reader.load(), table)
    raise ValueError(f"unknown table format: {fmt}")


def load_tables(
    spark: SparkSession,
    location: str,
    fmt: str = "parquet",
    options: Mapping[str, str] | None = None,
) -> Tables:
    return Tables(lambda table: load_table(spark, table, location, fmt, options))
