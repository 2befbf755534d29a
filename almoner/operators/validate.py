"""Checks a database would enforce: keys, required values, lengths, references and
value domains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from almoner.model import TABLES, Tables, TableSpec

# Marks the entry of a row that holds the names of the row rules it breaks.
_ROW_RULES = "row rules"


def _row_rules(spec: TableSpec) -> dict[str, str]:
    """All rules that look at one row, as SQL that is true where they are broken."""
    rules = {f"{c} missing": f"{c} IS NULL" for c in spec.required}
    rules |= {f"{c} too long": f"length({c}) > {n}" for c, n in spec.lengths.items()}
    return rules | {f"{c} not allowed": f"{c} NOT IN {values}" for c, values in spec.domains.items()}


def _uses() -> dict[str, list[tuple[str, str]]]:
    """For each parent table the (table, column) pairs that refer to it."""
    uses: dict[str, list[tuple[str, str]]] = {}
    for name, spec in TABLES.items():
        for column, parent in spec.references.items():
            uses.setdefault(parent, []).append((name, column))
    return uses


def _entry(table: str, rule: str, value: str, known: str = "false") -> str:
    return f"struct('{table}' AS `table`, '{rule}' AS rule, {value} AS value, {known} AS known)"


def _entries(spec: TableSpec, df: DataFrame) -> DataFrame:
    """For each row, from one scan: its key, the values that refer to parents, the row rules it
    breaks, and what it makes known to the tables that refer to it."""
    broken = ", ".join(f"IF({sql}, '{rule}', NULL)" for rule, sql in _row_rules(spec).items())
    key = f"CAST({spec.key} AS string)"
    entries = [
        _entry(spec.name, _ROW_RULES, f"nullif(concat_ws(',', {broken}), '')"),
        _entry(spec.name, f"{spec.key} repeated", key),
        *(_entry(spec.name, f"{c} unknown", f"CAST({c} AS string)") for c in spec.references),
        *(_entry(table, f"{c} unknown", key, "true") for table, c in _uses().get(spec.name, [])),
    ]
    return df.selectExpr(f"inline(array({', '.join(entries)}))").where("value IS NOT NULL")


def validate_tables(tables: Tables) -> DataFrame:
    """table, rule, n of every broken rule; no rows when all is well.

    A key counts for its rows beyond the first, a missing parent for all rows that refer to it.
    Each table is scanned once, and one shuffle brings a value's users and its parent together.
    Values are counted within each task before that, so one that a third of the rows share is one
    row per task.
    """
    entries = reduce(DataFrame.unionByName, (_entries(spec, tables[name]) for name, spec in TABLES.items()))
    held = entries.groupBy("table", "rule", "value").agg(
        F.expr("count_if(NOT known) AS held"), F.expr("bool_or(known) AS known")
    )
    faults = held.selectExpr(
        "`table`",
        f"explode(IF(rule = '{_ROW_RULES}', split(value, ','), array(rule))) AS rule",
        "CASE WHEN rule LIKE '% repeated' THEN held - 1 WHEN known THEN 0 ELSE held END AS n",
    )
    return faults.where("n > 0").groupBy("table", "rule").agg(F.sum("n").alias("n"))
