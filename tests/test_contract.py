from __future__ import annotations

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from compare import database, duckdb_rows, spark_rows
from conftest import SF

import __spark_entry__ as contract
import oracles

# What the optional corpus part adds has its own tests.
CORPUS_QUERIES, CORPUS_ORACLES = contract._corpus()
QUERIES = {name: query for name, query in contract.queries().items() if name not in CORPUS_QUERIES}
ORACLES = {name: sql for name, sql in contract.oracle_sql().items() if name not in CORPUS_ORACLES}


@pytest.fixture(scope="module")
def db():
    return database(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert contract.entry(spark).count() == 5


@pytest.mark.parametrize("name", QUERIES)
def test_equals_duckdb(spark, db, name):
    df = QUERIES[name](spark, SF)
    assert spark_rows(df) == duckdb_rows(db, ORACLES[name])


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# Joins of small test tables may be nested loops by Spark's choice; a cross join or
# Python in a plan would be ours.
@pytest.mark.parametrize("name", [*oracles.REPORTS, "validate_tables", "normalise_donations"])
def test_plans_stay_in_the_engine(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval"):
        assert bad not in plan


def test_scans_are_narrow_and_filtered(spark):
    plan = plan_of(QUERIES["monthly_donations"](spark, SF))
    assert "ReadSchema: struct<o_orderstatus:string,o_totalprice:double,o_orderdate:timestamp_ntz>" in plan
    assert "PushedFilters: [EqualNullSafe(o_orderstatus,F)]" in plan
    plan = plan_of(QUERIES["donor_lifecycle"](spark, SF))
    assert "ReadSchema: struct<c_nationkey:int>" in plan
    # Donors without their first gift do not read the orders for it.
    assert plan_of(QUERIES["donor_segments"](spark, SF)).count("orders.parquet") == 1


def test_monthly_trend_shuffles_gifts_by_donor_once(spark):
    plan = plan_of(QUERIES["monthly_trend"](spark, SF))
    by_donor = [line for line in plan.splitlines() if "Exchange hashpartitioning(donor_name" in line]
    # Donors come as they are, or by the same key; the rest is one row.
    assert len(by_donor) <= 2 and plan.count("Exchange hashpartitioning") == len(by_donor)


def test_donation_rows_runs_no_job_while_it_is_planned(spark):
    tracker, before = spark.sparkContext.statusTracker(), None
    spark.sparkContext.setJobGroup("planning", "planning")
    try:
        df = QUERIES["donation_rows"](spark, SF)
        before = tracker.getJobIdsForGroup("planning")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert list(before) == []
    plan = plan_of(df)
    assert plan.count("TakeOrderedAndProject") == 1 or plan.count("GlobalLimit") + plan.count("TakeOrdered") >= 1
    assert "LeftSemi" in plan


def test_the_rest_works_without_the_corpus_part(tmp_path):
    root = Path(__file__).resolve().parents[1]
    gone = shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__")
    left = tmp_path / "bare"
    shutil.copytree(root, left, ignore=gone)
    code = "import __spark_entry__ as c; print(len(c.queries()), len(c.oracle_sql()), any(q.startswith('op') for q in c.queries()))"
    for keep_pipeline in (False, True):
        if keep_pipeline and (root / "corpus_pipeline.py").exists():
            shutil.copy(root / "corpus_pipeline.py", left)
        done = subprocess.run([sys.executable, "-c", code], cwd=left, capture_output=True, text=True, timeout=120)
        assert done.stdout.split() == [str(len(QUERIES)), str(len(ORACLES)), "False"], done.stderr


def test_gifts_are_summed_before_they_are_shuffled(spark):
    plan = plan_of(QUERIES["donor_segments"](spark, SF))
    lines = [line for line in plan.splitlines() if "Exchange" in line or "partial_sum" in line]
    assert plan.index("partial_sum") > 0 and any("Exchange hashpartitioning" in x for x in lines)


def test_names_need_no_join():
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        folder = f"/root/testdata/{sf}"
        rows = duckdb.sql(
            f"""SELECT count(*) FROM read_parquet('{folder}/customer.parquet')
                WHERE c_name <> 'Customer#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0')"""
        ).fetchall()
        assert rows == [(0,)]


def test_bench_prints_one_line():
    root = Path(__file__).resolve().parents[1]
    env = os.environ | {"BENCH_SF_DIR": SF, "BENCH_RUNS": "1", "BENCH_QUERIES": "overview"}
    done = subprocess.run(
        [sys.executable, str(root / "bench.py")], env=env, capture_output=True, text=True, timeout=600
    )
    result = json.loads(done.stdout)
    assert set(result) == {"metric", "value", "unit", "queries", "sf"}
    assert list(result["queries"]) == ["overview"]
