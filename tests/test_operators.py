from __future__ import annotations

import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from hand_made import ROWS, gift
from pyspark.sql import functions as F

from almoner.model import TABLES, Tables
from almoner.operators import lookup as joins
from almoner.operators.ids import assign_ids, largest_id
from almoner.operators.layers import replace_live_layer
from almoner.operators.merge import first_per_key, insert_ignore, insert_new_donations, upsert_donors
from almoner.operators.validate import validate_tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- joins --------------------------------------------------------------------


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows on one key, some keys NULL, some unknown to the dim."""
    fact = spark.range(3000).selectExpr(
        "id",
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL"
        " ELSE concat('k', id % 400) END AS key",
    )
    dim = spark.range(300).selectExpr("concat('k', id) AS key", "id AS value").union(
        spark.sql("SELECT 'hot', -1L")
    )
    return fact, dim


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_is_the_same_join_however_it_runs(skewed, how, monkeypatch):
    fact, dim = skewed
    expected = rows(fact.join(dim, "key", how))
    assert rows(joins.lookup(fact, dim, "key", how)) == expected
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 10)
    assert rows(joins.lookup(fact, dim, "key", how)) == expected


def test_lookup_keeps_a_hot_key_whole_when_the_dim_repeats_it(spark, skewed, monkeypatch):
    fact, dim = skewed
    twice = dim.union(dim)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 1)
    assert rows(joins.lookup(fact, twice, "key")) == rows(fact.join(twice, "key"))


def test_fits_broadcast_counts_rows_and_bytes(spark):
    df = spark.range(100).selectExpr("id", "repeat('x', 1000) AS text")
    assert joins.fits_broadcast(df)
    assert not joins.fits_broadcast(df, max_rows=99)
    assert not joins.fits_broadcast(df, max_bytes=100_000)
    assert joins.fits_broadcast(df.where("false"), max_rows=0, max_bytes=0)
    many = spark.range(5000).selectExpr("id", "'x' AS text")
    assert joins.fits_broadcast(many, max_rows=5000)
    assert not joins.fits_broadcast(many, max_rows=4999)
    assert not joins.fits_broadcast(many, max_bytes=5000 * 33 - 1)


@pytest.mark.parametrize("bound", [None, -1])
def test_without(skewed, bound, monkeypatch):
    fact, dim = skewed
    if bound is not None:
        monkeypatch.setattr(joins, "BROADCAST_ROWS", bound)
    keys = dim.select("key")
    assert rows(joins.without(keys, fact, ["key"])) == rows(keys.join(fact, "key", "left_anti"))


# -- ids ----------------------------------------------------------------------


def test_ids_follow_the_largest_without_gaps(spark):
    target = spark.createDataFrame([(7,), (41,)], "id bigint")
    assert (largest_id(target), largest_id(target.where("false"))) == (41, 0)
    new = spark.range(1000).selectExpr("id * 3 AS payload").repartition(7)
    # Empty partitions in between.
    new = new.where("payload % 2 = 0")
    done = assign_ids(new, 41)
    assert sorted(r.id for r in done.collect()) == list(range(42, 42 + new.count()))
    assert rows(done.select("payload")) == rows(new)
    assert rows(done) == rows(done)
    assert min(r.id for r in assign_ids(new, 0).collect()) == 1


# -- upserts ------------------------------------------------------------------


def one_by_one_donors(target, batch):
    """Row by row, the way a database applies an upsert."""
    table = {d[0]: list(d) for d in target}
    for name, segment, max_gift, first_gift, lifecycle, _ in sorted(batch, key=lambda r: r[5]):
        if name in table:
            old = table[name]
            table[name] = [name, segment, max(old[2], max_gift), old[3], lifecycle]
        else:
            table[name] = [name, segment, max_gift, first_gift, lifecycle]
    return sorted(tuple(d) for d in table.values())


def donor_batch(rng, n, start=0):
    return [
        (
            f"D{rng.randint(1, 12)}",
            rng.choice(["S1", "recurring", "S9"]),
            rng.randint(0, 100),
            rng.choice(["Jan 2024", "Feb 2024", "Mar 2024"]),
            rng.choice(["active", "new", "lapsed"]),
            start + i,
        )
        for i in range(n)
    ]


DONOR_BATCH = TABLES["donors"].ddl + ", seq bigint"


@pytest.mark.parametrize("bound", [None, -1])
@pytest.mark.parametrize("seed", [1, 2])
def test_upsert_is_row_by_row(spark, make_tables, seed, bound, monkeypatch):
    if bound is not None:
        monkeypatch.setattr(joins, "BROADCAST_ROWS", bound)
    batch = donor_batch(random.Random(seed), 60)
    tables = make_tables(**ROWS)
    frame = spark.createDataFrame(batch, DONOR_BATCH).repartition(5)
    merged = upsert_donors(tables, frame)
    assert rows(merged.rows) == one_by_one_donors(ROWS["donors"], batch)
    assert merged.rejected.count() == 0 and merged.accepted.count() == 60
    again = upsert_donors(tables.with_(donors=merged.rows), frame)
    assert rows(again.rows) == rows(merged.rows)
    before = set(ROWS["donors"])
    assert rows(merged.changed) == [d for d in rows(merged.rows) if d not in before]
    assert (again.changed.count() == 0) == (rows(again.rows) == rows(merged.rows))


def test_upsert_in_two_halves(spark, make_tables):
    batch = donor_batch(random.Random(3), 40)
    tables = make_tables(**ROWS)
    whole = upsert_donors(tables, spark.createDataFrame(batch, DONOR_BATCH)).rows
    half = upsert_donors(tables, spark.createDataFrame(batch[:15], DONOR_BATCH)).rows
    both = upsert_donors(
        tables.with_(donors=half), spark.createDataFrame(batch[15:], DONOR_BATCH)
    ).rows
    assert rows(both) == rows(whole)


def test_upsert_rejects_broken_rows(spark, make_tables):
    batch = [
        ("New", "nowhere", 1, "Jan 2024", "active", 1),
        ("x" * 81, "S1", 1, "Jan 2024", "active", 2),
        ("Null", "S1", 1, None, "active", 3),
        ("Fine", "S1", 1, "Jan 2024", "active", 4),
    ]
    merge = upsert_donors(make_tables(**ROWS), spark.createDataFrame(batch, DONOR_BATCH))
    assert [r.name for r in merge.rows.orderBy("name").collect()] == ["D1", "D2", "D3", "Fine"]
    assert sorted(r.reason for r in merge.rejected.collect()) == [
        "first_gift missing",
        "name too long",
        "segment_id unknown",
    ]


GIFT_BATCH = (
    "source_ref string, gift_date date, donor_name string, campaign_id string,"
    " channel_id string, amount decimal(28,10), status string, seq bigint"
)


def half_up(amount: Decimal) -> int:
    return int(amount.quantize(Decimal(1), rounding="ROUND_HALF_UP"))


def one_by_one_gifts(target, batch):
    """(date, donor, campaign, channel, amount, status) of rows a database would add."""
    known = {(g[2], g[1], g[5], g[3], g[4]) for g in target}
    donors = {d[0] for d in ROWS["donors"]}
    added = []
    for _, day, donor, campaign, channel, amount, status, _ in sorted(batch, key=lambda r: r[7]):
        key = (donor, day, half_up(amount), campaign, channel)
        if donor not in donors or campaign not in ("C1", "C2") or channel not in ("H1", "H2", "H3"):
            continue
        if key not in known:
            known.add(key)
            added.append((day, donor, campaign, channel, half_up(amount), status))
    return sorted(added, key=repr)


def gift_batch(rng, n):
    return [
        (
            f"crm:{i}",
            date(2026, 6, 10) + timedelta(days=rng.randint(-1, 1)),
            rng.choice(["D1", "D1", "D2", "Unknown"]),
            rng.choice(["C1", "C1", "C2", "none"]),
            rng.choice(["H1", "H2", "none"]),
            Decimal(rng.choice(["50", "49.5", "50.5", "0", "12.4950000000"])),
            rng.choice(["completed", "pending"]),
            i,
        )
        for i in range(n)
    ]


def added(merge):
    return rows(merge.rows.drop("id"))


@pytest.mark.parametrize("bound", [None, -1])
@pytest.mark.parametrize("seed", [1, 2])
def test_new_gifts_are_row_by_row(spark, make_tables, seed, bound, monkeypatch):
    if bound is not None:
        monkeypatch.setattr(joins, "BROADCAST_ROWS", bound)
    batch = gift_batch(random.Random(seed), 80)
    tables = make_tables(**ROWS)
    frame = spark.createDataFrame(batch, GIFT_BATCH).repartition(5)
    merge = insert_new_donations(tables, frame)
    expected = one_by_one_gifts(ROWS["donations"], batch)
    assert added(merge) == expected
    assert sorted(r.id for r in merge.rows.collect()) == list(range(6, 6 + len(expected)))
    assert merge.accepted.count() + merge.rejected.count() == 80
    grown = tables.donations.unionByName(merge.rows)
    again = insert_new_donations(tables.with_(donations=grown), frame)
    assert again.rows.count() == 0


def test_gift_checks(spark, make_tables):
    day = date(2026, 6, 10)
    batch = [
        ("crm:1", day, "D1", "C1", "H2", Decimal("49.5"), "completed", 1),  # rounds to a known gift
        ("crm:2", day, "D1", "C1", "H1", Decimal("3000000000"), "completed", 2),
        ("crm:3", day, "D1", "C1", "H1", None, "completed", 3),
        ("crm:4", day, "Unknown", "C1", "H1", Decimal("1"), "completed", 4),
        ("crm:5", day, "D1", "C1", "H1", Decimal("1"), "much too long", 5),
        ("crm:6", day, "D1", "C1", "H1", Decimal("12.495"), "completed", 6),
    ]
    merge = insert_new_donations(make_tables(**ROWS), spark.createDataFrame(batch, GIFT_BATCH))
    assert added(merge) == [(day, "D1", "C1", "H1", 12, "completed")]
    assert sorted((r.source_ref, r.reason) for r in merge.rejected.collect()) == [
        ("crm:2", "amount missing"),
        ("crm:3", "amount missing"),
        ("crm:4", "donor_name unknown"),
        ("crm:5", "status too long"),
    ]


def test_source_ref_keeps_repeated_gifts_apart(spark, make_tables):
    day = date(2026, 6, 10)
    same = (day, "D1", "C1", "H2", Decimal("50"), "completed")
    batch = [("crm:1", *same, 1), ("crm:2", *same, 2), ("crm:2", *same, 3), ("crm:9", *same, 4)]
    tables = make_tables(**ROWS)
    stored = tables.donations.withColumn(
        "source_ref", F.when(F.col("id") == 2, "crm:9").otherwise(F.concat(F.lit("old:"), "id"))
    )
    merge = insert_new_donations(
        tables.with_(donations=stored),
        spark.createDataFrame(batch, GIFT_BATCH),
        key=("source_ref",),
    )
    assert sorted(r.source_ref for r in merge.rows.collect()) == ["crm:1", "crm:2"]


def test_empty_batches(spark, make_tables):
    tables = make_tables(**ROWS)
    assert insert_new_donations(tables, spark.createDataFrame([], GIFT_BATCH)).rows.count() == 0
    merge = upsert_donors(tables, spark.createDataFrame([], DONOR_BATCH))
    assert rows(merge.rows) == sorted(ROWS["donors"])


def test_insert_ignore(spark, make_tables):
    batch = [
        ("D1", "S9", 99, "Jan 2024", "new", 1),
        ("N", "S1", 2, "Feb 2024", "active", 3),
        ("N", "S9", 1, "Mar 2024", "new", 2),
    ]
    target = make_tables(**ROWS).donors
    frame = spark.createDataFrame(batch, DONOR_BATCH)
    after = insert_ignore(target, frame, ["name"])
    assert rows(after) == sorted([*ROWS["donors"], ("N", "S9", 1, "Mar 2024", "new")])
    assert rows(insert_ignore(after, frame, ["name"])) == rows(after)


# -- layers and checks --------------------------------------------------------


def test_live_layer_replaces_from_the_day_on(make_tables):
    tables = make_tables(**ROWS)
    layer = make_tables(
        donations=[
            gift(9, "2026-06-10", "D2", "C2", "H2", 1),
            gift(10, "2026-06-09", "D2", "C2", "H2", 1),
        ]
    ).donations
    after = replace_live_layer(tables.donations, layer, "gift_date", date(2026, 6, 10))
    assert sorted(r.id for r in after.collect()) == [1, 3, 4, 9]


def test_validation(make_tables):
    assert validate_tables(make_tables(**ROWS)).count() == 0
    assert validate_tables(make_tables()).count() == 0
    broken = make_tables(
        **ROWS
        | {
            "donors": [*ROWS["donors"], ("D1", "S1", 1, "Jan 2020", "odd"), ("E", None, 1, "x" * 11, "new")],
            "donations": [
                *ROWS["donations"],
                gift(5, "2026-06-10", "Nobody", "none", "H1", 1, "completed"),
                gift(6, "2026-06-10", "Nobody", "C1", "H1", None, "lost"),
            ],
        }
    )
    assert rows(validate_tables(broken)) == [
        ("donations", "amount missing", 1),
        ("donations", "campaign_id unknown", 1),
        ("donations", "donor_name unknown", 2),
        ("donations", "id repeated", 1),
        ("donations", "status not allowed", 1),
        ("donors", "first_gift too long", 1),
        ("donors", "lifecycle not allowed", 1),
        ("donors", "name repeated", 1),
        ("donors", "segment_id missing", 1),
    ]


def test_validation_scans_each_table_once(make_tables):
    opened = []
    tables = make_tables(**ROWS)

    def load(table):
        opened.append(table)
        return tables[table]

    plan = validate_tables(Tables(load))._jdf.queryExecution().executedPlan().toString()
    assert sorted(opened) == sorted(TABLES)
    # By value, then by rule; no join.
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


def test_validation_of_a_hot_value(make_tables):
    gifts = [gift(i, "2026-06-10", "Nobody" if i % 3 else "D1", "C1", "H1", 1) for i in range(300)]
    assert rows(validate_tables(make_tables(**ROWS | {"donations": gifts}))) == [
        ("donations", "donor_name unknown", 200)
    ]


# -- sizes and filters --------------------------------------------------------


def test_sizes_count_what_is_inside(spark):
    few = spark.range(20)
    longs = few.selectExpr("id", "transform(sequence(1, 100000), x -> CAST(x AS BIGINT)) AS a")
    texts = few.selectExpr("id", "transform(sequence(1, 1000), x -> repeat('x', 1000)) AS a")
    nested = few.selectExpr("struct(map('k', array(repeat('x', 1000000))) AS m) AS s")
    raw = few.selectExpr("CAST(repeat('x', 1000000) AS binary) AS b")
    for wide in (longs, texts, nested, raw):
        assert not joins.fits_broadcast(wide, max_bytes=10_000_000)
        assert joins.fits_broadcast(wide.limit(5), max_bytes=10_000_000)
    nulls = spark.sql("SELECT CAST(NULL AS array<string>) AS a, CAST(NULL AS map<string, int>) AS m, CAST(NULL AS struct<x: string>) AS s")
    assert joins.fits_broadcast(nulls, max_bytes=1000) and joins.fits_broadcast(nulls.limit(0), max_bytes=0)


def test_a_filter_lets_all_matches_through_and_little_else(spark):
    stored = spark.range(100_000).selectExpr("concat('D', id) AS donor_name", "CAST(id % 7 AS INT) AS amount", "id")
    wanted = spark.range(0, 3_000_000, 1000).selectExpr("concat('D', id) AS donor_name", "CAST(id % 7 AS INT) AS amount")
    found = joins.may_match(stored, wanted, ["donor_name", "amount"])
    assert found.columns == stored.columns
    ids = {r.id for r in found.collect()}
    assert ids >= set(range(0, 100_000, 1000)) and len(ids) < 300
    assert joins.may_match(stored, wanted.limit(0), ["donor_name", "amount"]).count() == 0


def test_many_new_rows_shuffle_matches_only(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = spark.range(5000).selectExpr("id AS k", "id AS other")
        rows = spark.range(4000, 8000).selectExpr("id AS k")
        left = joins.without(rows, stored, ["k"])
        plan = left._jdf.queryExecution().executedPlan().toString()
        # Below the exchange that the stored keys go through there is the filter's join.
        below = plan[plan.index("SortMergeJoin") :]
        assert "BroadcastHashJoin" in below and "LeftSemi" in below
        assert below.index("Exchange hashpartitioning(k", below.index("LeftAnti")) < below.index("BroadcastHashJoin")
        assert sorted(r.k for r in left.collect()) == list(range(5000, 8000))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_first_per_key_moves_seq_once(spark):
    given = "VALUES ('a', 1, named_struct('at', 2)), ('a', 2, named_struct('at', 1)), ('b', 3, named_struct('at', 3)) AS t(k, v, seq)"
    made = spark.sql(f"SELECT * FROM {given}")
    assert rows(first_per_key(made, ["k"])) == [("a", 2, (1,)), ("b", 3, (3,))]
    assert rows(first_per_key(made, ["k", "v"])) == [("a", 1, (2,)), ("a", 2, (1,)), ("b", 3, (3,))]
    # Whoever asks for the values alone pays for one seq, which orders them.
    plan = first_per_key(made, ["k"]).drop("seq")._jdf.queryExecution().optimizedPlan().toString()
    assert "min(seq" not in plan and "min_by(struct(v" in plan.replace("named_struct(v, ", "struct(")
