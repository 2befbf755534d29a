from __future__ import annotations

import uuid
from datetime import date, datetime
from decimal import Decimal

import pytest
from hand_made import ROWS, call, gift
from pyspark.sql import functions as F

from almoner.model import BUCKET_COLUMN, TABLES, conform
from almoner.operators.merge import upsert_donors
from almoner.operators.periods import newest_months, on_days_of, since
from almoner.plans import REPORTS
from almoner.plans.donors import shared
from almoner.sinks import files
from almoner.sinks.store import Store, copy_tables
from almoner.sources.tables import load_tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def a_store(spark, folder, **options):
    return Store(spark, f"store_{uuid.uuid4().hex}", str(folder), **options)


@pytest.fixture
def store(spark, tmp_path, make_tables):
    store = a_store(spark, tmp_path / "store", buckets=8)
    copy_tables(make_tables(**ROWS), store)
    return store


def files_of(store, table):
    """The files of each partition."""
    found = {}
    for path in store.read(table).inputFiles():
        folder, name = path.rsplit("/", 1)
        found.setdefault(folder.rsplit("/", 1)[1], set()).add(name)
    return found


def test_copy_counts_and_keeps_every_row(store, make_tables):
    source = make_tables(**ROWS)
    counts = {r.table: r["rows"] for r in copy_tables(source, store).collect()}
    assert counts == {t: len(ROWS[t]) for t in TABLES}
    for table in TABLES:
        assert rows(conform(store.read(table), table)) == rows(source[table])


def test_a_copy_scans_its_source_once(spark, tmp_path, make_tables):
    """The counts come from the writes: no job reads a table a second time."""
    store, read = a_store(spark, tmp_path / "once"), []
    source = make_tables(**ROWS)
    counting = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            counting.add(batch.num_rows)
            yield batch

    gifts = source.donations.mapInArrow(seen, source.donations.schema)
    copied = copy_tables(source.with_(donations=gifts), store).collect()
    assert {r.table: r["rows"] for r in copied}["donations"] == 5 == counting.value and not read


def test_a_missing_table_is_refused(spark, tmp_path):
    store = a_store(spark, tmp_path)
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        store.read("calls")
    store.create()
    assert store.read("calls").count() == 0
    assert {t: r for t, r in copy_tables(store.tables(), a_store(spark, tmp_path / "more")).collect()} == dict.fromkeys(TABLES, 0)


def test_a_table_is_not_replaced_by_rows_read_from_it(store):
    with pytest.raises(Exception, match="overwrite"):
        store.replace("callers", store.read("callers").limit(1))
    assert store.read("callers").count() == 3


def test_rows_without_a_date_stay(store, make_tables):
    undated = make_tables(donations=[gift(77, "2026-06-11", "D1", "C1", "H1", 3)]).donations
    undated = undated.withColumn("gift_date", F.lit(None).cast("date"))
    store.append("donations", undated)
    store.replace_since({"donations": undated.limit(0)}, date(2026, 1, 1))
    assert sorted(r.id for r in store.read("donations").collect()) == [1, 77]


def test_a_cut_off_that_dies_is_finished_by_the_next(store, make_tables, monkeypatch):
    before = rows(store.read("donations")), rows(store.read("calls"))
    layers = make_tables(
        donations=[gift(9, "2026-06-20", "D1", "C1", "H1", 3)], calls=[call(9, "2026-06-20 10:00", "A", 1, "missed", 0)]
    )
    both = {t: layers[t] for t in ("donations", "calls")}
    with monkeypatch.context() as broken:
        broken.setattr(Store, "_put_staged", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.replace_since(both, date(2026, 5, 31))
    assert (rows(store.read("donations")), rows(store.read("calls"))) == before
    # Now between the tables' months: gifts lose their months and do not get the new ones.
    with monkeypatch.context() as broken:
        broken.setattr(Store, "_layout", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.replace_since(both, date(2026, 5, 31))
    assert store.replace_since(both, date(2026, 5, 31)) == {"donations": 1, "calls": 1}
    assert sorted(r.id for r in store.read("donations").collect()) == [1, 4, 9]
    assert [r.id for r in store.read("calls").collect()] == [9]
    assert [r.tableName for r in store.spark.sql(f"SHOW TABLES IN {store.database} LIKE '*since*'").collect()] == []


def test_a_cut_off_leaves_the_files_of_earlier_months(store, make_tables):
    before = files_of(store, "donations"), files_of(store, "calls")
    layers = make_tables(
        donations=[gift(9, "2026-06-20", "D1", "C1", "H1", 3)], calls=[call(9, "2026-06-02 10:00", "A", 1, "missed", 0)]
    )
    both = {t: layers[t] for t in ("donations", "calls")}
    for _ in range(2):
        assert store.replace_since(both, date(2026, 6, 2)) == {"donations": 1, "calls": 1}
        assert sorted(r.id for r in store.read("donations").collect()) == [1, 3, 4, 9]
        assert sorted(r.id for r in store.read("calls").collect()) == [1, 9]
        after = files_of(store, "donations")
        for month in ("period_month=2025-06-01", "period_month=2026-05-01"):
            assert after[month] == before[0][month]
        assert after["period_month=2026-06-01"] != before[0]["period_month=2026-06-01"]


def test_source_refs_are_kept(store, make_tables):
    more = make_tables(donations=[gift(6, "2026-06-11", "D1", "C1", "H1", 3)]).donations
    store.append("donations", more.withColumn("source_ref", F.lit("crm:6")))
    store.replace_since({"donations": store.read("donations")}, date(2026, 6, 1))
    assert {r.id: r.source_ref for r in store.read("donations").collect()}[6] == "crm:6"


def test_append(store, make_tables):
    before = files_of(store, "donations")
    more = make_tables(donations=[gift(6, "2026-06-11", "D1", "C1", "H1", 3)]).donations
    assert store.append("donations", more) == 1
    assert sorted(r.id for r in store.read("donations").collect()) == [1, 2, 3, 4, 5, 6]
    after = files_of(store, "donations")
    assert all(files <= after[month] for month, files in before.items())
    assert store.append("donations", more.limit(0)) == 0


def test_only_buckets_that_change_are_written(store, spark):
    many = spark.range(200).selectExpr(
        "concat('N', id) AS name", "'S1' AS segment_id", "1 AS max_gift", "'Jan 2024' AS first_gift", "'new' AS lifecycle"
    )
    store.replace("donors", many)
    before = files_of(store, "donors")
    assert len(before) == 8
    batch = [("N7", "S9", 0, "Feb 2024", "active", 1), ("N8", "S1", 1, "Mar 2024", "new", 2)]
    schema = "name string, segment_id string, max_gift int, first_gift string, lifecycle string, seq int"
    merge = upsert_donors(store.tables(), spark.createDataFrame(batch, schema), store.bucket)
    # N8 stays as it was, so its bucket does too.
    assert store.put_donors(merge.rows, merge.changed) == 1
    after = files_of(store, "donors")
    touched = [r[0] for r in store.read("donors").where("name = 'N7'").select(BUCKET_COLUMN).collect()]
    assert {k for k in before if before[k] != after[k]} == {f"{BUCKET_COLUMN}={touched[0]}"}
    found = {r.name: (r.segment_id, r.lifecycle) for r in store.read("donors").collect()}
    assert len(found) == 200 and found["N7"] == ("S9", "active") and found["N8"] == ("S1", "new")
    assert store.put_donors(merge.rows, merge.changed.limit(0)) == 0
    # The batch's buckets only are read.
    assert BUCKET_COLUMN in merge.rows._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_replace_since(store, make_tables):
    layer = make_tables(
        donations=[
            gift(9, "2026-05-31", "D1", "C1", "H1", 3),
            gift(10, "2026-08-01", "D1", "C1", "H1", 3),
            gift(11, "2026-01-01", "D1", "C1", "H1", 3),
        ]
    ).donations
    for _ in range(2):
        assert store.replace_since({"donations": layer}, date(2026, 5, 31)) == {"donations": 2}
        assert sorted(r.id for r in store.read("donations").collect()) == [1, 4, 9, 10]
    # The month of the cut-off may end up empty too.
    store.replace_since({"donations": layer.where("false")}, date(2026, 5, 1))
    assert [r.id for r in store.read("donations").collect()] == [1]
    calls = make_tables(calls=[call(9, "2026-06-02 00:00", "A", 1, "missed", 0)]).calls
    store.replace_since({"calls": calls}, date(2026, 6, 2))
    assert sorted(r.id for r in store.read("calls").collect()) == [1, 9]


def test_period_filters_prune_months(store):
    gifts = store.read("donations")
    late = since(gifts, "gift_date", F.lit(date(2026, 6, 1)))
    assert sorted(r.id for r in late.collect()) == [2, 5]
    assert "period_month" in partition_filters(late)
    # 2025-06-10 and 2026-05-31: the months between are not opened.
    same = on_days_of(gifts, gifts.where("id IN (1, 3)"), "gift_date")
    assert sorted(r.id for r in same.collect()) == [1, 3, 4]
    assert "period_month" in partition_filters(same)
    none = on_days_of(gifts, gifts.where("false"), "gift_date")
    assert none.count() == 0


def partition_filters(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("PartitionFilters: [")[1].split("]")[0]


def test_newest_months(store):
    gifts = store.read("donations")
    kept = lambda n: sorted(r.id for r in newest_months(gifts, n).collect())
    assert kept(0) == kept(2) == [2, 5]
    assert kept(3) == kept(4) == [2, 3, 4, 5]
    assert kept(5) == kept(99) == [1, 2, 3, 4, 5]
    assert "period_month" in partition_filters(REPORTS["call_rows"](store.tables(), limit=1))
    # Gifts without a donor are not among the newest.
    tables = store.tables().with_(donors=store.read("donors").where("name = 'D1'"))
    assert [r.amount for r in REPORTS["donation_rows"](tables, limit=2).collect()] == [50, 100]


def test_last_id(store, spark, tmp_path, make_tables):
    empty = a_store(spark, tmp_path / "none")
    empty.create()
    assert empty.last_id("donations") == 0
    assert store.last_id("donations") == 5
    more = make_tables(donations=[gift(70, "2026-06-11", "D1", "C1", "H1", 3)]).donations
    store.append("donations", more)
    assert store.last_id("donations") == 70
    store.append("donations", more.withColumn("id", F.lit(8).cast("bigint")))
    assert store.last_id("donations") == 70
    assert store.read("donations").count() == 7
    store.replace_since({"donations": more}, date(2026, 6, 1))
    assert store.last_id("donations") == 70
    assert store.last_id("donations") == 70
    store.replace("donations", make_tables(**ROWS).donations.where("id < 4"))
    assert store.last_id("donations") == 3


def test_reports_read_a_store(store, make_tables):
    for name in ("overview", "donation_rows", "calls_export"):
        assert rows(REPORTS[name](store.tables())) == rows(REPORTS[name](make_tables(**ROWS)))


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_load_files(spark, tmp_path, make_tables, fmt):
    source = make_tables(**ROWS)
    for table in TABLES:
        source[table].write.format(fmt).option("header", True).save(f"{tmp_path}/{table}")
    loaded = load_tables(spark, str(tmp_path), fmt)
    for table in TABLES:
        assert loaded[table].schema.names == TABLES[table].schema.names
        assert rows(loaded[table]) == rows(source[table])


def test_load_catalog(spark, tmp_path, make_tables):
    spark.sql(f"CREATE DATABASE giving LOCATION '{tmp_path}/giving'")
    source = make_tables(**ROWS)
    for table in TABLES:
        # As stored elsewhere: other order, wider types.
        wide = source[table].select(*reversed(source[table].columns))
        if table == "donations":
            wide = wide.withColumn("amount", F.col("amount").cast("bigint"))
        wide.write.saveAsTable(f"giving.{table}")
    loaded = load_tables(spark, "giving", "table")
    for table in TABLES:
        assert loaded[table].schema.simpleString() == TABLES[table].schema.simpleString()
        assert rows(loaded[table]) == rows(source[table])
    spark.sql("DROP DATABASE giving CASCADE")


def test_wrong_text_fails_the_read(spark, tmp_path):
    (tmp_path / "campaigns").mkdir()
    (tmp_path / "campaigns" / "a.csv").write_text("id,label,color,goal\nC1,x,#0,many\n")
    with pytest.raises(Exception, match="MALFORMED"):
        load_tables(spark, str(tmp_path), "csv").campaigns.collect()
    with pytest.raises(ValueError):
        load_tables(spark, str(tmp_path), "xml").campaigns


def test_csv_files(spark, tmp_path, make_tables):
    named = make_tables(
        **ROWS
        | {
            "campaigns": [("C1", 'Say "hi", all', "#000000", 800)],
            "donations": [gift(1, "2026-06-10", "D1", "C1", "H1", 5), gift(2, "2026-06-11", "D2", "C1", "H2", 6)],
        }
    )
    files.write_csv(REPORTS["donations_export"](named), files.DONATION_HEADER, f"{tmp_path}/gifts")
    text = "".join(p.read_text() for p in sorted((tmp_path / "gifts").glob("part-*")))
    assert text.startswith("Date,Donor,Campaign,Channel,Amount,Status\n")
    assert '2026-06-10,D1,"Say ""hi"", all",Label H1,5,completed\n' in text
    files.write_csv(REPORTS["calls_export"](named), files.CALL_HEADER, f"{tmp_path}/calls")
    back = spark.read.csv(f"{tmp_path}/calls", header=True)
    assert back.columns == ["Time", "Caller", "Contact", "Duration", "Outcome", "Pledge"]
    assert back.count() == 3


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_publish(spark, tmp_path, make_tables, fmt):
    with shared(make_tables(**ROWS)) as tables:
        wanted = {n: REPORTS[n](tables) for n in ("donor_roster", "donor_segments", "overview")}
        files.publish(wanted, str(tmp_path), fmt, datetime(2026, 6, 30, 12))
        for name, report in wanted.items():
            back = spark.read.format(fmt).load(f"{tmp_path}/{name}")
            assert rows(back.select(*report.columns)) == rows(report)
            assert {str(t)[:19] for (t,) in back.select(F.col("computed_at").cast("timestamp")).distinct().collect()} == {"2026-06-30 12:00:00"}


def test_decimal_boost_survives(store):
    assert store.read("callers").first().conv_boost == Decimal("1.00")
