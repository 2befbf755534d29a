from __future__ import annotations

import json
from datetime import date

from pyspark.sql import functions as F
from decimal import Decimal

import pytest

from almoner.sources import crm

TODAY = date(2026, 6, 30)


def page(items) -> str:
    return json.dumps({"Results": items})


@pytest.fixture
def pages(spark):
    def make(**named):
        rows = [(f"/landing/{name}", text) for name, text in named.items()]
        return spark.createDataFrame(rows, "path string, page string")

    return make


def in_order(df, column):
    return [r[column] for r in df.orderBy("seq").collect()]


def test_names(pages):
    people = [
        {"FullName": "Ann Lee", "FirstName": "x", "LastName": "y"},
        {"FullName": "  kept as it is "},
        {"FullName": "", "FirstName": "Not", "LastName": "Used"},
        {"FullName": None, "FirstName": "Bo", "LastName": "Ray"},
        {"FullName": 12, "LastName": "Only"},
        {"FirstName": "Solo", "LastName": 5},
        {"FirstName": " \t", "LastName": "  "},
        {"fullname": "wrong case"},
        {},
        {"FullName": "O'Hara, \"Jo\""},
    ]
    donors = crm.normalise_donors(pages(p1=page(people)))
    assert in_order(donors, "name") == [
        "Ann Lee",
        "  kept as it is ",
        "Bo Ray",
        "Only",
        "Solo",
        "O'Hara, \"Jo\"",
    ]
    first = donors.orderBy("seq").first()
    assert tuple(first)[1:5] == ("grass", 0, "Jan 2024", "active")
    custom = crm.normalise_donors(pages(p1=page(people[:1])), segment_id="mid", max_gift=7).first()
    assert (custom.segment_id, custom.max_gift) == ("mid", 7)


GIFTS = [
    {"Id": "a", "ConstituentName": "Ann", "Date": "2026-05-31", "Amount": 12.5},
    {"Id": "b", "Date": "2026-05-31T23:30:00Z", "Amount": 10},
    {"Id": 3, "Amount": 1},
    {"Id": "c", "Amount": None, "Date": "soon"},
    {"Id": "d", "Amount": "12", "Date": None},
    {"Id": "e"},
    {"Amount": 5},
    {"Id": "f", "Amount": 1e2, "Date": "5/31/2026", "ConstituentName": 7},
    {"Id": "g", "Amount": True},
    {"Id": "h", "Amount": -3.25},
    {"Id": "i", "Amount": 12.495},
    {"Id": "j", "Amount": 1e30},
    {"Id": "k", "Amount": 1, "Date": "05/31/2026 11:30 PM"},
]


def test_gifts(pages):
    day = date(2026, 5, 31)
    gifts = crm.normalise_donations(pages(p1=page(GIFTS)), "crm", TODAY).orderBy("seq").collect()
    found = [(g.source_ref, g.gift_date, g.donor_name, g.amount) for g in gifts]
    assert found == [
        ("crm:a", day, "Ann", Decimal("12.5")),
        ("crm:b", day, "Unknown", Decimal(10)),
        ("crm:c", TODAY, "Unknown", Decimal(0)),
        ("crm:d", TODAY, "Unknown", Decimal(0)),
        ("crm:f", day, "Unknown", Decimal(100)),
        ("crm:g", TODAY, "Unknown", Decimal(0)),
        ("crm:h", TODAY, "Unknown", Decimal("-3.25")),
        ("crm:i", TODAY, "Unknown", Decimal("12.495")),
        ("crm:j", TODAY, "Unknown", None),
        ("crm:k", day, "Unknown", Decimal(1)),
    ]
    assert {(g.campaign_id, g.channel_id, g.status) for g in gifts} == {
        ("spring", "online", "completed")
    }


def test_numeric_ids_on_request(pages):
    gifts = crm.normalise_donations(pages(p1=page(GIFTS)), "crm", TODAY, accept_numeric_ids=True)
    assert "crm:3" in in_order(gifts, "source_ref")


def test_pages_without_results_give_nothing(pages):
    none = pages(a='{"Results":[]}', b="{}", c='{"Results":"x"}', d='{"Results":null}')
    assert crm.page_items(none).count() == 0


def test_a_bad_page_stands_alone(pages):
    given = pages(a="<html>", b=page([{"FullName": "Ann"}]), c='{"Results":[{"FullName":"x","FullName":"Bo"}]}')
    assert in_order(crm.normalise_donors(given), "name") == ["Ann", "Bo"]
    assert [r.page for r in crm.bad_pages(given).collect()] == ["<html>"]


def test_later_pulls_come_later(spark):
    paths = [f"/landing/pull-{n}/people-1.json" for n in (10, 9, 100)]
    given = spark.createDataFrame([(p, page([{"FullName": p}])) for p in paths], "path string, page string")
    assert in_order(crm.normalise_donors(given), "name") == [paths[1], paths[0], paths[2]]


def test_pages_on_lines_keep_their_order(spark, tmp_path, monkeypatch):
    # Small blocks, so that a file is read by several tasks.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        text = [page([{"FullName": f"{i:04}"}, {"FullName": f"{i:04}b"}]) for i in range(200)]
        (tmp_path / "pull-1.jsonl").write_text("\n".join(text[:120]))
        (tmp_path / "pull-2.jsonl").write_text("\n".join(text[120:]))
        pages = crm.read_pages(spark, str(tmp_path), lines=True)
        assert pages.rdd.getNumPartitions() > 4
        names = in_order(crm.normalise_donors(pages), "name")
        assert len(names) == 400 and names == sorted(names)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_items_are_ordered_by_folder_page_and_position(spark, tmp_path):
    for folder, number, names in (
        ("pull=2", 1, ["e"]),
        ("pull=1", 10, ["d"]),
        ("pull=1", 9, ["b", "c"]),
        ("pull=1", 1, ["a"]),
    ):
        place = tmp_path / folder
        place.mkdir(exist_ok=True)
        text = page([{"FullName": n} for n in names])
        (place / f"people-{number}.json").write_text(text.replace(",", ",\n"))
    donors = crm.normalise_donors(crm.read_pages(spark, str(tmp_path)))
    assert in_order(donors, "name") == ["a", "b", "c", "d", "e"]


def test_date_texts(spark):
    same = [
        "2026-05-31", "2026-05-31T23:30:00", "2026-05-31T23:30:00Z", "5/31/2026", "5/31/2026 23:30", "05/31/2026 11:30 PM",
        "5/31/2026 11:30:05 pm", "2026/5/31", "31 May 2026", "May 31, 2026", "May 31, 2026 11:30 PM", "Sun, 31 May 2026 23:30:00 GMT",
        "Sunday, May 31, 2026", "Sunday, May 31, 2026 11:30:00 PM", "31-May-2026", "5-31-2026", "may 31 2026",
    ]
    others = {"June 3, 2026": date(2026, 6, 3), "Sept 9, 2025 9:05": date(2025, 9, 9), "3 December 2024": date(2024, 12, 3)}
    none = ["soon", "", "31/5/2026", "May 2026", "Sunday", None]
    texts = [*same, *others, *none]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", crm._parsed_date(F.col("t"), crm.DATE_FORMATS).alias("d"))
    found = {r.t: r.d for r in rows.collect()}
    assert {t: found[t] for t in same} == dict.fromkeys(same, date(2026, 5, 31))
    assert {t: found[t] for t in others} == others
    assert {t: found[t] for t in none} == dict.fromkeys(none)


def test_the_place_of_a_page_is_worked_out_once_a_page(pages):
    made = pages(**{"p9/page-7.json": page([{"FullName": "Ann"}, {"FullName": "Bo"}])})
    items = crm.page_items(made)
    plan = items._jdf.queryExecution().optimizedPlan().toString()
    # No regular expression runs over the listed items.
    assert "Generate" in plan and "regexp" not in plan.split("Generate")[0]
    places = [(r.seq.folder, r.seq.number, r.seq.path, r.seq.pos) for r in items.collect()]
    folder = f"/landing/p{'9':0>20}"
    assert places == [(folder, 7, "/landing/p9/page-7.json", 0), (folder, 7, "/landing/p9/page-7.json", 1)]


def test_kinds_and_dates_need_no_regular_expression_for_plain_items(pages):
    made = pages(a=page([{"Id": "x", "Amount": 1.5, "Date": "Sat, 3 Jan 2026"}, {"Id": "y", "Amount": "1.5", "Date": "soon"}]))
    gifts = crm.normalise_donations(made, "crm", TODAY)
    assert [(r.amount, r.gift_date) for r in gifts.orderBy("seq").collect()] == [
        (Decimal("1.5"), date(2026, 1, 3)),
        (0, TODAY),
    ]
    assert "regexp" not in gifts.select("amount", "donor_name")._jdf.queryExecution().optimizedPlan().toString()
