from __future__ import annotations

from datetime import date

import pytest
from hand_made import ROWS, TODAY, call, gift
from pyspark.sql import functions as F

from almoner.model import Tables
from almoner.operators.scope import scoped
from almoner.plans import AD_HOC, REPORTS
from almoner.plans.donors import shared


@pytest.fixture(scope="module")
def tables(make_tables):
    return make_tables(**ROWS)


def rows(df):
    return [tuple(r) for r in df.collect()]


# Expected rows in report order.
EXPECTED = {
    "overview": [(215, 2, 3, 100.0)],
    "donation_summary": [(215, 4, 2, 54)],
    "monthly_donations": [(5, "May", 65, 2), (6, "Jun", 150, 2)],
    "monthly_trend": [(5, "May", 0, 65, 14.30), (6, "Jun", 150, 0, 33.00)],
    "campaign_breakdown": [
        ("C1", "Camp 1", "#000000", 800, 215, 26.9),
        ("C2", "Camp 2", "#111111", 100, 0, 0.0),
    ],
    "channel_breakdown": [
        ("H1", "Label H1", "#000000", 165, 3, 76.7),
        ("H2", "Label H2", "#000000", 50, 1, 23.3),
        ("H3", "Label H3", "#000000", 0, 0, 0.0),
    ],
    "donation_rows": [
        ("30 Jun", "D2", "recurring", "Camp 1", "Label H1", 999, "pending"),
        ("10 Jun", "D1", "S1", "Camp 1", "Label H2", 50, "completed"),
        ("31 May", "D2", "recurring", "Camp 1", "Label H1", 25, "completed"),
        ("30 May", "D2", "recurring", "Camp 1", "Label H1", 40, "completed"),
        ("10 Jun", "D1", "S1", "Camp 1", "Label H1", 100, "completed"),
    ],
    "donations_export": [
        ("2026-06-30", "D2", "Camp 1", "Label H1", 999, "pending"),
        ("2026-06-10", "D1", "Camp 1", "Label H2", 50, "completed"),
        ("2026-05-31", "D2", "Camp 1", "Label H1", 25, "completed"),
        ("2026-05-30", "D2", "Camp 1", "Label H1", 40, "completed"),
        ("2025-06-10", "D1", "Camp 1", "Label H1", 100, "completed"),
    ],
    "call_summary": [(3, 2, 66.7, 2, 100.0, 2288)],
    "call_outcomes": [("answered", 2, 66.7), ("voicemail", 1, 33.3)],
    "caller_leaderboard": [
        ("A", "Caller I", "1y", 2, 1, 2, 60, 50.0, 200.0),
        ("B", "Caller I", "1y", 1, 1, 0, 0, 100.0, 0.0),
        ("Z", "Caller I", "1y", 0, 0, 0, 0, None, None),
    ],
    "call_rows": [
        ("02 Jun 17:00", "B", "D1", "1:15", "answered", 0, None),
        ("02 Jun 09:50", "A", "D1", "0:09", "voicemail", 10, None),
        ("01 Jun 09:05", "A", "D1", "75:00", "answered", 50, "thanks"),
    ],
    "calls_export": [
        ("2026-06-02 17:00", "B", "D1", "1:15", "answered", 0, None),
        ("2026-06-02 09:50", "A", "D1", "0:09", "voicemail", 10, None),
        ("2026-06-01 09:05", "A", "D1", "75:00", "answered", 50, "thanks"),
    ],
    "monthly_calls": [(6, "Jun", 3, 2, 66.7)],
    "hour_heatmap": [(9, 2, 1, 50.0), (17, 1, 1, 100.0)],
    "donor_segments": [
        ("S1", "Label S1", "#000000", 1, 150, 75),
        ("recurring", "Label recurring", "#000000", 1, 65, 33),
        ("S9", "Label S9", "#000000", 0, 0, 0),
    ],
    "donor_lifecycle": [("active", 1), ("lapsed", 1), ("new", 1)],
    "donor_roster": [
        ("D1", "S1", "Label S1", "Jan 2020", "active", 2, 150, 75),
        ("D2", "recurring", "Label recurring", "Feb 2021", "new", 2, 65, 33),
    ],
    "at_risk_donors": [("D3", "Label S1", "Mar 2022", 0, 0)],
    "raised_totals": [(215, 2, 54)],
    "channel_totals": [("H1", 165, 3), ("H2", 50, 1)],
    "campaign_vs_goal": [("C1", "Camp 1", 800, 215, 26.9)],
    "top_donors": [("D1", 150, 2), ("D2", 65, 2)],
    "lapsed_by_segment_id": [("D3", "S1", "Mar 2022", "lapsed", 0)],
    "caller_totals": [("A", 2, 1, 2, 60, 50.0), ("B", 1, 1, 0, 0, 100.0)],
}


@pytest.mark.parametrize("name", EXPECTED)
def test_hand_made(tables, name):
    assert rows((REPORTS | AD_HOC)[name](tables)) == EXPECTED[name]


def test_every_report_is_checked():
    assert set(EXPECTED) | {"daily_trend"} == set(REPORTS) | set(AD_HOC)


def test_daily_trend_starts_thirty_days_back(tables, make_tables):
    report = REPORTS["daily_trend"]
    assert rows(report(tables, as_of=TODAY)) == [
        (date(2026, 5, 31), 25, 1),
        (date(2026, 6, 10), 50, 1),
    ]
    later = make_tables(donations=[gift(1, "2026-07-05", "D1", "C1", "H1", 7)])
    assert rows(report(later, as_of=TODAY)) == [(date(2026, 7, 5), 7, 1)]


# What each report gives for tables without any row.
EMPTY = {
    "overview": [(0, 0, 0, 0.0)],
    "donation_summary": [(0, 0, 0, 0)],
    "raised_totals": [(None, 0, None)],
    "call_summary": [(0, 0, None, 0, None, None)],
}


@pytest.mark.parametrize("name", [*REPORTS, *AD_HOC])
def test_empty_tables(make_tables, name):
    assert rows((REPORTS | AD_HOC)[name](make_tables())) == EMPTY.get(name, [])


def test_no_completed_gift_and_no_answered_call(make_tables):
    quiet = make_tables(
        **ROWS
        | {
            "donations": [gift(1, "2026-06-10", "D1", "C1", "H1", 5, "pending")],
            "calls": [call(1, "2026-06-01 09:05", "A", 20, "missed", 5)],
        }
    )
    assert [r[5] for r in rows(REPORTS["channel_breakdown"](quiet))] == [None] * 3
    assert rows(REPORTS["overview"](quiet)) == [(0, 0, 1, 0.0)]
    assert rows(REPORTS["call_summary"](quiet)) == [(1, 0, 0.0, 1, None, None)]
    assert rows(REPORTS["caller_leaderboard"](quiet))[0][7:] == (0.0, None)


def test_zero_revenue_has_no_share(make_tables):
    free = make_tables(**ROWS | {"donations": [gift(1, "2026-06-10", "D1", "C1", "H1", 0)]})
    assert [r[5] for r in rows(REPORTS["channel_breakdown"](free))] == [None] * 3


def test_goal_of_zero_is_an_error(make_tables):
    bad = make_tables(**ROWS | {"campaigns": [("C1", "Camp 1", "#000000", 0)]})
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        REPORTS["campaign_breakdown"](bad).collect()


def test_gifts_without_parents(make_tables):
    """Inner joins leave them out, totals and outer joins do not."""
    lost = make_tables(
        **ROWS
        | {
            "donations": [
                gift(1, "2026-06-10", "Nobody", "C1", "H1", 5),
                gift(2, "2026-06-09", "D1", "none", "H1", 7),
                gift(3, "2026-06-08", "D1", "C1", "H1", 9),
            ]
        }
    )
    assert [r[5] for r in rows(REPORTS["donation_rows"](lost))] == [9]
    assert [r[4] for r in rows(REPORTS["donations_export"](lost))] == [5, 9]
    assert rows(REPORTS["donation_summary"](lost)) == [(21, 3, 2, 7)]
    assert rows(REPORTS["monthly_trend"](lost)) == [(6, "Jun", 16, 0, 3.52)]
    assert rows(REPORTS["donor_roster"](lost))[0][5:] == (2, 16, 8)


def test_rounding_is_half_away_from_zero(make_tables):
    owed = make_tables(
        **ROWS
        | {
            "donations": [
                gift(1, "2026-06-10", "D1", "C1", "H1", -1),
                gift(2, "2026-06-10", "D1", "C1", "H1", -2),
            ]
        }
    )
    assert rows(REPORTS["donation_summary"](owed)) == [(-3, 2, 1, -2)]
    assert rows(REPORTS["campaign_breakdown"](owed))[1][4:] == (-3, -0.4)


def test_sums_beyond_an_int(make_tables):
    large = make_tables(
        **ROWS
        | {"donations": [gift(i, "2026-06-10", "D1", "C1", "H1", 2**31 - 1) for i in range(4)]}
    )
    assert rows(REPORTS["donation_summary"](large))[0][0] == 4 * (2**31 - 1)
    assert rows(REPORTS["channel_breakdown"](large))[0][5] == 100.0


@pytest.mark.parametrize("name", ["donation_rows", "call_rows"])
def test_limits(tables, name):
    assert rows(REPORTS[name](tables, limit=2)) == EXPECTED[name][:2]
    assert rows(REPORTS[name](tables, limit=0)) == []
    with pytest.raises(ValueError):
        REPORTS[name](tables, limit=-1)


def test_ties_are_ordered_by_key(make_tables):
    tied = make_tables(
        **ROWS
        | {"donations": [gift(i, "2026-06-10", "D1", "C1", f"H{i}", 5) for i in (3, 1, 2)]}
    )
    assert [r[0] for r in rows(REPORTS["channel_breakdown"](tied))] == ["H1", "H2", "H3"]
    assert [r[4] for r in rows(REPORTS["donation_rows"](tied))] == [f"Label H{i}" for i in (3, 2, 1)]


def test_donation_rows_looks_past_gifts_without_a_donor(make_tables, monkeypatch):
    from almoner.operators import lookup

    gifts = [
        gift(100 - i, "2026-06-10", "D1" if i % 40 == 39 else "X", "C1", "H1", i)
        for i in range(100)
    ]
    many = make_tables(**ROWS | {"donations": gifts})
    amounts = lambda limit: [r[5] for r in rows(REPORTS["donation_rows"](many, limit))]
    # Takes 1, 10, 100 gifts in turn.
    assert (amounts(1), amounts(2), amounts(50)) == ([39], [39, 79], [39, 79])
    # Beyond the bound all gifts are joined.
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 15)
    assert (amounts(1), amounts(2), amounts(50)) == ([39], [39, 79], [39, 79])
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", -1)
    assert rows(REPORTS["donation_rows"](make_tables(**ROWS))) == EXPECTED["donation_rows"]


def test_shared_sums_change_nothing(tables):
    with shared(tables) as kept:
        for name in ("donor_segments", "donor_roster", "at_risk_donors", "top_donors"):
            assert rows((REPORTS | AD_HOC)[name](kept)) == EXPECTED[name]
        assert scoped(kept, campaign="C2").by_donor is None


def test_scopes(tables):
    assert rows(REPORTS["overview"](scoped(tables, segment="recurring"))) == [(65, 1, 0, 0.0)]
    assert rows(REPORTS["overview"](scoped(tables, segment="S1"))) == [(150, 1, 3, 100.0)]
    assert rows(REPORTS["overview"](scoped(tables, channel="H2"))) == [(50, 1, 3, 100.0)]
    assert rows(REPORTS["overview"](scoped(tables, campaign="C2"))) == [(0, 0, 3, 100.0)]
    both = scoped(tables, segment="S1", channel="H1")
    assert [r[3:5] for r in rows(REPORTS["channel_breakdown"](both))] == [(100, 1), (0, 0), (0, 0)]
    assert rows(REPORTS["donor_lifecycle"](scoped(tables, segment="S1"))) == [
        ("active", 1),
        ("lapsed", 1),
    ]
    assert rows(REPORTS["overview"](scoped(tables))) == EXPECTED["overview"]


def test_scopes_open_what_a_report_reads(tables):
    opened = []

    def load(table):
        opened.append(table)
        return tables[table]

    rows(REPORTS["channel_breakdown"](scoped(Tables(load), segment="S1")))
    assert "calls" not in opened and opened.count("donors") == 1


def test_totals_agree(spark):
    from conftest import SF

    from almoner.sources.sample import sample_tables

    tables = sample_tables(spark, SF)
    raised, _, placed, _ = REPORTS["overview"](tables).first()
    total = lambda name, column: REPORTS[name](tables).agg(F.sum(column)).first()[0]
    assert total("channel_breakdown", "revenue") == raised
    assert total("campaign_breakdown", "raised") == raised
    assert total("monthly_donations", "revenue") == raised
    assert total("donor_roster", "total") == raised
    assert total("call_outcomes", "count") == placed
    assert total("hour_heatmap", "total") == placed
    split = REPORTS["monthly_trend"](tables).selectExpr("month", "one_time + recurring AS revenue")
    months = REPORTS["monthly_donations"](tables).select("month", "revenue")
    assert rows(split.orderBy("month")) == rows(months)
