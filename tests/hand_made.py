"""Tables small enough to check by hand; 'today' is 2026-06-30."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

TODAY = date(2026, 6, 30)


def gift(id, day, donor, campaign, channel, amount, status="completed"):
    return (id, date.fromisoformat(day), donor, campaign, channel, amount, status)


def call(id, time, caller, seconds, outcome, pledge, note=None):
    return (id, datetime.fromisoformat(time), caller, "D1", seconds, outcome, pledge, note, None)


def lookup_rows(ids):
    return [(i, f"Label {i}", "#000000", 1) for i in ids]


ROWS = {
    "segments": [(s, f"Label {s}", 1, 1, "#000000", "icon") for s in ("S1", "recurring", "S9")],
    "campaigns": [("C1", "Camp 1", "#000000", 800), ("C2", "Camp 2", "#111111", 100)],
    "channels": lookup_rows(["H1", "H2", "H3"]),
    "callers": [(c, "Caller I", "1y", Decimal("1.00")) for c in "ABZ"],
    "donors": [
        ("D1", "S1", 10, "Jan 2020", "active"),
        ("D2", "recurring", 20, "Feb 2021", "new"),
        ("D3", "S1", 30, "Mar 2022", "lapsed"),
    ],
    "donations": [
        gift(1, "2025-06-10", "D1", "C1", "H1", 100),
        gift(2, "2026-06-10", "D1", "C1", "H2", 50),
        gift(3, "2026-05-31", "D2", "C1", "H1", 25),
        gift(4, "2026-05-30", "D2", "C1", "H1", 40),
        gift(5, "2026-06-30", "D2", "C1", "H1", 999, "pending"),
    ],
    "calls": [
        call(1, "2026-06-01 09:05", "A", 4500, "answered", 50, "thanks"),
        call(2, "2026-06-02 09:50", "A", 9, "voicemail", 10),
        call(3, "2026-06-02 17:00", "B", 75, "answered", 0),
    ],
}
