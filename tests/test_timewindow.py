"""Periods in questions: fixed cases with plain values, and the calendar's corners."""

from __future__ import annotations

from datetime import date, timedelta

import pytest
from hypothesis import given
from hypothesis import strategies as st

from groundwell.plans.timewindow import TimeWindow, resolve

AS_OF = "2026-08-31"

CASES = [
    ("how much did we refund last month", "2026-07-01", "2026-07-31"),
    ("how much did we refund this month", "2026-08-01", "2026-08-31"),
    ("how many orders this year", "2026-01-01", "2026-12-31"),
    ("how many orders last year", "2025-01-01", "2025-12-31"),
    ("how many orders in 2026", "2026-01-01", "2026-12-31"),
    ("how many orders in 2025", "2025-01-01", "2025-12-31"),
    ("refunds in Q2 2026", "2026-04-01", "2026-06-30"),
    ("refunds in Q2", "2026-04-01", "2026-06-30"),
    ("refunds in q4 2025", "2025-10-01", "2025-12-31"),
    ("orders last quarter", "2026-04-01", "2026-06-30"),
    ("orders this quarter", "2026-07-01", "2026-09-30"),
    ("tickets opened yesterday", "2026-08-30", "2026-08-30"),
    ("tickets opened today", "2026-08-31", "2026-08-31"),
    ("tickets in the last 7 days", "2026-08-25", "2026-08-31"),
    ("tickets in the last 30 days", "2026-08-02", "2026-08-31"),
    ("tickets in the past 1 day", "2026-08-31", "2026-08-31"),
    ("refunds since June", "2026-06-01", "2026-08-31"),
    ("refunds since 2025", "2025-01-01", "2026-08-31"),
    ("refunds in June", "2026-06-01", "2026-06-30"),
    ("refunds in June 2025", "2025-06-01", "2025-06-30"),
    ("refunds in feb 2024", "2024-02-01", "2024-02-29"),
    ("orders last week", "2026-08-24", "2026-08-30"),
    ("orders this week", "2026-08-31", "2026-09-06"),
    # further ones
    ("refunds since November", "2025-11-01", "2026-08-31"),
    ("orders in q3 of 1999?", "1999-07-01", "1999-09-30"),
    ("q2 1850", "1850-04-01", "1850-06-30"),
    ("q1 of the plan", "2026-01-01", "2026-03-31"),
    ("since 3000, or in 2001", "2001-01-01", "2001-12-31"),
    ("in May", "2026-05-01", "2026-05-31"),
    ("the previous  quarter", "2026-04-01", "2026-06-30"),
    ("trailing 90 days", "2026-06-03", "2026-08-31"),
    ("orders last month compared with last year", "2026-07-01", "2026-07-31"),
]


@pytest.mark.parametrize(("question", "start", "end"), CASES)
def test_periods(question, start, end):
    found = resolve(question, AS_OF)
    assert found is not None
    assert (found.start.isoformat(), found.end.isoformat()) == (start, end)


@pytest.mark.parametrize("question", ["how many customers are in Berlin", "the top 10 products by revenue", "in June 1850", "since 1850", "in 1899", "year 3000", "past week", "past month", "past quarter", "past year", "last-month", "last 0 days", "q5", "lastmonth", "12345", "", "last 7", "trailing month", "q2 0000"])
def test_no_period(question):
    assert resolve(question, AS_OF) is None


@pytest.mark.parametrize(
    ("question", "as_of", "start", "end"),
    [("last month", "2024-03-15", "2024-02-01", "2024-02-29"), ("last month", "2026-01-04", "2025-12-01", "2025-12-31"), ("last quarter", "2026-02-01", "2025-10-01", "2025-12-31"), ("last week", "2026-01-01", "2025-12-22", "2025-12-28"), ("in August", "2026-08-01", "2026-08-01", "2026-08-31"), ("in September", "2026-08-01", "2025-09-01", "2025-09-30")],
)
def test_borders_of_the_calendar(question, as_of, start, end):
    found = resolve(question, as_of)
    assert (found.start.isoformat(), found.end.isoformat()) == (start, end)


def test_phrases():
    assert resolve("tickets in the last 7 days please", AS_OF).phrase == "last 7 days"
    assert resolve("q1 of the plan", AS_OF).phrase == "q1"
    assert resolve("refunds in June 2025!", AS_OF).phrase == "in june 2025"


def test_literals():
    july = TimeWindow(date(2026, 7, 1), date(2026, 7, 31), "x")
    assert july.exclusive_end == date(2026, 8, 1)
    assert all(map(july.admits, ("2026-07-01", "2026-07-31", "2026-08-01", "2026-07", "2026")))
    assert not any(map(july.admits, ("2026-06-30", "2026-08-02", "2026-08", "2025", "2026-13", "2026-07-32", "july", "", "2026-7-1", "20260701", "2026-07-01T00:00")))


@given(st.dates(min_value=date(1950, 1, 1), max_value=date(2900, 1, 1)))
def test_units_join_without_a_gap(today):
    for unit in ("week", "month", "quarter", "year"):
        last, this = resolve(f"last {unit}", today), resolve(f"this {unit}", today)
        assert last.exclusive_end == this.start
        assert this.start <= today <= this.end
        assert resolve(f"this {unit}", this.end + timedelta(days=1)).start == this.exclusive_end
