"""Relative periods in a question, as date ranges.

Periods are counted from a committed day (``as_of``), never from the clock.  A
question is read word by word; the first word that begins a period phrase decides.

Calendar units are whole numbers: a day's week, month, quarter or year is its
index on that unit's axis, so "previous" is one less and a period runs from the
first day of its index to the day before the next one's.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of period phrases, and the years that a question can name.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
UNITS = {"week": 0, "month": 1, "quarter": 3, "year": 12}  # months in each; a week is no number of months
STEPS = {"last": -1, "previous": -1, "this": 0}
COUNTING = {"last", "past", "previous", "trailing"}
DURING = {"in", "during", "for"}
YEARS = range(1900, 3000)

_WEEK_ZERO = date(1, 1, 1)  # a Monday


@dataclass(frozen=True)
class TimeWindow:
    start: date
    end: date  #: inclusive
    phrase: str

    @property
    def exclusive_end(self) -> date:
        return self.end + timedelta(days=1)

    def contains(self, column: str | Column) -> Column:
        """The predicate; scans can push both bounds down."""
        c = F.col(column) if isinstance(column, str) else column
        return (c >= F.lit(self.start.isoformat()).cast("timestamp_ntz")) & (c < F.lit(self.exclusive_end.isoformat()).cast("timestamp_ntz"))

    def admits(self, literal: str) -> bool:
        """Whether a literal (YYYY, YYYY-MM or YYYY-MM-DD) can stand in a predicate for this period.

        A year or month does if it meets the period; a day, inside it or right
        behind it.  Anything else does not.
        """
        if not re.fullmatch(r"[0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?", literal):
            return False
        parts = [int(p) for p in literal.split("-")]
        try:
            if len(parts) == 3:
                return self.start <= date(*parts) <= self.exclusive_end
            unit, index = ("year", parts[0]) if len(parts) == 1 else ("month", _month_index(*parts))
            return _index(unit, self.start) <= index <= _index(unit, self.end)
        except ValueError:
            return False  # no day or month of the calendar


def _month_index(year: int, month: int) -> int:
    if not 1 <= month <= 12:
        raise ValueError(f"no month {month}")
    return 12 * year + month - 1


def _index(unit: str, day: date) -> int:
    """Which week, month, quarter or year a day is in."""
    if unit == "week":
        return (day - _WEEK_ZERO).days // 7
    return _month_index(day.year, day.month) // UNITS[unit]


def _first_day(unit: str, index: int) -> date:
    if unit == "week":
        return _WEEK_ZERO + timedelta(weeks=index)
    year, month = divmod(index * UNITS[unit], 12)
    return date(year, month + 1, 1)


def _period(unit: str, index: int) -> tuple[date, date]:
    return _first_day(unit, index), _first_day(unit, index + 1) - timedelta(days=1)


class _Phrase:
    """The words from one place on, as long as only blanks stand between them; ``taken`` counts those read."""

    def __init__(self, words: list[str], today: date) -> None:
        self.words, self.today, self.taken = words, today, 0

    def take(self, accepted) -> str | None:
        """The next word, if it is accepted."""
        word = self.words[self.taken] if self.taken < len(self.words) else None
        if word is None or not accepted(word):
            return None
        self.taken += 1
        return word

    def year(self) -> int | None:
        """A year of four digits; None if there is none, 0 if it lies outside of ``YEARS``."""
        word = self.take(re.compile(r"[0-9]{4}\Z").match)
        return None if word is None else int(word) if int(word) in YEARS else 0

    def month(self) -> int | None:
        """The index of a named month: of its year, or without one the latest that has begun."""
        name = self.take(lambda w: any(w in (m, m[:3]) for m in MONTHS))
        if name is None:
            return None
        month = 1 + next(k for k, m in enumerate(MONTHS) if m.startswith(name[:3]))
        year = self.year()
        if year is None:
            now = _index("month", self.today)
            return now - (now - _month_index(self.today.year, month)) % 12
        return _month_index(year, month) if year else None

    def read(self) -> tuple[date, date] | None:
        """The period that the words name from the first one on."""
        today = self.today
        first = self.take(lambda w: True)
        if first in ("today", "yesterday"):
            day = today - timedelta(days=first == "yesterday")
            return day, day
        if first in COUNTING and (n := self.take(re.compile(r"[0-9]{1,4}\Z").match)):
            return (today - timedelta(days=int(n) - 1), today) if int(n) and self.take({"day", "days"}.__contains__) else None
        if first in STEPS and (unit := self.take(UNITS.__contains__)):
            return _period(unit, _index(unit, today) + STEPS[first])
        if re.fullmatch("q[1-4]", first):
            return self.quarter(int(first[1]))
        if first == "since":
            year = self.year()
            begin = _first_day("year", year) if year else None
            if year is None and (month := self.month()) is not None:
                begin = _first_day("month", month)
            return (begin, today) if begin is not None and begin <= today else None
        if first in DURING:
            month = self.month()
            return None if month is None else _period("month", month)
        if re.fullmatch("[0-9]{4}", first) and int(first) in YEARS:
            return _period("year", int(first))
        return None

    def quarter(self, number: int) -> tuple[date, date] | None:
        """A quarter by number, with or without its year (any of four digits)."""
        before = self.taken
        self.take({"of"}.__contains__)
        year = self.take(re.compile(r"[0-9]{4}\Z").match)
        if year is None:
            self.taken = before  # "of" belongs to something else
        of = self.today.year if year is None else int(year)
        return _period("quarter", 4 * of + number - 1) if 1 <= of < 9999 else None


def resolve(question: str, as_of: str | date) -> TimeWindow | None:
    """The first period that a question names, or None."""
    today = date.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    text = question.lower()
    words = list(re.finditer(r"\w+", text))
    stop = len(words)  # where the run of words that only blanks part ends
    runs = [0] * len(words)
    for k in range(len(words) - 1, -1, -1):
        if k + 1 < len(words) and not text[words[k].end() : words[k + 1].start()].isspace():
            stop = k + 1
        runs[k] = stop
    for k, word in enumerate(words):
        phrase = _Phrase([w[0] for w in words[k : min(runs[k], k + 4)]], today)  # no phrase has more words
        found = phrase.read()
        if found is not None:
            return TimeWindow(*found, text[word.start() : words[k + phrase.taken - 1].end()])
    return None
