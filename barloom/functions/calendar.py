"""A rule-based exchange calendar: holidays, early closes, session windows.

All dates come from rules, so a calendar for any span is made on the driver
(a few rows a year) and joined as a small dimension.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timedelta

from pyspark.sql import DataFrame, SparkSession


#: Full-day closures of the exchange that no rule gives.
CLOSURES = frozenset({
    date(2001, 9, 11), date(2001, 9, 12), date(2001, 9, 13), date(2001, 9, 14), date(2004, 6, 11), date(2007, 1, 2),
    date(2012, 10, 29), date(2012, 10, 30), date(2018, 12, 5), date(2025, 1, 9),
})


def easter(year: int) -> date:
    """Easter Sunday by the published Gregorian computus (golden number,
    century corrections, paschal full moon)."""
    century, gold = year // 100, year % 19
    moon = (century - century // 4 - (8 * century + 13) // 25 + 19 * gold + 15) % 30
    moon -= (moon // 28) * (1 - (moon // 28) * (29 // (moon + 1)) * ((21 - gold) // 11))
    day = (year + year // 4 + moon + 2 - century + century // 4) % 7
    offset = moon - day
    month = 3 + (offset + 40) // 44
    return date(year, month, offset + 28 - 31 * (month // 4))


def nth_weekday(year: int, month: int, weekday: int, n: int) -> date:
    """The n-th weekday (Monday 0) of a month; n = -1 is the last one."""
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = date(year + month // 12, month % 12 + 1, 1) - timedelta(1)
    return last - timedelta((last.weekday() - weekday) % 7)


def observed(day: date) -> date | None:
    """Saturday holidays move to Friday (not across the year), Sunday ones to Monday."""
    if day.weekday() == 5:
        return None if (day.month, day.day) == (1, 1) else day - timedelta(1)
    return day + timedelta(1) if day.weekday() == 6 else day


def holidays(year: int) -> set[date]:
    fixed = [date(year, 1, 1), date(year, 7, 4), date(year, 12, 25)] + ([date(year, 6, 19)] if year >= 2022 else [])
    moving = [nth_weekday(year, 1, 0, 3), nth_weekday(year, 2, 0, 3), easter(year) - timedelta(2), nth_weekday(year, 5, 0, -1), nth_weekday(year, 9, 0, 1), nth_weekday(year, 11, 3, 4)]
    return {d for d in map(observed, fixed) if d} | set(moving)


def early_closes(year: int) -> set[date]:
    """Days that close at 13:00: before Independence Day, after Thanksgiving,
    Christmas Eve, if they are trading days."""
    days = {date(year, 7, 3), nth_weekday(year, 11, 3, 4) + timedelta(1), date(year, 12, 24)}
    return {d for d in days if d.weekday() < 5 and d not in holidays(year)}


@dataclass(frozen=True)
class Calendar:
    """Sessions of a market. ``always_open``: every day trades (test data).
    ``closed`` holds one-off closures, by default those that are known."""

    premarket: time = time(4, 0)
    regular: time = time(9, 30)
    close: time = time(16, 0)
    aftermarket_end: time = time(20, 0)
    early_close: time = time(13, 0)
    always_open: bool = False
    closed: frozenset[date] = CLOSURES

    def is_session(self, day: date) -> bool:
        return self.always_open or (day.weekday() < 5 and day not in holidays(day.year) and day not in self.closed)

    def sessions(self, first: date, last: date) -> list[date]:
        return [d for k in range((last - first).days + 1) if self.is_session(d := first + timedelta(k))]

    def next_session(self, day: date, strictly_after: bool = False, search: int = 14) -> date:
        for k in range(int(strictly_after), search + 1):
            if self.is_session(day + timedelta(k)):
                return day + timedelta(k)
        raise ValueError(f"no session within {search} days of {day}")

    def windows(self, day: date) -> list[tuple[str, datetime, datetime, date, int]]:
        """``session, start, end, trading_date, priority`` of a trading day, in
        wall time, half-open. After an early close the aftermarket keeps its length."""
        at = lambda t, d=day: datetime.combine(d, t)
        close, after = at(self.close), at(self.aftermarket_end)
        if not self.always_open and day in early_closes(day.year):
            after = at(self.early_close) + (after - close)
            close = at(self.early_close)
        evening = at(self.aftermarket_end, day - timedelta(1))
        return [("premarket", at(self.premarket), at(self.regular), day, 0), ("regular", at(self.regular), close, day, 1), ("aftermarket", close, after, day, 2), ("overnight", evening, at(self.premarket), day, 3)]

    def session_windows(self, spark: SparkSession, first: date, last: date) -> DataFrame:
        rows = [w for d in self.sessions(first, last) for w in self.windows(d)]
        return spark.createDataFrame(rows, "session string, start timestamp_ntz, end timestamp_ntz, trading_date date, priority int")
