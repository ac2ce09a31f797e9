"""Calendar functions: ranges, periods, anniversaries."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_range(now: datetime, offset: int) -> tuple[datetime, datetime]:
    start = datetime(now.year, now.month, now.day) + timedelta(days=offset)
    return start, start + timedelta(days=1)


def week_range(now: datetime, offset: int, first_weekday: int = 0) -> tuple[datetime, datetime]:
    """first_weekday: 0 for Monday to 6 for Sunday."""
    today = datetime(now.year, now.month, now.day)
    start = today - timedelta(days=(today.weekday() - first_weekday) % 7) + timedelta(weeks=offset)
    return start, start + timedelta(weeks=1)


def month_range(now: datetime, offset: int) -> tuple[datetime, datetime]:
    k = now.year * 12 + now.month - 1 + offset
    return datetime(k // 12, k % 12 + 1, 1), datetime((k + 1) // 12, (k + 1) % 12 + 1, 1)


def year_range(now: datetime, offset: int) -> tuple[datetime, datetime]:
    return datetime(now.year + offset, 1, 1), datetime(now.year + offset + 1, 1, 1)


def rolling_range(now: datetime, days: int) -> tuple[datetime, datetime]:
    return now - timedelta(days=days), now


def season_range(year: int, season: str) -> tuple[datetime, datetime]:
    """Meteorological seasons; winter is from this December to next March."""
    first = {"spring": 3, "summer": 6, "autumn": 9, "winter": 12}[season]
    return datetime(year, first, 1), datetime(year + (first == 12), 3 if first == 12 else first + 3, 1)


def period(at: Column, grain: str) -> tuple[Column, Column]:
    """[start, end) of the year, month or day that holds at."""
    start = F.date_trunc(grain, at)
    step = {"year": F.make_interval(years=F.lit(1)), "month": F.make_interval(months=F.lit(1)), "day": F.make_interval(days=F.lit(1))}[grain]
    return start, start + step


def days_until_next(date: Column, today: Column) -> Column:
    """Days to the next anniversary, 0 on the day; 29 February counts as the 28th in other years."""

    def on(year: Column) -> Column:
        first = F.make_date(year, F.month(date), F.lit(1))
        return F.date_add(first, F.least(F.dayofmonth(date), F.dayofmonth(F.last_day(first))) - 1)

    this = on(F.year(today))
    return F.datediff(F.when(this >= today, this).otherwise(on(F.year(today) + 1)), today)


def month_grid(date: Column, first_weekday: int = 1) -> tuple[Column, Column]:
    """(blank cells before the first day, days in the month) of the month's calendar page; 1 is Sunday."""
    first = F.trunc(date, "month")
    return F.pmod(F.dayofweek(first) - first_weekday, F.lit(7)), F.dayofmonth(F.last_day(date))


def on_this_day(at: Column, today: Column) -> Column:
    return (F.month(at) == F.month(today)) & (F.dayofmonth(at) == F.dayofmonth(today)) & (F.year(at) < F.year(today))
