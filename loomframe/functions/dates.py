"""Date and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The parts and the functions that take them.
DATE_PARTS = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "quarter": F.quarter,
    "day_of_week": F.dayofweek,
    "day_of_year": F.dayofyear,
    "week_of_year": F.weekofyear,
}
TIME_PARTS = {"hour": F.hour, "minute": F.minute, "second": F.second}
SECONDS = {"hours": 3600, "minutes": 60, "seconds": 1}
UNITS = ("days", "months", "years", "hours", "minutes", "seconds")


def first_parsed(c: Column, formats: list[str]) -> Column:
    """The date by the first format that fits the text, else null."""
    return F.coalesce(*(F.try_to_date(c, f) for f in formats))


def elapsed(start: Column, end: Column, unit: str, whole: str = "truncate") -> Column:
    """Units from ``start`` to ``end``: calendar days, whole months or years, whole hours, minutes or seconds.

    Months and years go to 0 (``truncate``) or down (``floor``); the shorter units always go to 0.
    """
    if unit == "days":
        return F.datediff(end, start)
    if unit in ("months", "years"):
        span = F.months_between(end, start) / (12 if unit == "years" else 1)
        return (F.floor(span) if whole == "floor" else span).cast("int")
    seconds = F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))
    return (seconds / SECONDS[unit]).cast("long")


def iso_weekday(c: Column) -> Column:
    """1 for Monday to 7 for Sunday."""
    return F.weekday(c) + 1


def plus_business_days(c: Column, n: int, weekend_start: str = "roll") -> Column:
    """``n`` Mondays to Fridays later, or earlier where n is negative.

    A start on a weekend first goes back to Friday (n > 0) or on to Monday (n < 0); with
    ``weekend_start="reference"`` it counts from the day itself, and days that cross the week's end
    add two.
    """
    if not n:
        return c if weekend_start == "roll" else F.when(iso_weekday(c) > 5, F.date_add(c, 2)).otherwise(c)
    if weekend_start == "roll":
        day = iso_weekday(c)
        c = F.when(day <= 5, c).otherwise(F.date_sub(c, day - 5) if n > 0 else F.date_add(c, 8 - day))
    weeks, rest = divmod(abs(n), 5)
    day = iso_weekday(c)
    crosses = (day + rest > 5) if n > 0 else (day - rest < 1)
    days = F.lit(7 * weeks + rest) + F.when(crosses, 2).otherwise(0)
    return F.date_add(c, days) if n > 0 else F.date_sub(c, days)


def fiscal_year(c: Column, first_month: int) -> Column:
    """The calendar year in which the fiscal year of a date ends."""
    return F.year(c) if first_month == 1 else F.year(c) + F.when(F.month(c) >= first_month, 1).otherwise(0)


def day_period(c: Column) -> Column:
    """morning from 6, afternoon from 12, evening from 17, night from 21; null for null."""
    h = F.hour(c)
    return F.when(h.between(6, 11), "morning").when(h.between(12, 16), "afternoon").when(h.between(17, 20), "evening").when(h.isNotNull(), "night")
