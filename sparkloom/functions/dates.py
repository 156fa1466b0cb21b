"""Date and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_FORMATS = ("yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "yyyyMMdd")


def month_end(day: Column) -> Column:
    return F.last_day(day)


def quarter_end(day: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(day, "quarter"), 2))


def year_end(day: Column) -> Column:
    return F.make_date(F.year(day), F.lit(12), F.lit(31))


def period_end(day: Column, frequency: Column) -> Column:
    """The last day of the month, quarter or year that holds the day; null for another frequency."""
    return F.when(frequency == "monthly", month_end(day)).when(frequency == "quarterly", quarter_end(day)).when(frequency == "annual", year_end(day))


def month_ends(start: Column, end: Column) -> Column:
    """All month ends from start's to end's, both included; empty if start is after end."""
    first, last = F.trunc(start, "MM"), F.trunc(end, "MM")
    spine = F.transform(F.sequence(F.least(first, last), last, F.expr("interval 1 month")), F.last_day)
    return F.when(first <= last, spine).otherwise(F.array().cast("array<date>"))


def parse_date(text: Column) -> Column:
    """The first of the accepted formats that fits; null if none does."""
    return F.coalesce(*[F.try_to_date(F.trim(text), f) for f in DATE_FORMATS])


def utc_timestamp(text: Column, naive_is_utc: bool = True) -> Column:
    """An ISO timestamp; one without an offset is UTC, or null if that is not allowed."""
    has_zone = F.rlike(text, F.lit(r"(?:Z|[+-]\d\d:?\d\d)$"))
    parsed = F.try_to_timestamp(text)
    return parsed if naive_is_utc else F.when(has_zone, parsed)


def same_day_due(moment: Column) -> Column:
    return F.date_trunc("DAY", moment) + F.expr("interval '23:59:59' hour to second")
