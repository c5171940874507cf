"""Calendar expressions."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def monday(day: Column) -> Column:
    """The Monday of a date's week."""
    return F.date_sub(day, F.weekday(day))


def weekday_name(day: Column) -> Column:
    return F.date_format(day, "EEEE")


def window_start(as_of: Column, days: int) -> Column:
    """First day of a trailing window of so many days that ends with, and includes, as_of."""
    return F.date_sub(as_of, days - 1)


def month_ends(first: str, last: str) -> list[datetime.date]:
    """Last days of the months from first's to last's."""
    at, end, found = datetime.date.fromisoformat(first), datetime.date.fromisoformat(last), []
    year, month = at.year, at.month
    while (year, month) <= (end.year, end.month):
        year, month = (year + 1, 1) if month == 12 else (year, month + 1)
        found.append(datetime.date(year, month, 1) - datetime.timedelta(days=1))
    return found


def strict_date(text: Column) -> Column:
    """The date of a text of the form 2024-01-31, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
