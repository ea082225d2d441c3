"""Calendar helpers. The day of reference is always an argument, never the clock."""

import datetime as dt

from pyspark.sql import functions as F


def as_date(value):
    return dt.date.fromisoformat(value) if isinstance(value, str) else value


def month_range(year, month):
    """First and last day of a calendar month.

    Comparing a date with a range lets Parquet statistics and month partitions
    skip data, which comparing year() and month() does not.
    """
    following = dt.date(year + month // 12, month % 12 + 1, 1)
    return dt.date(year, month, 1), following - dt.timedelta(days=1)


def forecast_windows(as_of, lookback):
    """Date ranges of the forecast: recent months, last year's month, this month.

    The recent window steps back in units of 30 days and then to the first of
    the month, so around short months it may take in one month more.
    """
    as_of = as_date(as_of)
    this_month = as_of.replace(day=1)
    recent_start = (this_month - dt.timedelta(days=30 * lookback)).replace(day=1)
    return {
        "recent": (recent_start, this_month - dt.timedelta(days=1)),
        "last_year": month_range(as_of.year - 1, as_of.month),
        "current": month_range(as_of.year, as_of.month),
    }


def months_between(start, end):
    """Number of calendar months touched by an inclusive range."""
    return (end.year - start.year) * 12 + end.month - start.month + 1


def year_month(col):
    return F.date_format(col, "yyyy-MM")
