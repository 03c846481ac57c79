"""Date helpers: month shifts, download windows, display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def month_delta(date, months_back) -> Column:
    """Shift back whole months, clamping the day to the end of the target month."""
    n = F.lit(months_back) if isinstance(months_back, int) else _c(months_back)
    return F.add_months(_c(date), -n)


def download_windows(as_of) -> dict[str, tuple[Column, Column]]:
    """Inclusive date windows: the last month, and the same month a year ago."""
    d = F.to_date(_c(as_of))
    return {
        "last_month": (month_delta(d, 1), d),
        "year_ago": (month_delta(d, 13), month_delta(d, 12)),
    }


def display_date(ts) -> Column:
    """`yyyy-MM-dd` of a timestamp; NULL stays NULL."""
    return F.date_format(_c(ts), "yyyy-MM-dd")


def repo_date(iso_text) -> Column:
    """Date part of an ISO-8601 text such as `2020-03-16T13:03:34Z`."""
    return F.split(_c(iso_text), "T").getItem(0)
