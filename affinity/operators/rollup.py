"""Download windows from rolled-up sums: a new as-of date reads whole months and a few days at their edges.

Two tables are kept: `days` (key, month, day, amount) and `months` (key,
month, amount), both in folders by month. A window is covered by signed
pieces, one per month it touches: a whole month is read from `months`; of a
month covered in part, either the days inside are added, or the days outside
are taken off the month's sum, whichever are fewer. At most 15 days a month are
therefore read from `days`. Amounts are whole numbers, so subtracting is exact.

Both tables are sums, so new days (or corrections, as negative amounts) are
merged by adding (`merge_amounts`), and only the months they touch change.

Odd rows: a null key, day or amount takes no part; a key whose windows are
all zero has no row; empty tables give no rows.
"""

from __future__ import annotations

import calendar
import datetime as dt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOWS = ["last_month", "year_ago"]


class Piece(NamedTuple):
    """A signed part of a window: a whole month, or the days first..last of it."""

    month: int
    sign: int
    first: int | None = None
    last: int | None = None


def back(day: dt.date, months: int) -> dt.date:
    """The day so many whole months earlier, at the end of the month where it doesn't exist (as `dates.month_delta`)."""
    y, m = divmod(day.year * 12 + day.month - 1 - months, 12)
    return dt.date(y, m + 1, min(day.day, calendar.monthrange(y, m + 1)[1]))


def windows_of(as_of: dt.date) -> dict[str, tuple[dt.date, dt.date]]:
    """The inclusive windows of `dates.download_windows` for a known date."""
    return {"last_month": (back(as_of, 1), as_of), "year_ago": (back(as_of, 13), back(as_of, 12))}


def cover(start: dt.date, end: dt.date) -> list[Piece]:
    """The pieces that add up to the inclusive window start..end."""
    pieces = []
    for index in range(start.year * 12 + start.month - 1, end.year * 12 + end.month):
        y, m = index // 12, index % 12 + 1
        month, length = y * 100 + m, calendar.monthrange(y, m)[1]
        lo = start.day if (y, m) == (start.year, start.month) else 1
        hi = end.day if (y, m) == (end.year, end.month) else length
        if 2 * (hi - lo + 1) <= length:
            pieces.append(Piece(month, 1, lo, hi))
            continue
        pieces.append(Piece(month, 1))
        if lo > 1:
            pieces.append(Piece(month, -1, 1, lo - 1))
        if hi < length:
            pieces.append(Piece(month, -1, hi + 1, length))
    return pieces


def daily(events: DataFrame, key: str, time: str, amount: str) -> DataFrame:
    """(key, month, day, amount): one sum per key and day."""
    known = events.where(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(amount).isNotNull())
    return (known.groupBy(F.col(key).alias("key"), (F.year(time) * 100 + F.month(time)).alias("month"),
                          F.dayofmonth(time).alias("day"))
                 .agg(F.sum(F.col(amount).cast("bigint")).alias("amount")))


def monthly(days: DataFrame) -> DataFrame:
    """(key, month, amount) of the daily sums."""
    return days.groupBy("key", "month").agg(F.sum("amount").alias("amount"))


def merge_amounts(stored: DataFrame, more: DataFrame) -> DataFrame:
    """Two tables of the same kind added up; sums that come to zero go.

    Pass the stored rows of the months that `more` touches to rewrite only
    those folders.
    """
    by = [c for c in stored.columns if c != "amount"]
    total = stored.unionByName(more).groupBy(*by).agg(F.sum("amount").alias("amount"))
    return total.where(F.col("amount") != 0)


def store(df: DataFrame, path: str) -> DataFrame:
    """Write `days` or `months` to a new folder, in folders by month, and read it back.

    Rows are placed by month and key, so that a month of any size spreads over
    tasks; days are sorted, so that a range of days skips row groups.
    """
    order = ["month", *([c] if (c := "day") in df.columns else []), "key"]
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.write.mode("errorifexists").partitionBy("month").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)   # an empty table leaves no file to infer from


def _parts(pieces: list[tuple[dt.date, str, Piece]]) -> Column:
    return F.array(*[F.struct(F.lit(d).alias("as_of"), F.lit(w).alias("window"), F.lit(p.sign).alias("sign"),
                              F.lit(p.month).alias("month"), F.lit(p.first or 0).alias("first"),
                              F.lit(p.last or 0).alias("last")) for d, w, p in pieces])


def _signed(table: DataFrame, pieces: list[tuple[dt.date, str, Piece]], is_day: bool) -> DataFrame:
    """(as_of, window, key, amount): the table's rows of these pieces, with their sign.

    The filter is made of literals: it prunes folders and is pushed to the scan.
    """
    wanted = F.lit(False)
    for month in sorted({p.month for _, _, p in pieces}):
        here = F.col("month") == month
        if is_day:
            spans = {(p.first, p.last) for _, _, p in pieces if p.month == month}
            inside = F.lit(False)
            for lo, hi in sorted(spans):
                inside = inside | F.col("day").between(lo, hi)
            here = here & inside
        wanted = wanted | here

    def holds(p: Column) -> Column:
        same = p["month"] == F.col("month")
        return same & F.col("day").between(p["first"], p["last"]) if is_day else same

    if not pieces:
        wanted, found = F.lit(False), F.explode(F.array(F.struct(
            F.lit(None).cast("date").alias("as_of"), F.lit("").alias("window"), F.lit(0).alias("sign"))))
    else:
        found = F.explode(F.filter(_parts(pieces), holds))
    rows = table.where(F.col("month").isin(sorted({p.month for _, _, p in pieces}))).where(wanted)
    return (rows.select("key", "amount", found.alias("p"))
                .select("p.as_of", "p.window", "key", (F.col("p.sign") * F.col("amount")).alias("amount")))


def window_downloads(days: DataFrame, months: DataFrame, as_of: list[dt.date]) -> DataFrame:
    """(as_of, key, last_month, year_ago) of every as-of date, from the rolled-up tables.

    One pass over each table, reading only the folders of the windows' months
    and only the edge days of `days`; one shuffle of sums combined before it.
    The dates are a short list (each adds up to ten pieces to the plan).
    """
    pieces = [(d, name, p) for d in dict.fromkeys(as_of) for name, (lo, hi) in windows_of(d).items() for p in cover(lo, hi)]
    whole = [x for x in pieces if x[2].first is None]
    edges = [x for x in pieces if x[2].first is not None]
    rows = _signed(months, whole, False).unionByName(_signed(days, edges, True))
    sums = rows.groupBy("as_of", "key").agg(
        *[F.sum(F.when(F.col("window") == w, F.col("amount")).otherwise(0)).alias(w) for w in WINDOWS])
    return sums.where(" OR ".join(f"{w} != 0" for w in WINDOWS))
