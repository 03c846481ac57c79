"""Score expressions: equal-width buckets, log trends and the composite score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for right results.
BUCKETS = 9                      # width_bucket(x, lo, hi, 9) → 0..10
SIMILARITY_RANGE = (0.0, 1.0)
# composite = ceil(ceil(10*similarity)*0.5 + popularity*0.3 + absolute*0.1 + relative*0.1)
COMPOSITE_SQL = (
    "CAST(CEIL(CAST(CEIL(10 * {s}) AS DOUBLE) * CAST(0.5 AS DOUBLE)"
    " + CAST({bp} * 0.3 AS DOUBLE)"
    " + CAST({at} * 0.1 AS DOUBLE)"
    " + CAST({rt} * 0.1 AS DOUBLE)) AS INT)"
)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def bucket(x, lo, hi, n: int = BUCKETS) -> Column:
    """Equal-width bucket as INT: 0 below lo, n+1 at or above hi, NULL when lo = hi."""
    return F.width_bucket(_c(x), _c(lo), _c(hi), F.lit(n)).cast("int")


def bounded_similarity(similarity) -> Column:
    lo, hi = SIMILARITY_RANGE
    return bucket(similarity, F.lit(lo), F.lit(hi))


def log_popularity(popularity) -> Column:
    """Base-10 log, as the reference's SQL `LOG` is."""
    return F.log10(_c(popularity) + F.lit(1))


def absolute_trend_value(last_month, year_ago) -> Column:
    return F.log10(_c(last_month) + F.lit(1)) - F.log10(_c(year_ago) + F.lit(1))


def relative_trend_value(last_month, year_ago) -> Column:
    return F.log10(_c(last_month) + F.lit(1)) / (F.log10(_c(year_ago) + F.lit(1)) + F.lit(1))


def composite_score(similarity: str, bounded_popularity: str, absolute_trend: str,
                    relative_trend: str) -> Column:
    """The recommendation score, evaluated in the written order with doubles.

    The 0.3/0.1 products are exact decimals cast to double before the sum, so
    Spark and an SQL oracle add the same four doubles.
    """
    return F.expr(COMPOSITE_SQL.format(s=similarity, bp=bounded_popularity,
                                       at=absolute_trend, rt=relative_trend))
