"""Package scores: popularity, trends, bounded buckets and display columns.

The reference refreshes these with a dozen UPDATE statements; here the whole
refresh is one projection over packages left-joined with popularity, with
the global bounds as merged scalar sub-queries (one aggregate job, no join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.functions import dates, purl, scoring
from affinity.sources.landed import MIRRORED

DOWNLOAD_COLUMNS = ["monthly_downloads_last_month", "monthly_downloads_a_year_ago"]


def fill_null_downloads(packages: DataFrame) -> DataFrame:
    """NULL download counts become 0."""
    return packages.fillna(0, subset=DOWNLOAD_COLUMNS)


def popularity(similarity: DataFrame) -> DataFrame:
    """(package_b, popularity): number of mirrored rows per package = its neighbours.

    A table that is marked as mirrored is counted by package_a, whose rows are
    together, so that a task sends one row a package instead of one a pair.
    """
    marked = "package_a" in similarity.columns and similarity.schema["package_a"].metadata.get(MIRRORED)
    key = "package_a" if marked else "package_b"
    return similarity.groupBy(F.col(key).alias("package_b")).agg(F.count(F.lit(1)).alias("popularity"))


def with_popularity(packages: DataFrame, similarity: DataFrame) -> DataFrame:
    """Recomputed from scratch: packages without neighbours get 0."""
    pop = popularity(similarity)
    j = packages.join(pop, packages["id"] == pop["package_b"], "left")
    return j.select(*[packages[c] for c in packages.columns if c != "popularity"],
                    F.coalesce(pop["popularity"], F.lit(0)).cast("bigint").alias("popularity"))


def bounded_popularity(df: DataFrame) -> DataFrame:
    lp = scoring.log_popularity("popularity")
    hi = df.agg(F.max(lp)).scalar()
    return df.withColumn("bounded_popularity", scoring.bucket(lp, F.lit(0.0), hi))


def trends(df: DataFrame) -> DataFrame:
    """absolute_trend and relative_trend: buckets between the global min and max."""
    last, ago = DOWNLOAD_COLUMNS
    at = scoring.absolute_trend_value(last, ago)
    rt = scoring.relative_trend_value(last, ago)
    bounds = df.agg(F.min(at).alias("at_lo"), F.max(at).alias("at_hi"),
                    F.min(rt).alias("rt_lo"), F.max(rt).alias("rt_hi"))
    at_lo, at_hi, rt_lo, rt_hi = (bounds.select(c).scalar() for c in bounds.columns)
    return (df.withColumn("absolute_trend", scoring.bucket(at, at_lo, at_hi))
              .withColumn("relative_trend", scoring.bucket(rt, rt_lo, rt_hi)))


def display_columns(df: DataFrame) -> DataFrame:
    """short_name, url (npm / pypi pages) and display_date."""
    return (df.withColumn("short_name", purl.short_name("name"))
              .withColumn("url", purl.package_url("name"))
              .withColumn("display_date", dates.display_date("modified")))


def score_packages(packages: DataFrame, similarity: DataFrame) -> DataFrame:
    """The whole package refresh: fill downloads, popularity, buckets, trends, display."""
    p = fill_null_downloads(packages)
    p = with_popularity(p, similarity)
    p = bounded_popularity(p)
    p = trends(p)
    return display_columns(p)
