"""The metadata refresh: package names → landed registry bodies → updated package table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.functions.purl import PYPI
from affinity.operators import merge
from affinity.sources import landed


def landed_metadata(spark: SparkSession, packages: DataFrame, paths: dict[str, str]) -> DataFrame:
    """(name, downloads, categories, modified timestamp) of both ecosystems' landed bodies.

    Every PyPI package was asked for, so one whose lookup failed gets NULLs;
    an npm package without a packument is not in the result. A `modified`
    that is not a timestamp gives NULL.
    """
    r = spark.read
    npm = landed.npm_metadata(r.schema(landed.NPM_BODY).json(paths["npm_packuments"]),
                              r.schema(landed.DOWNLOADS_BODY).json(paths["npm_last_month"]),
                              r.schema(landed.DOWNLOADS_BODY).json(paths["npm_year_ago"]))
    asked = packages.where(F.col("name").startswith(f"pkg:{PYPI}/")).select(F.col("name").alias("package"))
    pypi = landed.pypi_metadata(r.schema(landed.PYPI_STATS_BODY).json(paths["pypi_stats"]),
                                r.schema(landed.PYPI_JSON_BODY).json(paths["pypi_projects"]), asked)
    return (npm.unionByName(pypi).withColumnRenamed("package", "name")
               .withColumn("modified", F.try_to_timestamp("modified")))


def refresh_metadata(spark: SparkSession, packages: DataFrame, paths: dict[str, str]) -> DataFrame:
    """`packages` with downloads, categories and modified overwritten by the landed bodies, by name."""
    return merge.update_package_metadata(packages, landed_metadata(spark, packages, paths))
