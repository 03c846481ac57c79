"""Parquet table access with explicit column pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, base_dir: str, name: str, *columns: str) -> DataFrame:
    """Read `<base_dir>/<name>.parquet`, selecting only the named columns.

    The projection sits directly on the scan so the Parquet reader only
    decodes those columns; later filters are pushed into the same scan.
    """
    df = spark.read.parquet(f"{base_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df
