"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.session import apply_defaults

# Rows per Arrow batch handed to Python. Texts can be long, so batches stay
# small enough that a worker holds a few megabytes at a time.
ARROW_ROWS = 256


def prepare(spark: SparkSession) -> None:
    """Session settings the operators rely on (they never change a result).

    Python workers look for this package where the driver found it, unless
    it was shipped to them (`--py-files`).
    """
    apply_defaults(spark)
    # filter scans of any size by the keys of a selective join side; the filter's bits are bounded by Spark
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.enabled", "true")
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold", "1g")
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What a Python worker keeps between its tasks: one table at a time, the last asked for.

    Workers serve one stage after another; the tables of an earlier stage
    go before the next one makes its own.
    """
    if key not in _KEPT:
        _KEPT.clear()
        give_back()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Give back what an earlier stage has left in this worker. Tasks that keep nothing call it when they start."""
    if _KEPT:
        _KEPT.clear()
        give_back()


def give_back() -> None:
    """Free memory goes back to the system: also what arrays and batches of earlier tasks have left in the allocators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):           # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fresh(name: str, taken: list[str]) -> str:
    """A column name that a table does not have yet."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
