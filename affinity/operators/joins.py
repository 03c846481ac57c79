"""Join helpers: size-checked broadcast and update-from-join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, BinaryType, StringType

# Largest side, in rows and in bytes, ever shipped to every executor. A side is
# broadcast only after measuring it (on materialized data) below both bounds;
# beyond them the join falls back to a shuffle join, which AQE may still split
# for skew.
MAX_BROADCAST_ROWS = 2_000_000
MAX_BROADCAST_BYTES = 128 << 20


def _row_bytes(df: DataFrame) -> Column:
    """Bytes of a row in Spark's row format: eight a field, and what variable fields hold."""
    def held(field) -> Column:
        kind, c = field.dataType, F.col(f"`{field.name}`")
        if isinstance(kind, (StringType, BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0))
        if isinstance(kind, AtomicType):
            return F.lit(0)
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))   # nested values: their text is an estimate
    return reduce(lambda a, b: a + b, (held(f) for f in df.schema.fields), F.lit(8 + 8 * len(df.columns))).cast("long")


def measure(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of a frame, in one aggregate without a shuffle of rows."""
    r = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(_row_bytes(df)), F.lit(0)).alias("bytes")).first()
    return r.rows, r.bytes


def checked_broadcast_with_count(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS,
                                 max_bytes: int = MAX_BROADCAST_BYTES) -> tuple[DataFrame, int]:
    """`broadcast(df)` when df is within both bounds, else df unchanged; and its number of rows.

    Measuring is an action; callers pass small or already materialized frames.
    """
    rows, size = measure(df)
    return (F.broadcast(df) if rows <= max_rows and size <= max_bytes else df), rows


def checked_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    return checked_broadcast_with_count(df, max_rows, max_bytes)[0]


def update_from(target: DataFrame, source: DataFrame, key: str, columns: list[str],
                source_key: str | None = None) -> DataFrame:
    """`UPDATE target SET c = s.c FROM source s WHERE target.key = s.key`.

    Matched rows take the source value even when it is NULL; unmatched rows
    keep theirs. `source` must be unique on its key.
    """
    sk = source_key or key
    s = source.select(F.col(sk).alias("__k"), F.lit(True).alias("__matched"),
                      *[F.col(c).alias(f"__s_{c}") for c in columns])
    j = target.join(s, target[key] == s["__k"], "left")
    out = []
    for name in target.columns:
        if name in columns:
            out.append(F.when(F.col("__matched"), F.col(f"__s_{name}"))
                        .otherwise(target[name]).alias(name))
        else:
            out.append(target[name])
    return j.select(*out)

