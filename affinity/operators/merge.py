"""Idempotent upserts without a transactional table format.

Each function takes the current table and the incoming rows and returns the
new table as a DataFrame; callers write it to a new folder and then switch
readers to it (never overwrite a path being read). Running an upsert twice
with the same input gives the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinity.session import materialize

from affinity.functions.categories import clean_categories
from affinity.operators.joins import update_from


def assign_ids(keys: DataFrame, order: list[Column], start: Column | int = 0,
               id_col: str = "id") -> DataFrame:
    """Dense surrogate ids start+1, start+2, … in the given sort order.

    Distributed: the keys are range-partitioned and sorted, each row gets
    its position inside its partition, and a tiny table of per-partition
    counts (one row per partition) gives each partition's offset. No window
    over all rows, no single task. Partition id and in-partition position are
    written together with the sorted keys first, so positions and offsets
    are read from the same, fixed copy (the same scheme as zipWithIndex).
    """
    s = (keys.repartitionByRange(*order).sortWithinPartitions(*order)
             .withColumn("_pid", F.spark_partition_id())
             .withColumn("_mid", F.monotonically_increasing_id())
             .transform(materialize))
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    start_col = F.lit(start) if isinstance(start, int) else start
    j = s.join(F.broadcast(offsets), "_pid")
    ident = (start_col + F.col("_off") + (F.col("_mid") - F.col("_m0")) + 1).cast("bigint")
    return j.select(*[c for c in keys.columns], ident.alias(id_col))


def rank_within(df: DataFrame, key: str, order: list[Column], rank_col: str = "rank") -> DataFrame:
    """row_number() over (partition by key order by …) without putting a key in one task.

    Same scheme as `assign_ids`, per key: a range-partitioned sort on
    (key, order) spreads even a key holding a large share of the rows over
    many partitions; each row's position inside its partition is written with
    it; per (key, partition) counts — at most one row per partition a key
    spans — give each piece's offset.
    """
    cols = [F.col(key), *order]
    s = (df.repartitionByRange(*cols).sortWithinPartitions(*cols)
           .withColumn("_pid", F.spark_partition_id())
           .withColumn("_mid", F.monotonically_increasing_id())
           .transform(materialize))
    counts = s.groupBy(key, "_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    before = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    j = s.join(offsets, [key, "_pid"])
    rank = (F.col("_off") + (F.col("_mid") - F.col("_m0")) + 1).cast("int")
    return j.select(*df.columns, rank.alias(rank_col))


def _max_id(existing: DataFrame) -> Column:
    return existing.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint")).scalar()


def latest_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: the one with the largest `order` tuple.

    An aggregate (max_by over a struct) with map-side partial aggregation, so
    a key repeated many times is reduced before the shuffle.
    """
    others = [c for c in rows.columns if c != key]
    best = F.max_by(F.struct(*others), F.struct(*order))
    return rows.groupBy(key).agg(best.alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in others])


def upsert_applications(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert new urls; on an existing url overwrite name, followers, retrieved, hash (id kept)."""
    cols = ["url", "name", "followers", "hash", "retrieved"]
    inc = latest_per_key(incoming.select(*cols), "url", ["retrieved", "hash"])
    ex = existing.select("id", *cols)
    # unmatched rows keep their values, so one left join makes all the existing rows
    updated = update_from(ex, inc, "url", ["name", "followers", "hash", "retrieved"])
    # the unseen rows (usually few) are written once; id assignment and the
    # insert read that copy instead of re-running the anti join
    new = materialize(inc.join(ex.select("url"), "url", "left_anti"), "new-applications")
    new_ids = assign_ids(new.select("url"), [F.col("url")], _max_id(existing))
    inserted = new.join(new_ids, "url")
    out = updated.unionByName(inserted.select("id", *cols))
    return out.select("id", *cols)


def upsert_packages(existing: DataFrame, names: DataFrame, retrieved: Column) -> DataFrame:
    """Insert unseen names; seen names only get a new `retrieved`, metadata survives."""
    # read by the update and by the anti join
    inc = materialize(names.select("name").distinct(), "names")
    kept = update_from(existing, inc.withColumn("retrieved", retrieved), "name", ["retrieved"])
    new = materialize(inc.join(existing.select("name"), "name", "left_anti"), "new-packages")
    new_rows = assign_ids(new, [F.col("name")], _max_id(existing)).withColumn("retrieved", retrieved)
    return kept.unionByName(new_rows, allowMissingColumns=True)


def insert_dependencies(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert-ignore on (application_id, package_id)."""
    cols = ["application_id", "package_id"]
    return existing.select(*cols).unionByName(incoming.select(*cols)).dropDuplicates(cols)


METADATA_COLUMNS = ["monthly_downloads_last_month", "monthly_downloads_a_year_ago", "categories", "modified"]


def update_package_metadata(packages: DataFrame, metadata: DataFrame) -> DataFrame:
    """By name, overwrite downloads, cleaned categories and modified — NULLs included."""
    src = metadata.select("name", *[clean_categories("categories").alias(c) if c == "categories"
                                    else F.col(c) for c in METADATA_COLUMNS])
    return update_from(packages, src, "name", METADATA_COLUMNS)
