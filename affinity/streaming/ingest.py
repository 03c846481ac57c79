"""Incremental ingest of landed search pages with Structured Streaming.

New page files in a landing folder are picked up by the file source; each
micro-batch is merged into the applications, packages and dependencies
tables by the idempotent upserts. Every batch, of whatever language and
stream, becomes the next version of all three tables under one root; readers
take the newest committed version (`affinity.sources.versions`), so the three
tables always belong together. The marker names the stream and its batch: a
replayed batch that was committed is skipped, one that was not is written
again.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity import schemas
from affinity.operators import constraints
from affinity.plans import ingest
from affinity.session import checkpoint_dir
from affinity.sources import versions

# `retrieved` is the caller's own as-of time, not landed data, so a batch isn't judged by it.
RULES = {r.table: replace(r, required=tuple(c for c in r.required if c != "retrieved"))
         for r in (constraints.APPLICATIONS, constraints.PACKAGES, constraints.DEPENDENCIES)}
TABLES = {"applications": schemas.APPLICATIONS, "packages": schemas.PACKAGES,
          "dependencies": schemas.DEPENDENCIES}


def read_version(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table's newest committed version, or an empty table."""
    version = versions.newest(spark, root)
    if version is None:
        return spark.createDataFrame([], TABLES[table])
    return spark.read.parquet(versions.path(root, version, table))


def merge_batch(spark: SparkSession, root: str, language: str, as_of_col=None):
    """The foreachBatch function for one language's landed pages."""
    def run(pages: DataFrame, batch_id: int) -> None:
        # the id of a stream stays the same for all runs on its checkpoint
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        label = f"{language}.{stream}.{batch_id}"
        if label in versions.commits(spark, root).values():
            return
        version = versions.following(spark, root)

        def settle(table: str, df: DataFrame) -> DataFrame:
            fields = TABLES[table].fields
            out = df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
                              for f in fields])
            path = versions.path(root, version, table)
            # what a crash left of this number is replaced; rows that break a rule stop the version
            return constraints.write_checked(out, path, RULES[table], mode="overwrite")

        as_of = as_of_col if as_of_col is not None else F.current_timestamp()
        ingest.ingest_pages(pages, language, as_of, *(read_version(spark, root, t) for t in TABLES), settle=settle)
        versions.commit(spark, root, version, label)
    return run


def start_ingest(spark: SparkSession, landing: str, root: str, language: str,
                 checkpoint_location: str | None = None, files_per_batch: int | None = None,
                 as_of_col=None):
    """Start the stream; with the default trigger it processes what has landed and stops."""
    reader = spark.readStream.schema(schemas.SEARCH_PAGE)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    pages = reader.json(landing)
    ckpt = checkpoint_location or f"{checkpoint_dir(spark).rstrip('/')}/affinity-ingest-{language}"
    return (pages.writeStream.foreachBatch(merge_batch(spark, root, language, as_of_col))
                 .option("checkpointLocation", ckpt)
                 .trigger(availableNow=True)
                 .start())
