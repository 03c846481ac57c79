"""Session settings the library relies on, and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job of the library expects. They only change how plans are
# chosen or how JSON is parsed, never what a query means.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # lists are collected per key in a hash map for this many keys of a task before sorting takes over
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
    # a duplicated JSON key keeps its last value, as a JSON object reader would
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "affinity") -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "8g"))
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_defaults(spark)
    return spark


def apply_defaults(spark: SparkSession) -> None:
    """Apply the runtime settings above to a session the caller created."""
    for key, value in SESSION_DEFAULTS.items():
        spark.conf.set(key, value)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Read from the session. Only a local master, where everything runs in one
    process, gets a fresh private folder when nothing is configured.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not sc.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not configured:
        configured = tempfile.mkdtemp(prefix="affinity-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder under the checkpoint location for written tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/affinity-{name}-{uuid.uuid4().hex}"


# Target bytes per shuffle partition / input split on a cluster: small enough
# to sort and aggregate in executor memory, large enough to keep task counts
# manageable at 100 TB.
TARGET_PARTITION_BYTES = 256 << 20


def cluster_settings(input_bytes: int, executors_cores: int) -> dict[str, str]:
    """Settings sized from the input: initial shuffle partitions and split size.

    AQE coalesces small partitions and splits skewed ones at run time, so
    the initial number is an upper bound chosen from the data volume (at
    least two waves of the cluster's cores). The caller applies them with
    `spark.conf.set` before building the plans.
    """
    parts = max(2 * executors_cores, -(-input_bytes // TARGET_PARTITION_BYTES))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(TARGET_PARTITION_BYTES),
        "spark.sql.files.maxPartitionBytes": str(TARGET_PARTITION_BYTES),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * TARGET_PARTITION_BYTES),
    }


# Codec of tables of numbers that are as long as the pairs.
PACKED = "zstd"


def materialize(df, name: str = "table", codec: str | None = None):
    """Write `df` once as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage (an executor loss re-reads the files instead of
    recomputing the inputs) and lets several consumers read one result. A
    written table is computed exactly once (an eager RDD checkpoint of an
    unpersisted plan computes it twice) and the read-back carries real file
    sizes for the planner's join choices. `codec` replaces the session's.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").parquet(path, compression=codec)
    return spark.read.parquet(path)
