"""The daily train job: edges → similarity table → scored packages, both written.

Each run writes a new version (readers switch when all its tables are complete). Beside the two
tables that are served it writes the state they come from (unique edges, pair counts, degrees),
so the next day's run can start from there: `refresh` adds signed edges to it instead of going
through all baskets again. The similarity table is written before scoring reads it, so no reader
ever sees unbounded placeholder scores.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from affinity.operators import scores, similarity
from affinity.session import scratch_path
from affinity.sources import landed, versions

STATE_TABLES = ("edges", "counts", "degrees")


@dataclass
class TrainOutput:
    similarity_path: str
    packages_path: str
    state_paths: dict[str, str]

    def state(self, spark: SparkSession) -> similarity.State:
        return similarity.State(**{t: spark.read.parquet(self.state_paths[t]) for t in STATE_TABLES})


def _output(root: str, version: int, attempt: str) -> TrainOutput:
    at = {t: versions.path(root, version, f"{t}-{attempt}") for t in ("similarity", "packages", *STATE_TABLES)}
    return TrainOutput(at["similarity"], at["packages"], {t: at[t] for t in STATE_TABLES})


def write_served(spark: SparkSession, state: similarity.State, packages: DataFrame, similarity_path: str,
                 packages_path: str) -> None:
    """The two served tables from a written state. Its pair count is known by then and sets the number of buckets."""
    buckets = landed.bucket_count(2 * state.counts.count())
    sim = similarity.mirror_pairs(similarity.cosine(state.counts, state.degrees))
    landed.write_similarity(sim, similarity_path, buckets, rank=True, mirrored=True,
                            max_neighbours=similarity.longest_list(state.counts, packages.count()))
    landed.write_table(scores.score_packages(packages, spark.read.parquet(similarity_path)), packages_path)


def _write(spark: SparkSession, state: similarity.State, packages: DataFrame, root: str) -> TrainOutput:
    version = versions.following(spark, root)
    # a failed attempt may have left tables of this number
    attempt = uuid.uuid4().hex
    out = _output(root, version, attempt)
    for t in STATE_TABLES:
        landed.write_table(getattr(state, t), out.state_paths[t])
    write_served(spark, out.state(spark), packages, out.similarity_path, out.packages_path)
    versions.commit(spark, root, version, attempt)
    return out


def train(spark: SparkSession, edges: DataFrame, packages: DataFrame, root: str | None = None) -> TrainOutput:
    """Compute and write everything from the whole edge table.

    Every run under `root` is a new version, which readers see (`current`)
    once all its tables are complete; a failed run leaves the one before in place.
    """
    return _write(spark, similarity.state(edges), packages, root or scratch_path(spark, "trained"))


def refresh(spark: SparkSession, deltas: DataFrame, packages: DataFrame, root: str) -> TrainOutput:
    """The next version from the newest one and signed edges (application_id, package_id, sign).

    Gives the tables that `train` on the changed edges would give.
    """
    return _write(spark, similarity.merge_state(current(spark, root).state(spark), deltas), packages, root)


def current(spark: SparkSession, root: str) -> TrainOutput:
    """The tables of the newest complete run under `root`."""
    runs = versions.commits(spark, root)
    if not runs:
        raise FileNotFoundError(f"no complete training run under {root}")
    version = max(runs)
    return _output(root, version, runs[version])
