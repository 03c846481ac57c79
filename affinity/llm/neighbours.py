"""Operator 10: approximate nearest neighbours by an adaptive dimension scan.

Vectors are dealt to inverted lists by their nearest centroid; a query probes
the lists of its nearest centroids. Within a probed list the vectors, turned
by a random rotation, are read in blocks of columns. After d of D columns the
partial distance, scaled by D / d, estimates the whole distance; a candidate
is abandoned when that estimate exceeds the query's current tenth-best
distance by more than a sampling error of `EPSILON` / sqrt(d) allows. The
survivors' distances are computed on the original vectors in double precision.

Centroids, rotation and each query's first bound are fitted on at most
`FIT_ROWS` vectors taken by hash of the id; they have a fixed size and are
sent to every task. Every vector is indexed. A list with many vectors, or with
many queries, is cut into blocks by hash, so no task holds more than
`BLOCK_ROWS` vectors and `QUERY_ROWS` queries on average.

Defined results: vectors that are null, empty, zero, or hold null or
non-finite components take no part, nor do rows without an id or whose length
is not the table's most frequent one (the larger one on a tie); rows repeating
an id and its vector count once, and a query whose id has several vectors uses
the smallest; a query with fewer than k candidates gets them all; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIT_ROWS = 8_192
MAX_LISTS = 2_048
PROBED_SHARE = 0.55       # of the lists, of which at least MIN_PROBES
MIN_PROBES = 12
EPSILON = 2.1
COLUMN_BLOCK = 16
BLOCK_ROWS = 8_192
QUERY_ROWS = 2_048
SCAN_ROWS = 1_024


def usable(column: str = "embedding") -> Column:
    """Is a vector there, with finite components that are not all zero?"""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _vectors(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of `a` to all rows of `b`."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's iterations on the sample, from rows of it."""
    random = np.random.default_rng(11)
    centroids = sample[random.permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        near = np.concatenate([_squares(sample[i:i + 4096], centroids).argmin(1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        counts = np.bincount(near, minlength=len(centroids))
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


def rotation(dimensions: int) -> np.ndarray:
    """A random orthogonal matrix, the same for every task."""
    return np.linalg.qr(np.random.default_rng(5).normal(size=(dimensions, dimensions)))[0]


def scan(turned: np.ndarray, query: np.ndarray, bound: float) -> np.ndarray:
    """Rows of `turned` that the tests leave, for a query (turned too) and a bound on its k-th best distance."""
    dimensions = len(query)
    left = np.arange(len(turned))
    partial = np.zeros(len(turned))
    for start in range(0, dimensions, COLUMN_BLOCK):
        stop = min(start + COLUMN_BLOCK, dimensions)
        gap = turned[left, start:stop] - query[start:stop]
        partial = partial + (gap * gap).sum(1)
        if stop == dimensions:
            # all columns are in: the test is exact but for rounding
            keep = partial <= bound * bound * (1 + 1e-9) + 1e-12
        else:
            keep = partial * (dimensions / stop) <= (bound * (1 + EPSILON / np.sqrt(stop))) ** 2 + 1e-12
        left, partial = left[keep], partial[keep]
        if not len(left):
            break
    return left


def _best(ids: np.ndarray, d: np.ndarray, keep, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the k nearest, ties to the smaller id; a repeated row counts once."""
    ids, d = ids[keep], d[keep]

    def of(ids: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((ids, d))
        ids, d = ids[order], d[order]
        first = np.ones(len(d), bool)
        first[1:] = (ids[1:] != ids[:-1]) | (d[1:] != d[:-1])
        return ids[first][:k], d[first][:k]

    if len(d) > 8 * k:
        near = d <= np.partition(d, 4 * k)[4 * k]
        out = of(ids[near], d[near])
        if len(out[0]) == k:                          # else they are repeats of fewer rows
            return out
    return of(ids, d)


def _search_block(vectors: pa.Table, queries: pa.Table, k: int, turn: np.ndarray) -> pa.Table:
    """The k best of one block of a list for each query of one block of its queries."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if vectors.num_rows and queries.num_rows:
        ids, points = vectors["vec_id"].to_numpy(), _vectors(vectors["embedding"])
        turned = np.ascontiguousarray(points @ turn)
        asked, wanted = queries["query_id"].to_numpy(), _vectors(queries["vector"])
        bounds, wanted_turned = queries["bound"].to_numpy(), wanted @ turn
        for q, point, point_turned, bound in zip(asked, wanted, wanted_turned, bounds):
            best_d, best_id = np.empty(0), np.empty(0, np.int64)
            for at in range(0, len(ids), SCAN_ROWS):
                rows = at + scan(turned[at:at + SCAN_ROWS], point_turned, bound)
                rows = rows[ids[rows] != q]
                if not len(rows):
                    continue
                gap = points[rows] - point
                best_id, best_d = _best(np.concatenate([best_id, ids[rows]]),
                                        np.concatenate([best_d, np.sqrt((gap * gap).sum(1))]), slice(None), k)
                if len(best_d) == k:
                    bound = min(bound, best_d[-1])
            found.append((np.full(len(best_d), q), best_id, best_d))
    columns = [np.concatenate(c) if found else [] for c in (zip(*found) if found else ((), (), ()))]
    return pa.table([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def nearest(table: DataFrame, is_query: Column, k: int = 10, probed_share: float = PROBED_SHARE) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows found for every row that `is_query` marks."""
    spark = table.sparkSession
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")) \
                .where(F.col("vec_id").isNotNull() & usable())
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sizes is None:
        return empty
    dimensions, count = sizes
    rows = rows.where(F.size("embedding") == dimensions)
    fitted = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).toArrow()
    sample_ids, sample = fitted["vec_id"].to_numpy(), _vectors(fitted["embedding"])
    lists = int(min(MAX_LISTS, max(1, round(count ** 0.5)), len(sample)))
    centroids, turn = fit_centroids(sample, lists), rotation(dimensions)
    probes = min(lists, max(MIN_PROBES, round(lists * probed_share)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _squares(_vectors(batch.column(1)), centroids).argmin(1)
                yield pa.record_batch([pa.array(near, pa.int32()), batch.column(0), batch.column(1)],
                                      ["list", "vec_id", "embedding"])

    def fitted_best(query: int, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest fitted rows: ids and distances."""
        d = np.sqrt(((sample - point) ** 2).sum(1))
        return _best(sample_ids, d, sample_ids != query, k)

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for query, point in zip(batch.column(0).to_pylist(), _vectors(batch.column(1)) if batch.num_rows else ()):
                ids, scores = fitted_best(query, point)
                yield pa.record_batch([pa.array(np.full(len(ids), query)), pa.array(ids), pa.array(scores)],
                                      ["query_id", "vec_id", "score"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _vectors(batch.column(1))
            near = np.argsort(_squares(points, centroids), axis=1, kind="stable")[:, :probes]
            ids = batch.column(0).to_numpy()
            # the k-th best of the fitted rows bounds the k-th best of all
            bounds = [best[1][-1] if len(best[1]) == k else np.inf for best in map(fitted_best, ids, points)]
            bounds = np.asarray(bounds, np.float64)
            repeat = np.repeat(np.arange(len(ids)), probes)
            yield pa.record_batch([pa.array(near.ravel(), pa.int32()), pa.array(ids[repeat]),
                                   batch.column(1).take(pa.array(repeat)), pa.array(bounds[repeat])],
                                  ["list", "query_id", "vector", "bound"])

    dealt = rows.mapInArrow(deal, "list int, vec_id long, embedding array<double>")
    wanted = rows.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = wanted.mapInArrow(
        probe, "list int, query_id long, vector array<double>, bound double")

    def blocks(frame: DataFrame, size: int) -> dict[int, int]:
        """Blocks of each list: one row a list."""
        return {r["list"]: -(-r["count"] // size) for r in frame.groupBy("list").count().collect()}

    of_vectors, of_queries = blocks(dealt.select("list"), BLOCK_ROWS), blocks(asked.select("list"), QUERY_ROWS)
    split = spark.createDataFrame(
        [(i, of_vectors.get(i, 1), of_queries.get(i, 1)) for i in range(lists)], "list int, v_blocks int, q_blocks int")

    def dealt_out(frame: DataFrame, own: str, other: str, key: str) -> DataFrame:
        # a row goes to its own block and is copied to the blocks of the other side
        return (frame.join(F.broadcast(split), "list")      # one row a list
                .withColumn(own[0], F.pmod(F.xxhash64(key), F.col(own)).cast("int"))
                .withColumn(other[0], F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
                .drop("v_blocks", "q_blocks"))

    left = dealt_out(dealt, "v_blocks", "q_blocks", "vec_id").groupBy("list", "v", "q")
    right = dealt_out(asked, "q_blocks", "v_blocks", "query_id").groupBy("list", "v", "q")
    found = left.cogroup(right).applyInArrow(
        lambda vectors, queries: _search_block(vectors, queries, k, turn), "query_id long, vec_id long, score double")
    # the fitted rows are candidates too: a query whose lists hold few gets the best of them
    found = found.union(wanted.mapInArrow(seeds, "query_id long, vec_id long, score double")).distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
