"""Similarity invariants, and the skew path (oversized baskets) against the plain path."""

import math

from pyspark.sql import functions as F

from affinity.operators import similarity
from affinity.sources import corpus
from inputs import SMOKE


def _pairs(df):
    return {(r.package_a, r.package_b): r.similarity for r in df.collect()}


def test_heavy_basket_grid_matches_plain(spark):
    # one application holds a large share of all edges; cell_rows=3 forces the grid path
    rows = [(1, p) for p in range(40)] + [(2, p) for p in range(0, 40, 3)] + [(3, 1), (3, 2), (3, 2)]
    edges = spark.createDataFrame(rows, "application_id long, package_id long")
    grid = _pairs(similarity.similarity_pairs(edges, cell_rows=3))
    plain = _pairs(similarity.similarity_pairs(edges, cell_rows=10 ** 6))
    assert grid == plain
    n = {}
    for app, p in set(rows):
        n[p] = n.get(p, 0) + 1
    c12 = 3  # packages 1 and 2 share applications 1 and 3 … and 2 does not hold 1 or 2
    assert plain[(1, 2)] == 2 / math.sqrt(n[1] * n[2])
    assert len(plain) == 40 * 39 // 2


def test_baskets_are_chunked_for_heavy_applications(spark):
    rows = [(1, p) for p in range(20)] + [(2, 5), (2, 6)]
    edges = spark.createDataFrame(rows, "application_id long, package_id long")
    b = similarity.baskets(edges, cell_rows=4).collect()
    heavy = [r for r in b if r.application_id == 1]
    assert len(heavy) == 5 and sorted(p for r in heavy for p in r.package_ids) == list(range(20))
    assert [r.package_ids for r in b if r.application_id == 2] == [[5, 6]]


def test_invariants_on_corpus(spark):
    sim = similarity.similarity_frame(corpus.raw_edges(spark, SMOKE))
    stats = sim.agg(F.min("similarity"), F.max("similarity"), F.min("bounded_similarity"),
                    F.max("bounded_similarity"), F.count(F.lit(1))).first()
    assert 0 < stats[0] and stats[1] <= 1.0 and 1 <= stats[2] and stats[3] <= 10
    mirrored = sim.select(F.col("package_b").alias("package_a"), F.col("package_a").alias("package_b"),
                          "similarity", "bounded_similarity")
    assert sim.exceptAll(mirrored).count() == 0


def test_distributed_rank_matches_window(spark):
    from pyspark.sql import Window

    from affinity.operators.merge import rank_within
    # key 0 holds most rows (a hot key); ties in the first order column
    rows = [(0, i % 97 / 97.0, i) for i in range(3000)] + [(k, (k * 7 % 5) / 5.0, k) for k in range(1, 300)]
    df = spark.createDataFrame(rows, "k long, s double, b long").repartition(7)
    order = [F.desc("s"), F.col("b")]
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(*order)))
    got = rank_within(df, "k", order, "r")
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())


def test_rank_neighbours_both_paths(spark):
    sim = similarity.similarity_frame(corpus.raw_edges(spark, SMOKE))
    a = similarity.rank_neighbours(sim, 10)      # window path
    b = similarity.rank_neighbours(sim, None)    # distributed path
    key = lambda r: (r.package_a, r.package_b, r.neighbor_rank)
    assert sorted(map(key, a.collect())) == sorted(map(key, b.collect()))


def test_long_neighbour_list_is_spread_over_files(spark):
    """Without a bound on the lists, one package's neighbours are written by range, ranks as in the window."""
    from affinity.session import scratch_path
    from affinity.sources import landed
    sim = spark.range(2, 4002).select(F.lit(1).cast("long").alias("package_a"), F.col("id").alias("package_b"),
                                      (F.lit(1.0) / F.col("id")).alias("similarity"))
    path = landed.write_similarity(sim, scratch_path(spark, "spread"), buckets=4, rank=True)
    got = spark.read.parquet(path)
    assert got.select(F.input_file_name()).distinct().count() > 1
    assert got.where(F.col("neighbor_rank") != F.col("package_b") - 1).count() == 0 and got.count() == 4000
