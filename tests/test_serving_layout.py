"""Lookups in the bucketed similarity table, block-wise top n, and similarity kept up to date by signed edges."""

import random

import pytest
from pyspark.sql import functions as F

from affinity.operators import joins, recommend, similarity
from affinity.plans import train
from affinity.session import PACKED, materialize, scratch_path
from affinity.sources import corpus, landed
from inputs import SMOKE


def random_edges(spark, apps, packages, n, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(apps), int(packages * rng.random() ** 2)) for _ in range(n)]
    return spark.createDataFrame(rows, "application_id long, package_id long")


def sim_rows(df):
    return sorted(tuple(r) for r in df.select("package_a", "package_b", "similarity").collect())


# ------------------------------------------------------------- one exchange

def test_edges_move_once(spark):
    """One exchange of edges (into baskets) and one of pairs: the plan of the pairs reads the written baskets."""
    state = similarity.state(corpus.raw_edges(spark, SMOKE))
    plan = state.counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    baskets = similarity.chunked_baskets(corpus.raw_edges(spark, SMOKE))._jdf.queryExecution().executedPlan().toString()
    assert baskets.count("Exchange") == 1


def test_oversized_basket_and_hot_package(spark):
    """A basket of a third of all edges and a package that every application uses; repeated edges make no basket large."""
    rows = [(0, p) for p in range(300)] + [(a, a % 90 + 1) for a in range(1, 300)] + [(a, 7) for a in range(300)]
    rows += [(5, 1)] * 500
    edges = spark.createDataFrame(rows, "application_id long, package_id long").repartition(5)
    assert [r.application_id for r in similarity.oversized_baskets(edges, 20).collect()] == [0]
    assert sim_rows(similarity.similarity_pairs(edges, cell_rows=20)) == sim_rows(similarity.similarity_pairs(edges))


# ------------------------------------------------------------ signed edges

@pytest.mark.parametrize("seed", [1, 2, 3])
def test_signed_edges_equal_a_rebuild(spark, seed):
    edges = random_edges(spark, 40, 30, 250, seed).dropDuplicates()
    state = similarity.state(edges)
    have = {tuple(r) for r in edges.collect()}
    rng = random.Random(seed)
    for _ in range(2):
        signed = [(a, p, -1) for a, p in rng.sample(sorted(have), 40)]
        signed += [(rng.randrange(50), rng.randrange(35), 1) for _ in range(40)]
        signed += [(99, 99, -1), (98, 1, 1), (98, 1, -1), *rng.sample([(a, p, 1) for a, p in sorted(have)], 5)]
        net = {}
        for a, p, s in signed:
            net[a, p] = net.get((a, p), 0) + s
        have = {e for e in have if net.get(e, 0) >= 0} | {e for e, s in net.items() if s > 0}
        state = similarity.State(*(materialize(t) for t in (state.edges, state.counts, state.degrees)))
        state = similarity.merge_state(state, spark.createDataFrame(signed, "application_id long, package_id long, sign int"))
    rebuilt = similarity.state(spark.createDataFrame(sorted(have), "application_id long, package_id long"))
    for t in train.STATE_TABLES:
        merged, whole = getattr(state, t), getattr(rebuilt, t)
        assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.select(*merged.columns).collect()))


def test_refresh_equals_training(spark, tmp_path):
    edges, packages = corpus.raw_edges(spark, SMOKE), corpus.packages(spark, SMOKE)
    early = edges.where("application_id % 3 <> 0")
    root = str(tmp_path / "trained")
    train.train(spark, early, packages, root)
    out = train.refresh(spark, edges.where("application_id % 3 = 0").withColumn("sign", F.lit(1)), packages, root)
    whole = train.train(spark, edges, packages)
    for path, other in ((out.similarity_path, whole.similarity_path), (out.packages_path, whole.packages_path)):
        a, b = spark.read.parquet(path), spark.read.parquet(other)
        assert a.exceptAll(b.select(*a.columns)).count() == 0 and a.count() == b.count()
    assert train.current(spark, root) == out


# ------------------------------------------------------------ pruned lookups

def scans(df):
    """(name, files read) of the scans of an executed plan, sub-plans of AQE included."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(p.plan())
        if kind == "FileSourceScanExec":
            out.append((p.toString(), p.metrics().get("numFiles").get().value()))
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def bucketed(spark, buckets, rows=4000):
    edges = random_edges(spark, 150, 200, rows, 5)
    path = landed.write_similarity(similarity.similarity_frame(edges), scratch_path(spark, "buckets"), buckets, rank=True,
                                   max_neighbours=200)
    return spark.read.parquet(path)


def test_lookup_reads_the_seeds_buckets_only(spark):
    sim = bucketed(spark, 16)
    assert landed.similarity_buckets(sim) == 16
    files = sim.select(F.input_file_name()).distinct().count()
    assert files == 16
    ids = materialize(spark.createDataFrame([(3,), (8,)], "id long"))
    mine = {r.b for r in ids.select(landed.bucket_of(F.col("id"), 16).alias("b")).collect()}
    for limit in (None, 10):
        got = recommend.candidates(sim, ids, seed_count=2, limit=limit)
        plain = recommend.candidates(sim.drop(landed.BUCKET), ids, seed_count=2, limit=limit)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
        read = [(text, n) for text, n in scans(got) if landed.BUCKET in text]
        assert len(read) == 1 and "dynamicpruning" in read[0][0] and read[0][1] == len(mine) < files


def test_bucket_count_grows_with_the_table():
    assert [landed.bucket_count(n) for n in (0, 1, 100_001, 10 ** 9, 10 ** 11)] == [1, 1, 2, 4096, 12500]


# ---------------------------------------------------------- block-wise top n

@pytest.mark.parametrize("buckets", [1, 7])
def test_block_wise_top_equals_whole_lists(spark, buckets):
    """Many ties in similarity, owned packages among the best, limits above and below what there is."""
    sim = bucketed(spark, buckets, 1500)
    rng = random.Random(9)
    rows = []
    for r in range(60):
        limit = rng.choice([0, 1, 3, 10, 40, 10_000])
        rows += [(r, p, limit) for p in rng.sample(range(210), rng.choice([1, 2, 10, 60]))]
    ids = materialize(spark.createDataFrame(rows, "request_id long, id long, max_recommendations long"))
    got = recommend.top_candidates(sim, ids)
    owned = {}
    for r, p, limit in rows:
        owned.setdefault((r, limit), set()).add(p)
    pairs = [tuple(x) for x in sim.select("package_a", "package_b", "similarity", "bounded_similarity").collect()]
    want = []
    for (r, limit), seeds in owned.items():
        kept = sorted((x for x in pairs if x[0] in seeds and x[1] not in seeds), key=lambda x: (-x[2], x[0], x[1]))
        want += [(r, *x, k + 1) for k, x in enumerate(kept[:limit])]
    assert sorted(map(tuple, got.pairs.collect())) == sorted(want)


def test_block_wise_top_reads_a_fraction(spark):
    sim = bucketed(spark, 4, 6000)
    ids = materialize(spark.range(100).select((F.col("id") % 5).alias("request_id"), "id", F.lit(20).cast("long").alias("max_recommendations")))
    got = recommend.top_candidates(sim, ids)
    whole = sim.join(ids, F.col("id") == F.col("package_a")).count()
    assert got.pairs.count() == 100 and 0 < got.rows_read < whole / 10


def test_block_wise_top_without_requests(spark):
    sim = bucketed(spark, 2, 300)
    none = materialize(spark.createDataFrame([], "request_id long, id long, max_recommendations long"))
    got = recommend.top_candidates(sim, none)
    assert got.pairs.collect() == [] and got.rounds == 0


# -------------------------------------------------------------- broadcasts

def test_broadcast_is_bounded_by_bytes(spark):
    df = spark.createDataFrame([("x" * 1000, i) for i in range(100)], "s string, i long")
    rows, size = joins.measure(df)
    assert rows == 100 and 100_000 < size < 110_000
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(joins.checked_broadcast(df)) and not hinted(joins.checked_broadcast(df, max_bytes=50_000))
    assert not hinted(joins.checked_broadcast(df, max_rows=99))


# ---------------------------------------------- batches beyond the broadcast

@pytest.mark.parametrize("in_row", [2, 256])
def test_batch_beyond_the_broadcast_moves_no_pairs(spark, monkeypatch, in_row):
    """Owned packages travel with the seeds; only requests of long lists have their pairs moved. Same rows either way."""
    sim = bucketed(spark, 5, 1500)
    rng = random.Random(4)
    rows = [(r if r else None, p, 1 + r % 30) for r in range(40) for p in rng.sample(range(210), rng.choice([1, 2, 12]))]
    ids = materialize(spark.createDataFrame(rows, "request_id long, id long, max_recommendations long"))
    keyed = ids.where("request_id is not null")

    def answers():
        whole = recommend.candidates(sim, ids.drop("max_recommendations"), ["request_id"])
        cut = recommend.candidates(sim, ids, ["request_id"], limit="max_recommendations")
        return whole, [sorted(map(tuple, d.collect()), key=str) for d in (
            whole.select("request_id", "package_a", "package_b", "similarity", "bounded_similarity"),
            cut.select("request_id", "package_a", "package_b"), recommend.top_candidates(sim, keyed).pairs)]

    _, want = answers()
    monkeypatch.setattr(recommend, "MAX_BROADCAST_ROWS", 0)
    monkeypatch.setattr(recommend, "OWNED_IN_ROW", in_row)
    whole, got = answers()
    assert got == want and all(want)
    moved = "LeftAnti" in whole._jdf.queryExecution().optimizedPlan().toString()
    assert moved == (in_row == 2)


def test_pairs_are_combined_in_bounded_tasks(spark, monkeypatch):
    """A scan of the baskets has as many tasks as cores; each task combines a bounded number of pairs all the same."""
    edges = spark.range(3000).select(F.expr("id div 6").alias("application_id"), (F.col("id") % 97).alias("package_id"))
    want = similarity.state(edges).counts.collect()
    monkeypatch.setattr(similarity, "PAIRS_A_TASK", 100)
    counts = similarity.state(edges).counts
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, want))
    chunks = materialize(similarity.chunked_baskets(edges))
    made = similarity._triangle(similarity.spread(chunks, 100)).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert made <= 200 and "RoundRobin" in counts._jdf.queryExecution().toString()


def test_longest_list_bounds_the_lists(spark, monkeypatch):
    counts = spark.createDataFrame([(1, 2, 1), (1, 3, 1), (2, 3, 1), (1, 4, 2)], "package_a long, package_b long, c long")
    assert similarity.longest_list(counts, 9) == 9
    monkeypatch.setattr(similarity, "WINDOW_GROUP_ROWS", 5)
    assert similarity.longest_list(counts, 9) == 3 and similarity.longest_list(counts.limit(0), 9) == 0


def test_tables_as_long_as_the_pairs_are_packed(spark, tmp_path):
    """The similarity table and the written pair counts use the packed codec, other written tables the session's."""
    sim = spark.createDataFrame([(1, 2, 0.5, 5)], "package_a long, package_b long, similarity double, bounded_similarity int")
    path = landed.write_similarity(sim, str(tmp_path / "sim"), 1, rank=True, max_neighbours=2)
    files = [*spark.read.parquet(path).inputFiles(), *materialize(sim, "counts", PACKED).inputFiles()]
    assert all(f.endswith(".zstd.parquet") for f in files)
    assert not any(f.endswith(".zstd.parquet") for f in materialize(sim).inputFiles())
