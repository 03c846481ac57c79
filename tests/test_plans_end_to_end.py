"""Train writes the tables, serve reads them: same answer as the registered query."""

from affinity.plans import registry as R
from affinity.plans import serve, train
from affinity.sources import corpus
from inputs import SMOKE


def test_train_then_serve(spark):
    out = train.train(spark, corpus.raw_edges(spark, SMOKE), corpus.packages(spark, SMOKE))
    sim = spark.read.parquet(out.similarity_path)
    assert {"neighbor_rank", "bounded_similarity"} <= set(sim.columns)
    got = serve.recommend_one(spark, out.similarity_path, out.packages_path, R._seed_purls(spark, SMOKE))
    want = R.QUERIES["recommend"](spark, SMOKE)
    cols = ["package_a", "package_b", "score", "bounded_similarity", "similarity"]
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == \
        sorted(tuple(r) for r in want.select(*cols).collect())
    status, recs = serve.answer_requests(spark, out.similarity_path, out.packages_path,
                                         corpus.request_bodies(spark, SMOKE))
    assert status.count() == corpus.read_table(spark, SMOKE, "customer", "c_custkey").count()
    assert recs.where("rank < 1").count() == 0


def test_daily_refresh(spark, tmp_path):
    """A second run on the same root is the one served; a failed third leaves it in place."""
    import pytest
    root = str(tmp_path / "trained")
    edges, packages = corpus.raw_edges(spark, SMOKE), corpus.packages(spark, SMOKE)
    first = train.train(spark, edges, packages, root)
    second = train.train(spark, edges.limit(500), packages, root)
    assert train.current(spark, root) == second != first
    with pytest.raises(Exception):
        train.train(spark, edges.selectExpr("application_id", "raise_error('x') as package_id"), packages, root)
    assert train.current(spark, root) == second
