"""What queries move and write on their way: the columns of their shuffles, and the files of what they land."""

import random

import pytest
from pyspark.sql import functions as F

from affinity.operators import manifests, recommend, scores, similarity
from affinity.plans import registry
from affinity.session import materialize, scratch_path
from affinity.sources import corpus, landed
from inputs import SMOKE


def moved(df):
    """The columns of each shuffle of a plan, as planned."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.initialPlan())
        if kind == "ShuffleExchangeExec":
            names = p.output()
            out.append({names.apply(i).name() for i in range(names.size())})
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def test_manifest_entries_are_made_after_the_shuffle(spark):
    found = moved(corpus.manifests(spark, SMOKE))
    assert {"l_orderkey", "slug", "p_size", "is_npm"} in found
    assert not any({"buf", "entry", "npm", "py"} & names for names in found)


def test_union_of_manifests_moves_texts_not_purls(spark):
    rows = [(1, "main", "javascript", '{"dependencies": {"a": "^1.0.0", "b": "2.0.0"}}'), (1, "main", "python", "c>=3.0\nd"),
            (1, "dev", "javascript", '{"dependencies": {"a": "1"}'), (2, "dev", "python", "c>=3.0\nc>=3.0"), (3, None, "python", "e")]
    df = spark.createDataFrame(rows, "application_id long, branch string, language string, text string")
    u = manifests.repo_dependency_union(df, ["application_id", "branch"])
    assert not any({"buf", "purl", "purls"} & names for names in moved(u))
    got = {(r.application_id, r.branch): (r.language, r.purls) for r in u.collect()}
    assert got == {(1, "main"): ("python", ["pkg:npm/a@1.0.0", "pkg:npm/b@2.0.0", "pkg:pypi/c@3.0", "pkg:pypi/d"]),
                   (1, "dev"): ("javascript", []), (2, "dev"): ("python", ["pkg:pypi/c@3.0", "pkg:pypi/c@3.0"]),
                   (3, None): ("python", [])}


def test_search_pages_are_landed_packed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registry, "scratch_path", lambda spark, name: str(tmp_path / name))
    rows = registry.QUERIES["ingest_search_pages"](spark, SMOKE).collect()
    files = list((tmp_path / "pages").rglob("part-*"))
    assert files and all(f.name.endswith(".gz") for f in files)
    assert {f.parent.name for f in files} == {"language=javascript", "language=python"}
    texts = corpus.manifests(spark, SMOKE).select("language", "url").collect()
    assert sorted((r.language, r.url) for r in rows) == sorted(map(tuple, texts))


def test_empty_search_pages(spark, tmp_path):
    """No orders: no pages, no folders by language, no rows."""
    for name in ("orders", "lineitem", "part"):
        spark.read.parquet(f"{SMOKE}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert registry.QUERIES["ingest_search_pages"](spark, str(tmp_path)).collect() == []


# ------------------------------------------------------- requests and lists

def test_requests_are_made_and_written_once(spark):
    """Texts of dependencies move once, to their customer; what is written is what was parsed, without the bodies."""
    found = moved(corpus.request_bodies(spark, SMOKE))
    assert sum("dep" in names for names in found) == 1 and not any("buf" in names for names in found)
    written = registry._written_requests(spark, SMOKE)
    assert "body" not in written.columns and all(f.endswith(".zstd.parquet") for f in written.inputFiles())
    whole = registry._valid_requests(spark, SMOKE).drop("body")
    assert sorted(map(str, written.collect())) == sorted(map(str, whole.collect()))


def ranked(spark, mirrored):
    rng = random.Random(3)
    rows = [(rng.randrange(150), int(200 * rng.random() ** 2)) for _ in range(2500)]
    state = similarity.state(spark.createDataFrame(rows, "application_id long, package_id long"))
    pairs = similarity.mirror_pairs(similarity.cosine(state.counts, state.degrees))
    path = landed.write_similarity(pairs if mirrored else similarity.with_bounded(pairs), scratch_path(spark, "ranked"), 3, rank=True,
                                   max_neighbours=200, mirrored=mirrored)
    return spark.read.parquet(path)


def test_popularity_of_a_mirrored_table_moves_a_row_a_package(spark):
    marked, plain = ranked(spark, True), ranked(spark, False)
    cols = ["package_a", "package_b", "similarity", "bounded_similarity", "neighbor_rank"]
    assert sorted(map(tuple, marked.select(*cols).collect())) == sorted(map(tuple, plain.select(*cols).collect()))
    assert any("package_a" in names for names in moved(scores.popularity(marked)))
    assert not any("package_a" in names for names in moved(scores.popularity(plain)))
    assert sorted(map(tuple, scores.popularity(marked).collect())) == sorted(map(tuple, scores.popularity(plain).collect()))


def requests(spark):
    """Few seeds and many, limits below and above what there is, a seed twice."""
    rng = random.Random(8)
    rows = [(r, p, rng.choice([1, 5, 60])) for r in range(50) for p in rng.sample(range(210), rng.choice([1, 2, 12, 40]))]
    limit = {r: n for r, _, n in rows}
    return materialize(spark.createDataFrame([(r, p, limit[r]) for r, p, _ in rows + rows[:3]],
                                             "request_id long, id long, max_recommendations long"))


@pytest.mark.parametrize("most", [0, 1, 30, 300])
def test_deep_lists_are_sent_to_the_table(spark, monkeypatch, most):
    """The table is moved as far down as most lists are read; the deeper lists are broadcast within the bound. Same rows."""
    sim, ids = ranked(spark, True), requests(spark)
    want = sorted(map(tuple, recommend.top_candidates(sim, ids).pairs.collect()))
    sent = []
    monkeypatch.setattr(recommend, "MAX_BROADCAST_ROWS", most)
    monkeypatch.setattr(recommend, "checked_broadcast", lambda df, max_rows=None: sent.append(df.count()) or df)
    assert sorted(map(tuple, recommend.top_candidates(sim, ids).pairs.collect())) == want and want
    assert (max(sent, default=0) > 0) == (most in (30, 300)) and max(sent, default=0) <= most


def test_answered_requests_are_not_moved_again(spark, monkeypatch):
    """A later round reads and writes the rows of unanswered requests only."""
    sim = ranked(spark, True)
    one = spark.createDataFrame([(1, 5, 150)], "request_id long, id long, max_recommendations long")
    many = spark.range(40).select(F.lit(2).cast("long").alias("request_id"), "id", F.lit(60).cast("long").alias("max_recommendations"))
    ids = materialize(one.unionByName(many))
    written = []
    monkeypatch.setattr(recommend, "materialize", lambda df, name="table", codec=None: written.append((name, materialize(df, name, codec))) or written[-1][1])
    got = recommend.top_candidates(sim, ids)
    per_round = [{r.request_id for r in t.select("request_id").distinct().collect()} for name, t in written if name == "best"]
    assert got.rounds > 1 and per_round[0] == {1, 2} and 1 not in per_round[1]


def test_wide_similarity_rows_are_not_sorted(spark, monkeypatch):
    """Beyond the broadcast, only the join that makes rows wide sorts them: seeds and the other packages are held in memory."""
    sim, ids = ranked(spark, True), requests(spark)
    packages = materialize(spark.range(200).select(
        "id", F.concat(F.lit("p"), "id").alias("short_name"), F.lit("u").alias("url"), F.lit(1).alias("bounded_popularity"),
        F.lit(2).alias("absolute_trend"), F.lit(3).alias("relative_trend"), F.array(F.lit("c")).alias("categories"),
        F.lit("d").alias("display_date"), F.lit(4).cast("long").alias("monthly_downloads_last_month")))

    def found():
        rows = recommend.pair_metadata(sim, packages, "package_a")
        return recommend.candidates(rows, ids, ["request_id"]).select("request_id", "package_a", "package_b", "for_package", "recommended_package")

    want = sorted(map(tuple, found().collect()))
    monkeypatch.setattr(recommend, "MAX_BROADCAST_ROWS", 0)
    monkeypatch.setattr(recommend, "checked_broadcast", lambda df, **bounds: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = found()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 1 and plan.count("ShuffledHashJoin") == 2
        assert sorted(map(tuple, df.collect())) == want and want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
