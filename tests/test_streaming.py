"""Incremental ingest: landed page files → versioned tables, idempotent upserts."""

import tempfile

from pyspark.sql import functions as F

from affinity.sources import landed, versions
from affinity.streaming import ingest as stream


def _land(spark, folder, rows):
    repos = spark.createDataFrame(rows, "page_key long, url string, name string, followers int, text string")
    landed.build_search_pages(repos).write.mode("errorifexists").text(folder)


def test_stream_upserts(spark):
    work = tempfile.mkdtemp(prefix="affinity-stream-")
    landing, root = f"{work}/landing", f"{work}/tables"
    _land(spark, f"{landing}/day1", [
        (1, "u/a", "o/a", 3, '{"dependencies": {"react": "^16.13.1", "d3": "5.0.0"}}'),
        (2, "u/b", "o/b", 1, '{"dependencies": {"react": "~16.1"}}'),
        (3, "u/c", "o/c", 0, None),                       # no manifest: skipped
        (4, "u/d", "o/d", 9, '{"dependencies": {"x": "1"'),  # corrupt: skipped
    ])
    q = stream.start_ingest(spark, f"{landing}/*", root, "javascript", f"{work}/ckpt", as_of_col=F.lit(None).cast("timestamp"))
    q.awaitTermination()
    apps = {r.url: (r.id, r.followers) for r in stream.read_version(spark, root, "applications").collect()}
    assert apps == {"u/a": (1, 3), "u/b": (2, 1)}
    pk = {r.name: r.id for r in stream.read_version(spark, root, "packages").collect()}
    assert set(pk) == {"pkg:npm/react@16", "pkg:npm/d3@5"}
    deps = sorted(tuple(r) for r in stream.read_version(spark, root, "dependencies").collect())
    assert len(deps) == 3

    # a later slice sees repository a again (more followers) and a new repository e
    _land(spark, f"{landing}/day2", [
        (1, "u/a", "o/a", 4, '{"dependencies": {"react": "^16.13.1", "d3": "5.0.0"}}'),
        (5, "u/e", "o/e", 2, '{"dependencies": {"lodash": "4.17.15", "d3": "^5"}}'),
    ])
    q = stream.start_ingest(spark, f"{landing}/*", root, "javascript", f"{work}/ckpt", as_of_col=F.lit(None).cast("timestamp"))
    q.awaitTermination()
    apps2 = {r.url: (r.id, r.followers) for r in stream.read_version(spark, root, "applications").collect()}
    assert apps2 == {"u/a": (1, 4), "u/b": (2, 1), "u/e": (3, 2)}
    pk2 = {r.name: r.id for r in stream.read_version(spark, root, "packages").collect()}
    assert {k: pk2[k] for k in pk} == pk and pk2["pkg:npm/lodash@4"] == 3
    deps2 = sorted(tuple(r) for r in stream.read_version(spark, root, "dependencies").collect())
    assert len(deps2) == 5 and set(deps) <= set(deps2)


def _pages(spark, language, rows):
    repos = spark.createDataFrame(rows, "page_key long, url string, name string, followers int, text string")
    from affinity import schemas
    text = landed.build_search_pages(repos)
    return text.select(F.from_json(text.columns[0], schemas.SEARCH_PAGE).alias("p")).select("p.*")


def test_two_languages_share_one_root(spark):
    js = [(1, "u/a", "o/a", 3, '{"dependencies": {"react": "^16.13.1"}}')]
    py = [(2, "u/b", "o/b", 1, "numpy==1.18.0\n")]
    as_of = F.lit("2020-01-02").cast("timestamp")
    for order in ((("javascript", js), ("python", py)), (("python", py), ("javascript", js))):
        root = tempfile.mkdtemp(prefix="affinity-two-")
        for language, rows in order:
            run = stream.merge_batch(spark, root, language, as_of)
            run(_pages(spark, language, rows), 0)
            run(_pages(spark, language, rows), 0)          # a replay of a committed batch changes nothing
        assert len(versions.commits(spark, root)) == 2
        assert {r.url for r in stream.read_version(spark, root, "applications").collect()} == {"u/a", "u/b"}
        assert {r.name for r in stream.read_version(spark, root, "packages").collect()} == {
            "pkg:npm/react@16", "pkg:pypi/numpy@1"}
        assert stream.read_version(spark, root, "dependencies").count() == 2


def test_metadata_survives_and_a_crash_stays_unseen(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="affinity-meta-")
    as_of = F.lit("2020-01-02").cast("timestamp")
    run = stream.merge_batch(spark, root, "javascript", as_of)
    rows = [(1, "u/a", "o/a", 3, '{"dependencies": {"react": "^16.13.1"}}')]
    run(_pages(spark, "javascript", rows), 0)
    # a refresh of the metadata is a version like any other
    version = versions.following(spark, root)
    for table in stream.TABLES:
        df = stream.read_version(spark, root, table)
        if table == "packages":
            df = df.withColumn("monthly_downloads_last_month", F.lit(100).cast(
                df.schema["monthly_downloads_last_month"].dataType))
        df.write.parquet(versions.path(root, version, table))
    versions.commit(spark, root, version, "metadata")
    with monkeypatch.context() as m:
        m.setattr(stream.versions, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        try:
            run(_pages(spark, "javascript", [(2, "u/z", "o/z", 3, '{"dependencies": {"vue": "^2.0.0"}}')]), 1)
        except OSError:
            pass
    assert versions.newest(spark, root) == version
    assert stream.read_version(spark, root, "applications").count() == 1
    run(_pages(spark, "javascript", [(3, "u/b", "o/b", 3, '{"dependencies": {"react": "^16", "d3": "5"}}')]), 1)
    got = {r.name: r.monthly_downloads_last_month for r in stream.read_version(spark, root, "packages").collect()}
    assert got == {"pkg:npm/react@16": 100, "pkg:npm/d3@5": None}
