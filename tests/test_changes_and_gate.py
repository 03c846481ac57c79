"""Change-driven ingest, manifests by branch, violating keys and the gate that stops a version."""

import pytest
from pyspark.sql import functions as F

from affinity.functions import purl
from affinity.operators import constraints, manifests
from affinity.plans import ingest
from affinity.session import materialize
from affinity.sources import versions

TEXTS = "url string, language string, text string"


def js(*deps):
    return '{"dependencies": {' + ", ".join(f'"{d}": "^{v}.0.0"' for d, v in deps) + "}}"


def test_only_changed_manifests_are_read(spark):
    old = spark.createDataFrame([("a", "javascript", js(("x", 1), ("y", 2))), ("b", "python", "p==1\nq==2"), ("c", "javascript", js(("x", 1))),
                                 ("d", "javascript", js(("x", 1))), ("e", "javascript", js(("x", 1))), ("f", "python", "p==1")], TEXTS)
    new = spark.createDataFrame([("a", "javascript", js(("x", 1), ("z", 3))),       # y goes, z comes
                                 ("b", "python", "p==1\nq==2"),                     # the same
                                 ("c", "javascript", js(("x", 1))[:-1]),            # no longer JSON: skipped as a whole
                                 ("d", "javascript", '{"private": true}'),          # no dependencies key: skipped as a whole
                                 ("e", "javascript", js()),                         # empty: its edges go
                                 ("f", "javascript", js(("n", 9))),                 # its other language stays as it was
                                 ("g", "python", "p==1\np==1")], TEXTS)
    hashes = old.select("url", "language", F.sha2("text", 256).alias("hash"))
    changed = materialize(manifests.changed_manifests(new, hashes, "url"))
    assert sorted(r.url for r in changed.collect()) == ["a", "c", "d", "e", "f", "g"]
    edges = manifests.npm_train_edges(old.where("language = 'javascript'")).select("url", "purl").unionByName(
        manifests.pypi_train_edges(old.where("language = 'python'")).select("url", "purl"))
    got = sorted(tuple(r) for r in manifests.edge_changes(changed, edges, "url").select("url", "purl", "sign").collect())
    assert got == [("a", "pkg:npm/y@2", -1), ("a", "pkg:npm/z@3", 1), ("e", "pkg:npm/x@1", -1), ("f", "pkg:npm/n@9", 1), ("g", "pkg:pypi/p@1", 1)]


def test_changed_edges_by_id(spark):
    apps = spark.createDataFrame([(1, "a"), (2, "b")], "id long, url string")
    pkgs = spark.createDataFrame([(10, "pkg:npm/x@1"), (11, "pkg:npm/y@2"), (12, "pkg:pypi/p@1")], "id long, name string")
    deps = spark.createDataFrame([(1, 10), (1, 12), (2, 10)], "application_id long, package_id long")
    repos = spark.createDataFrame([("a", "javascript", js(("y", 2))), ("b", "javascript", js(("x", 1)))], TEXTS)
    stored = spark.createDataFrame([("b", "javascript", js(("x", 1)))], TEXTS).select("url", "language", F.sha2("text", 256).alias("hash"))
    signed, hashes = ingest.changed_edges(repos, stored, apps, pkgs, deps)
    assert sorted(map(tuple, signed.collect())) == [(1, 10, -1), (1, 11, 1)]
    assert [(r.url, r.language) for r in hashes.collect()] == [("a", "javascript")]


def test_newest_manifest_of_each_branch(spark):
    rows = [(1, "main", "python", "a==1", 1), (1, "main", "python", "b==1", 2), (1, "dev", "python", "c==1", 1),
            (1, "dev", "javascript", js(("x", 1)), 1), (2, None, "python", "d==1", 1), (2, None, "python", "e==1", 1)]
    df = spark.createDataFrame(rows, "application_id long, branch string, language string, text string, retrieved int")
    newest = manifests.latest_by_branch(df)
    assert sorted((r.application_id, r.branch or "", r.text) for r in newest.collect() if r.language == "python") == [
        (1, "dev", "c==1"), (1, "main", "b==1"), (2, "", "e==1")]
    u = manifests.repo_dependency_union(newest.where("branch is not null"), ["application_id", "branch"])
    assert sorted((r.branch, r.language, *r.purls) for r in u.collect()) == [
        ("dev", "python", "pkg:npm/x@1.0.0", "pkg:pypi/c@1"), ("main", "python", "pkg:pypi/b@1")]


def test_gate_stops_a_version(spark, tmp_path):
    now = F.to_timestamp(F.lit("2001-01-01"))
    good = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string").withColumn("retrieved", now)
    assert constraints.write_checked(good, str(tmp_path / "good"), constraints.PACKAGES).count() == 2
    bad = good.unionByName(good.where("id = 1")).unionByName(good.where("id = 2").withColumn("retrieved", F.lit(None).cast("timestamp")))
    with pytest.raises(constraints.ConstraintError) as e:
        constraints.write_checked(bad, str(tmp_path / "bad"), constraints.PACKAGES)
    assert e.value.broken == {"packages.name unique": 2, "packages not null": 1}
    assert constraints.write_checked(good.limit(0), str(tmp_path / "none"), constraints.PACKAGES).count() == 0


def test_ingest_of_a_bad_batch_commits_nothing(spark, tmp_path):
    """A landed page without a repository name breaks `applications not null`."""
    from affinity.streaming import ingest as stream
    root = str(tmp_path / "tables")

    def page(name):
        node = {"nameWithOwner": name, "url": "https://example.org/r", "watchers": {"totalCount": 1}, "object": {"text": "p==1"}}
        import json
        return json.dumps({"data": {"search": {"edges": [{"cursor": "c", "node": node}], "repositoryCount": 1}}})

    from affinity import schemas
    for n, name in enumerate(("good", None)):
        folder = tmp_path / f"page{n}"
        folder.mkdir()
        (folder / "p.json").write_text(page(name))
        pages = spark.read.schema(schemas.SEARCH_PAGE).json(str(folder))
        batch = stream.merge_batch(spark, root, "python")
        if name:
            batch(pages, n)
        else:
            with pytest.raises(constraints.ConstraintError):
                batch(pages, n)
        assert versions.newest(spark, root) == 1
    assert [r.name for r in stream.read_version(spark, root, "applications").collect()] == ["good"]


def test_two_writers_of_one_version(spark, tmp_path):
    root = str(tmp_path / "v")
    number = versions.following(spark, root)
    versions.commit(spark, root, number, "first.label")
    with pytest.raises(RuntimeError, match="already committed"):
        versions.commit(spark, root, number, "second")
    assert versions.commits(spark, root) == {number: "first.label"}
    # a writer that died while writing its marker has committed nothing, and its number isn't used again
    (tmp_path / "v" / "_commits" / f"{number + 1:010d}").touch()
    assert versions.newest(spark, root) == number and versions.following(spark, root) == number + 2


def test_violating_keys(spark):
    apps = spark.createDataFrame([(1, "u", "n"), (1, "u", None), (2, None, "n")], "id long, url string, name string").select(
        "*", F.lit("h").alias("hash"), F.lit("t").alias("retrieved"))
    pkgs = spark.createDataFrame([(10, "p", "t")], "id long, name string, retrieved string")
    deps = spark.createDataFrame([(1, 10), (1, 10), (3, 10), (3, 11), (None, None)], "application_id long, package_id long")
    sim = spark.createDataFrame([(10, 11, None), (11, 10, 0.5)], "package_a long, package_b long, similarity double")
    got = sorted(tuple(r) for r in constraints.violating_keys(apps, pkgs, deps, sim).collect())
    assert got == [("applications not null", "NULL", 1), ("applications not null", "u", 1), ("applications.url unique", "u", 2),
                   ("dependencies pair unique", "1,10", 2), ("dependencies.application_id references applications", "3", 2),
                   ("dependencies.package_id references packages", "11", 1), ("similarity not null", "10,11", 1),
                   ("similarity.package_a references packages", "11", 1), ("similarity.package_b references packages", "11", 1)]
    counts = {r.rule: r.violations for r in constraints.check_constraints(apps, pkgs, deps, sim).collect()}
    assert len(counts) == 11 and counts["applications not null"] == 2 and counts["packages.name unique"] == 0


def test_an_id_moves_once_for_all_rules_of_its_parent(spark):
    """Ids of every referring column are counted in one grouping by the id alone; names of rules aren't moved."""
    apps = spark.createDataFrame([(1,), (None,)], "id long")
    pkgs = spark.createDataFrame([(10,), (10,), (None,)], "id long")
    deps = spark.createDataFrame([(1, 10), (2, 12), (2, 12), (None, 12), (1, None)], "application_id long, package_id long")
    sim = spark.createDataFrame([(12, 10), (10, 12), (12, 13), (None, 13)], "package_a int, package_b int")
    found = constraints.dangling_keys({"applications": apps, "packages": pkgs, "dependencies": deps, "similarity": sim})
    assert sorted(tuple(r) for r in found.collect()) == [
        ("dependencies.application_id references applications", "2", 2), ("dependencies.package_id references packages", "12", 3),
        ("similarity.package_a references packages", "12", 2), ("similarity.package_b references packages", "12", 1),
        ("similarity.package_b references packages", "13", 2)]
    moved = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(" in line]
    assert moved and not any("rule" in line for line in moved)


def test_pypi_and_npm_are_the_ecosystems_of_purls(spark):
    df = spark.createDataFrame([("pkg:npm/@a/b@1",), ("pkg:pypi/c@2",)], "p string")
    assert [r.e for r in df.select(purl.ecosystem("p").alias("e")).collect()] == [purl.NPM, purl.PYPI]


def test_both_manifests_come_from_one_row(spark):
    """One pass over the lines for both languages, and the same rows as each language on its own."""
    from affinity.sources import corpus
    from inputs import SMOKE
    both = corpus.manifests(spark, SMOKE)
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_linenumber") <= 2 and plan.count("Aggregate [l_orderkey") <= 2 and "Union" not in plan
    each = corpus.manifests(spark, SMOKE, language="javascript").unionByName(corpus.manifests(spark, SMOKE, language="python"))
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, each.collect()))
