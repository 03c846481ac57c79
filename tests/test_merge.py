"""Upserts: idempotence, id stability, NULL overwrite."""

import datetime as dt

from pyspark.sql import functions as F

from affinity.operators import joins, merge

T0, T1 = dt.datetime(2020, 1, 1), dt.datetime(2020, 2, 1)


def test_assign_ids_dense_in_order(spark):
    keys = spark.createDataFrame([(f"k{i:03d}",) for i in range(97, -1, -1)], "k string").repartition(5)
    got = sorted((r.k, r.id) for r in merge.assign_ids(keys, [F.col("k")], 10).collect())
    assert got == [(f"k{i:03d}", 11 + i) for i in range(98)]


def test_upsert_applications_idempotent(spark):
    ex = spark.createDataFrame([(1, "u1", "a", 5, "h1", T0), (2, "u2", "b", 6, "h2", T0)],
                               "id long, url string, name string, followers int, hash string, retrieved timestamp")
    inc = spark.createDataFrame([("u2", "b2", 7, "h2x", T1), ("u3", "c", 1, "h3", T1), ("u3", "c", 1, "h3", T1)],
                                "url string, name string, followers int, hash string, retrieved timestamp")
    once = merge.upsert_applications(ex, inc)
    twice = merge.upsert_applications(once, inc)
    rows = sorted(tuple(r) for r in once.collect())
    assert rows == [(1, "u1", "a", 5, "h1", T0), (2, "u2", "b2", 7, "h2x", T1), (3, "u3", "c", 1, "h3", T1)]
    assert sorted(tuple(r) for r in twice.collect()) == rows


def test_upsert_packages_keeps_metadata(spark):
    ex = spark.createDataFrame([(4, "pkg:npm/a@1", 100, T0)], "id long, name string, downloads long, retrieved timestamp")
    names = spark.createDataFrame([("pkg:npm/a@1",), ("pkg:npm/b@2",)], "name string")
    out = sorted(tuple(r) for r in merge.upsert_packages(ex, names, F.lit(T1)).select(
        "id", "name", "downloads", "retrieved").collect())
    assert out == [(4, "pkg:npm/a@1", 100, T1), (5, "pkg:npm/b@2", None, T1)]


def test_insert_dependencies_ignores_duplicates(spark):
    a = spark.createDataFrame([(1, 2), (1, 3)], "application_id long, package_id long")
    b = spark.createDataFrame([(1, 3), (1, 3), (2, 3)], "application_id long, package_id long")
    assert sorted(tuple(r) for r in merge.insert_dependencies(a, b).collect()) == [(1, 2), (1, 3), (2, 3)]


def test_update_from_overwrites_with_null(spark):
    t = spark.createDataFrame([(1, 10), (2, 20)], "id long, v long")
    s = spark.createDataFrame([(1, None)], "id long, v long")
    assert sorted(tuple(r) for r in joins.update_from(t, s, "id", ["v"]).collect()) == [(1, None), (2, 20)]
