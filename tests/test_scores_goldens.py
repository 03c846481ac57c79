"""The reference's scoring fixture: five packages, Jaccard similarities, literal goldens."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from affinity.operators import scores, similarity
from affinity.functions import scoring

APPS = {1: [2], 2: [1, 2], 4: [1, 2], 5: [1, 2], 8: [1]}
PACKAGES = [
    (1, "pkg:npm/countup.js@2", 400451, 0, None, "2019-03-14 19:42:34.846"),
    (2, "pkg:npm/d3@5", 5306004, 2966818, ["dom", "visualization", "svg", "animation", "canvas"],
     "2020-04-20 17:59:10.332"),
    (4, "pkg:npm/globe.gl@2", 2221, 771, ["webgl", "three", "globe"], "2020-04-10 21:13:59.518"),
    (5, "pkg:npm/react-resize-detector@4", 0, 1957316, ["react", "resize", "detector"], None),
    (8, "pkg:npm/@reach/router@1", 0, 0, ["react", "react router"], "2020-02-27 20:14:25.729"),
]


@pytest.fixture(scope="module")
def fixture_tables(spark):
    pk = spark.createDataFrame(
        [(i, n, a, b, c, dt.datetime.fromisoformat(m) if m else None, dt.datetime(2020, 4, 26))
         for i, n, a, b, c, m in PACKAGES],
        "id long, name string, monthly_downloads_last_month long, monthly_downloads_a_year_ago long, "
        "categories array<string>, modified timestamp, retrieved timestamp")
    rows = []
    for a, ua in APPS.items():
        for b, ub in APPS.items():
            if a != b:
                j = len(set(ua) & set(ub)) / len(set(ua) | set(ub))
                if j:
                    rows.append((a, b, j))
    sim = spark.createDataFrame(rows, "package_a long, package_b long, similarity double")
    sim = sim.withColumn("bounded_similarity", scoring.bounded_similarity("similarity"))
    return pk, sim


def test_bounded_similarity(fixture_tables):
    _, sim = fixture_tables
    got = [r[0] for r in sim.orderBy("package_a", "package_b").select("bounded_similarity").collect()]
    assert got == [5, 5, 5, 5, 10, 10, 5, 5, 10, 10, 5, 5, 10, 10, 5, 5, 5, 5]


def test_popularity_and_trends(fixture_tables):
    pk, sim = fixture_tables
    p = scores.score_packages(pk, sim).orderBy("id").collect()
    assert [r.bounded_popularity for r in p] == [8, 10, 10, 10, 8]
    assert [r.absolute_trend for r in p] == [10, 5, 6, 1, 5]
    assert [r.relative_trend for r in p] == [10, 2, 2, 1, 1]


def test_display_columns(fixture_tables):
    pk, sim = fixture_tables
    p = scores.score_packages(pk, sim).orderBy("id").collect()
    assert [(r.short_name, r.url, r.display_date) for r in p] == [
        ("countup.js@2", "https://npmjs.com/package/countup.js", "2019-03-14"),
        ("d3@5", "https://npmjs.com/package/d3", "2020-04-20"),
        ("globe.gl@2", "https://npmjs.com/package/globe.gl", "2020-04-10"),
        ("react-resize-detector@4", "https://npmjs.com/package/react-resize-detector", None),
        ("@reach/router@1", "https://npmjs.com/package/@reach/router", "2020-02-27"),
    ]


def test_cosine_on_fixture_baskets(spark):
    edges = spark.createDataFrame([(p, app) for p, apps in APPS.items() for app in apps],
                                  "package_id long, application_id long")
    got = {(r.package_a, r.package_b): r.similarity
           for r in similarity.similarity_pairs(edges).collect()}
    assert got[(2, 4)] == 1.0 and got[(4, 5)] == 1.0
    assert abs(got[(1, 2)] - 0.7071067811865475) < 1e-15
    assert (1, 8) not in got


def test_all_equal_trend_is_null(spark):
    pk = spark.createDataFrame([(1, 5, 5), (2, 5, 5)], "id long, monthly_downloads_last_month long, "
                                                       "monthly_downloads_a_year_ago long")
    assert [r.absolute_trend for r in scores.trends(pk).collect()] == [None, None]


def test_composite_score_double_order(spark):
    # PostgreSQL adds doubles: 0.5 + 2.1 + 0.2 + 0.2 = 3.0000000000000004 → 4
    df = spark.createDataFrame([(0.1, 7, 2, 2)], "similarity double, bp int, at int, rt int")
    got = df.select(scoring.composite_score("similarity", "bp", "at", "rt").alias("s")).first().s
    assert got == 4
