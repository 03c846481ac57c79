"""Column functions: dates, purls, requirement lines, categories."""

import datetime as dt

from pyspark.sql import functions as F

from affinity.functions import categories, dates, purl, requirements
from affinity.operators import manifests


def test_month_delta_goldens(spark):
    cases = [("2018-10-31", 0, "2018-10-31"), ("2018-10-31", 1, "2018-09-30"), ("2018-10-31", 12, "2017-10-31"),
             ("2018-10-31", 60, "2013-10-31"), ("2018-10-31", 224, "2000-02-29"), ("2018-10-31", 8, "2018-02-28"),
             ("2020-01-01", 1, "2019-12-01")]
    df = spark.createDataFrame([(dt.date.fromisoformat(d), n) for d, n, _ in cases], "d date, n int")
    got = [str(r[0]) for r in df.select(dates.month_delta("d", F.col("n"))).collect()]
    assert got == [e for _, _, e in cases]


def test_npm_purls(spark):
    deps = {"accepts": "~1.3.7", "array-flatten": "^1.1.1", "content-type": "~1.0.4", "cookie": "0.4.0",
            "qs": "6.7.0"}
    import json
    df = spark.createDataFrame([(1, json.dumps({"dependencies": deps}))], "id long, text string")
    got = sorted(r.purl for r in manifests.npm_serve_purls(df).collect())
    assert got == sorted(["pkg:npm/accepts@1.3.7", "pkg:npm/array-flatten@1.1.1", "pkg:npm/content-type@1.0.4",
                          "pkg:npm/cookie@0.4.0", "pkg:npm/qs@6.7.0"])


REQUIREMENTS = """
    fonttools[lxml,unicode,ufo]>=4.0.2
    ufo2ft[pathops]<=2.9.1
    defcon[lxml]===0.6.0
    skia-pathops
    # only used for DesignSpaceDocumentReader in fontbuild
    MutatorMath==2.1.2rc0
    # for woff2
    brotli>=1.0.7, <1.0.3
    joblib>1.0.7, <=1.0.3
    requests>0.0.1
    $$$NOT A DEPENDENCY, SHOULD NOT BE PARSED$$$
"""


def test_pypi_serve_purls(spark):
    df = spark.createDataFrame([(1, REQUIREMENTS)], "id long, text string")
    got = sorted(r.purl for r in manifests.pypi_serve_purls(df).collect())
    assert got == sorted(["pkg:pypi/fonttools@4.0.2", "pkg:pypi/ufo2ft@2.9.1", "pkg:pypi/defcon@0.6.0",
                          "pkg:pypi/skia-pathops", "pkg:pypi/MutatorMath@2.1.2rc0", "pkg:pypi/brotli@1.0.7",
                          "pkg:pypi/joblib@1.0.3", "pkg:pypi/requests"])


def test_pypi_train_edges(spark):
    df = spark.createDataFrame([(1, "numpy>=1.17.4\nvisdom\n-r other.txt\ntorch==1.2.0 ; python_version>'3'")],
                               "id long, text string")
    got = sorted(r.purl for r in manifests.pypi_train_edges(df).collect())
    assert got == ["pkg:pypi/numpy@1", "pkg:pypi/torch@1", "pkg:pypi/visdom@"]


def test_npm_train_edges_skip_non_strings_and_corrupt(spark):
    rows = [(1, '{"dependencies": {"react": "^16.13.1", "x": 3, "y": "latest", "z": "~2.0"}}'),
            (2, '{"dependencies": {"a": "1.0.0"'),   # corrupt
            (3, "{'dependencies': {'a': '1'}}"),     # single quotes are not JSON
            (4, '{"name": "no-deps"}')]
    df = spark.createDataFrame(rows, "id long, text string")
    got = sorted((r.id, r.purl) for r in manifests.npm_train_edges(df).collect())
    assert got == [(1, "pkg:npm/react@16"), (1, "pkg:npm/z@2")]
    assert sorted(r.id for r in manifests.corrupt_manifests(df).collect()) == [2, 3]
    assert sorted(r.id for r in manifests.npm_applications(df).collect()) == [1]


def test_strip_to_major_and_split(spark):
    df = spark.createDataFrame([("pkg:npm/@reach/router@1.3.1",), ("pkg:pypi/requests",), ("pkg:npm/a@latest",)],
                               "p string")
    got = [r[0] for r in df.select(purl.strip_to_major("p")).collect()]
    assert got == ["pkg:npm/@reach/router@1", "", ""]
    r = df.select(purl.purl_name("p"), purl.ecosystem("p")).first()
    assert tuple(r) == ("@reach/router", "npm")


def test_url_without_numeric_version(spark):
    df = spark.createDataFrame([("pkg:pypi/x@",), ("pkg:npm/d3@5",), ("pkg:maven/y@1",)], "p string")
    got = [r[0] for r in df.select(purl.package_url("p")).collect()]
    assert got == ["https://pypi.org/project/pkg:pypi/x@", "https://npmjs.com/package/d3", None]


def test_clean_categories(spark):
    df = spark.createDataFrame([(["critical", ",,comma", "\\{braces\\}", "'quoted\""],), ([],), (None,), ([","],)],
                               "c array<string>")
    got = [r[0] for r in df.select(categories.clean_categories("c")).collect()]
    assert got == [["critical", "comma", "\\braces\\", "quoted"], None, None, []]


def test_topics_order(spark):
    df = spark.createDataFrame([(["Topic :: A", "License :: X", "Topic :: B", "Topic :: C"],), (["Topic :: A"],)],
                               "c array<string>")
    got = [r[0] for r in df.select(categories.topics_from_classifiers("c")).collect()]
    assert got == [["B", "C", "A"], ["A"]]


def test_requirement_line_grammar(spark):
    df = spark.createDataFrame([("a==1,>=0.5",), ("-e git+https://x",), ("b [x] ~= 2.1",), ("c; os_name=='nt'",),
                                ("d # note",), ("???",)], "l string")
    got = [None if r[0] is None else (r[0].name, [tuple(s) for s in r[0].specs])
           for r in df.select(requirements.parse_line(F.col("l"))).collect()]
    assert got == [("a", [("==", "1"), (">=", "0.5")]), None, ("b", [("~=", "2.1")]), ("c", []), ("d", []), None]


def test_strict_json(spark):
    from affinity.functions.json import strict_json
    good = ['{"a":1}', ' {"a":"x} ]"} ', "[1,2]", "null", '"x"', "12"]
    bad = ['{"a":1} garbage', "{} {}", '{"a":1}}', "{}] junk", "{},{}", "", "  ", "{'a':1}"]
    df = spark.createDataFrame([(t,) for t in good + bad + [None]], "text string")
    got = {r.text: r.ok for r in df.select("text", strict_json("text").isNotNull().alias("ok")).collect()}
    assert {t for t, ok in got.items() if ok} == set(good)


def test_fragment_cannot_close_its_brace(spark):
    df = spark.createDataFrame([(1, '"a":"1"}, "x":{"b":"2"'), (2, ',"a": "^1", "b": "2",')], "id long, text string")
    assert sorted(tuple(r) for r in manifests.npm_fragment_purls(df).collect()) == [(2, "pkg:npm/a@1"), (2, "pkg:npm/b@2")]
