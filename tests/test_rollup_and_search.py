"""Download windows from rolled-up sums, and substring search through trigram postings."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from affinity.operators import rollup, text_search
from affinity.plans import registry
from affinity.session import scratch_path
from affinity.sources import corpus
from inputs import SMOKE


# ------------------------------------------------------------------ rollup

def test_cover_adds_up_to_the_window():
    rng = random.Random(4)
    for _ in range(500):
        start = dt.date(1999, 1, 1) + dt.timedelta(days=rng.randrange(900))
        end = start + dt.timedelta(days=rng.randrange(70))
        days = {}
        for p in rollup.cover(start, end):
            y, m = divmod(p.month, 100)
            first = dt.date(y, m, p.first or 1)
            last = dt.date(y, m, p.last) if p.last else rollup.back(dt.date(y, m, 1), -1) - dt.timedelta(days=1)
            assert p.first is None or last.day - first.day < 16
            for i in range((last - first).days + 1):
                day = first + dt.timedelta(days=i)
                days[day] = days.get(day, 0) + p.sign
        want = {start + dt.timedelta(days=i): 1 for i in range((end - start).days + 1)}
        assert {d: n for d, n in days.items() if n} == want


def test_windows_as_the_column_functions_give_them(spark):
    from affinity.functions import dates
    days = [dt.date(2000, 1, 1) + dt.timedelta(days=7 * i) for i in range(60)] + [dt.date(2000, 2, 29), dt.date(2001, 3, 31)]
    w = dates.download_windows("day")
    df = spark.createDataFrame([(d,) for d in days], "day date").select("day", *[c for name in rollup.WINDOWS for c in w[name]])
    for day, a, b, c, d in df.collect():
        assert rollup.windows_of(day) == {"last_month": (a, b), "year_ago": (c, d)}


def _tables(spark, events):
    days = rollup.store(rollup.daily(events, "k", "t", "n"), scratch_path(spark, "days"))
    return days, rollup.store(rollup.monthly(days), scratch_path(spark, "months"))


def _files(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan parquet" in line]


@pytest.mark.parametrize("as_of", [["2001-10-31"], ["2000-02-29", "1998-07-09"]])
def test_rolled_windows_equal_one_pass_over_the_events(spark, as_of):
    dates_ = [dt.date.fromisoformat(d) for d in as_of]
    li = corpus.shipments(spark, SMOKE).select(F.col("l_partkey").alias("k"), F.col("l_shipdate").alias("t"), F.col("l_quantity").alias("n"))
    days, months = _tables(spark, li)
    got = {(r.as_of, r.key): (r.last_month, r.year_ago) for r in rollup.window_downloads(days, months, dates_).collect()}
    want = {(d, r.l_partkey): (r.monthly_downloads_last_month, r.monthly_downloads_a_year_ago)
            for d in dates_ for r in corpus.shipping_metadata(spark, SMOKE, d.isoformat()).collect()}
    assert got == {k: v for k, v in want.items() if v != (0, 0)}


def test_only_edge_days_and_touched_months_are_read(spark):
    li = corpus.shipments(spark, SMOKE).select(F.col("l_partkey").alias("k"), F.col("l_shipdate").alias("t"), F.col("l_quantity").alias("n"))
    days, months = _tables(spark, li)
    df = rollup.window_downloads(days, months, [dt.date(2001, 10, 31)])
    scans = _files(df)
    assert len(scans) == 2 and all("PartitionFilters: [" in s and "month" in s.split("PartitionFilters: [")[1] for s in scans)
    edge = [s for s in scans if "day" in s.split("ReadSchema")[1]]
    assert len(edge) == 1 and "day" in edge[0].split("PushedFilters: [")[1]


def test_merged_days_and_odd_rows(spark):
    schema = "k long, t timestamp, n double"
    t = [dt.datetime(2001, 10, d, 12) for d in (1, 15, 30, 31)] + [dt.datetime(2001, 9, 30), dt.datetime(2000, 10, 31, 23)]
    a = [(1, x, 2.0) for x in t] + [(None, t[0], 1.0), (2, None, 1.0), (2, t[1], None), (3, t[1], 4.0)]
    b = [(3, t[1], -4.0), (1, t[1], 5.0), (4, dt.datetime(2001, 10, 2), 7.0)]
    day = dt.date(2001, 10, 31)
    da, db = (rollup.daily(spark.createDataFrame(x, schema), "k", "t", "n") for x in (a, b))
    days = rollup.merge_amounts(da, db)
    months = rollup.merge_amounts(rollup.monthly(da), rollup.monthly(db))
    rows = sorted(tuple(r) for r in rollup.window_downloads(days, months, [day, day]).collect())
    assert rows == [(day, 1, 15, 2), (day, 4, 7, 0)]
    none = spark.createDataFrame([], schema)
    assert rollup.window_downloads(*_tables(spark, none), [day]).count() == 0
    assert rollup.window_downloads(days, months, []).count() == 0


# ------------------------------------------------------------------ search

WORDS = ["ring", "red", "wid", "get", "Straße", "日本語", "a", "%", "_x"]


def _texts(n, seed=3):
    rng = random.Random(seed)
    return [(i, i % 7, "-".join(rng.choice(WORDS) for _ in range(rng.randrange(9)))) for i in range(n)]


@pytest.fixture(scope="module")
def index(spark):
    rows = _texts(400) + [(900, 1, None), (901, 1, ""), (None, 1, "red-ring"), (902, None, "red-ring"),
                          (903, 2, "red"), (903, 2, "ring"), (904, 3, "red-ring " * 3000)]
    df = spark.createDataFrame(rows, "id long, part long, text string")
    return rows, text_search.build(df, ["id", "part"], text_search.display_text(["text"]), scratch_path(spark, "search"))


@pytest.mark.parametrize("query", ["ring", "RED-wid", "d-r", "日本語", "straße-日本", "%-_x", "nowhere", "ri", "", "a",
                                   "ring-red-wid-get-a", "ring red-ring"])
def test_search_equals_a_scan(spark, index, query):
    rows, ix = index
    want = sorted((i, p) for i, p, t in rows if i is not None and p is not None and query.lower() in (t or "").lower())
    assert sorted(tuple(r) for r in text_search.search(spark, ix, query).collect()) == want


def test_grams_of_odd_texts(spark):
    texts = ["", "ab", "abc", "a\nb\r😀c", "aaaa", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(text_search.grams_of(F.col("t"))).collect()]
    assert [sorted(g or []) for g in got] == [sorted({t[i:i + 3] for i in range(len(t or "") - 2)}) for t in texts]


def test_two_texts_of_one_key_dont_add_up(spark, index):
    rows, ix = index
    assert (903, 2) not in {tuple(r) for r in text_search.search(spark, ix, "red-ring").collect()}


def test_texts_without_candidates_are_not_read(spark, monkeypatch):
    """Folders of texts are pruned by the candidates' buckets, postings by the grams' buckets."""
    monkeypatch.setattr(text_search, "TEXTS_A_BUCKET", 10)
    rows = [(i, f"common text number {i}" + (" needle" if i == 77 else "")) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, text string")
    ix = text_search.build(df, ["id"], text_search.display_text(["text"]), scratch_path(spark, "search"))
    assert ix.text_buckets == 100
    found = text_search.search(spark, ix, "number 77 needle")
    assert [r.id for r in found.collect()] == [77]
    plan = found._jdf.queryExecution().executedPlan()
    assert "dynamicpruning" in plan.toString()
    postings = text_search.candidates(spark, ix, ["nee"])
    scan = postings._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "gram_bucket" in scan.split("PartitionFilters: [")[1].split("]")[0]


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, text string")
    ix = text_search.build(df, ["id"], text_search.display_text(["text"]), scratch_path(spark, "search"))
    assert text_search.search(spark, ix, "ring").count() == 0 and text_search.search(spark, ix, "r").count() == 0


def test_indexed_query_equals_the_scan(spark):
    scan = registry.browse.search_text(registry.batch_recommendations(spark, SMOKE), "RED-Widget", registry._SEARCH_COLS)
    got = registry.QUERIES["search_text_indexed"](spark, SMOKE)
    rows = sorted(tuple(r) for r in got.collect())
    assert rows and rows == sorted(tuple(r) for r in scan.select("request_id", "rank").collect())


def test_grams_are_made_once_a_word_not_once_a_text(spark):
    """Texts that share their words share the gram postings; a text has one place for each of its words."""
    rows = [(i, f"red-widget-{i % 5} https://example.org/package/red-widget-{i % 5} small") for i in range(200)]
    ix = text_search.build(spark.createDataFrame(rows, "id long, text string"), ["id"], F.col("text"), scratch_path(spark, "search"))
    words = {w for _, t in rows for w in t.split(" ")}
    assert spark.read.parquet(ix.postings).count() == sum(len({w[i:i + 3] for i in range(len(w) - 2)}) for w in words)
    assert spark.read.parquet(ix.places).count() == 3 * len(rows)


@pytest.mark.parametrize("query", ["red ring", "ed ring bl", " ring ", "g b", "ring  red", "ring blue red", "blue", "x ring blue y"])
def test_parts_of_a_query_are_found_in_words(spark, query):
    """A part may end, begin or be a word, as its place in the query says; spaces at the ends count."""
    texts = ["red ring blue", "redring blue", "red  ring", "ring  red", "ring red blue ring blue red", "a red ring blue y",
             "xx ring blue yy", "ring", " ring ", "bluering", "ring blu e"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    ix = text_search.build(df, ["id"], F.col("text"), scratch_path(spark, "search"))
    assert sorted(r.id for r in text_search.search(spark, ix, query).collect()) == [i for i, t in enumerate(texts) if query in t]
