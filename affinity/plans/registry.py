"""Registered queries: one per operator, each with its DuckDB oracle text.

Every query reads the test tables (or data Spark derives from them) in
full; no row caps or id subsets. Array columns are rendered as text in the
registered outputs so that results compare by value with the oracle.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity import oracle as O
from affinity.functions import dates, purl, requirements, scoring
from affinity.operators import (api, browse, constraints, joins, manifests, merge, recommend, rollup, scores, similarity,
                                text_search)
from affinity.session import PACKED, materialize, scratch_path
from affinity.sources import landed
from affinity.session import apply_defaults
from affinity.sources import corpus

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        def run(spark: SparkSession, base: str) -> DataFrame:
            apply_defaults(spark)
            return fn(spark, base)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return deco


def _categories_text(col: str = "categories"):
    return F.array_join(F.col(col), ",")


# ------------------------------------------------------------ shared frames

def sim_table(spark: SparkSession, base: str) -> DataFrame:
    """The similarity table computed from the edges (train side)."""
    return similarity.similarity_frame(corpus.raw_edges(spark, base))


def stored(build: Callable[[], DataFrame]) -> DataFrame:
    """A table written to the checkpoint folder, as the daily train job leaves it to serving."""
    return materialize(build(), codec=PACKED)


def stored_similarity(spark: SparkSession, base: str) -> DataFrame:
    """The similarity table as a training run writes it: ranked, in folders by bucket of package_a."""
    state = similarity.state(corpus.raw_edges(spark, base))
    counts = materialize(state.counts, "counts", PACKED)
    sim = similarity.mirror_pairs(similarity.cosine(counts, materialize(state.degrees, "degrees")))
    bound = similarity.longest_list(counts, corpus.package_names(spark, base).count())
    path = landed.write_similarity(sim, scratch_path(spark, "similarity"), landed.bucket_count(2 * counts.count()),
                                   rank=True, max_neighbours=bound, mirrored=True)
    return spark.read.parquet(path)


def scored_packages(spark: SparkSession, base: str, sim: DataFrame | None = None) -> DataFrame:
    """Scored packages computed from the stored similarity table."""
    return scores.score_packages(corpus.packages(spark, base), sim or stored_similarity(spark, base))


def stored_packages(spark: SparkSession, base: str, sim: DataFrame | None = None) -> DataFrame:
    return stored(lambda: scored_packages(spark, base, sim))


def trained(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """The two tables of one training run: similarity and scored packages."""
    sim = stored_similarity(spark, base)
    return sim, stored_packages(spark, base, sim)


# ------------------------------------------------------ A: sources / scans

@register("scan_dependencies", O.with_ctes("e") + "SELECT app AS application_id, pkg AS package_id FROM e")
def q_scan_dependencies(spark, base):
    """A1: the unique dependency edges."""
    return corpus.dependencies(spark, base)


@register("scan_packages_by_ecosystem", O.with_ctes("pk") +
          "SELECT CASE WHEN name LIKE 'pkg:npm/%' THEN 'npm' ELSE 'pypi' END AS ecosystem, id, name FROM pk "
          "WHERE name LIKE 'pkg:npm/%' OR name LIKE 'pkg:pypi/%'")
def q_scan_packages_by_ecosystem(spark, base):
    """A2: packages of each ecosystem by name prefix."""
    p = corpus.package_names(spark, base)
    of = [p.where(F.col("name").startswith(f"pkg:{e}/")).select(F.lit(e).alias("ecosystem"), "id", "name")
          for e in ("npm", "pypi")]
    return of[0].unionByName(of[1])


# --------------------------------------------------------- E: similarity

@register("baskets", O.with_ctes("e") +
          f"SELECT app AS application_id, chunk, string_agg(CAST(pkg AS VARCHAR), ' ' ORDER BY pkg) AS package_ids FROM "
          f"(SELECT app, pkg, CAST((row_number() OVER (PARTITION BY app ORDER BY pkg) - 1) // {similarity.DEFAULT_CELL_ROWS} "
          f"AS INTEGER) AS chunk FROM e) GROUP BY app, chunk")
def q_baskets(spark, base):
    """Sorted package ids per application (bounded chunks)."""
    b = similarity.baskets(corpus.raw_edges(spark, base))
    return b.select("application_id", "chunk",
                    F.array_join(F.col("package_ids").cast("array<string>"), " ").alias("package_ids"))


@register("similarity_pairs", O.with_ctes("pairs") + "SELECT * FROM pairs")
def q_similarity_pairs(spark, base):
    """Exact cosine, upper triangle, non-zero cells."""
    return similarity.similarity_pairs(corpus.raw_edges(spark, base))


@register("mirror_pairs", O.with_ctes("sim") + "SELECT package_a, package_b, similarity FROM sim")
def q_mirror_pairs(spark, base):
    """E5: both directions of every pair."""
    return similarity.mirror_pairs(similarity.similarity_pairs(corpus.raw_edges(spark, base)))


@register("similarity_frame", O.with_ctes("sim") + "SELECT * FROM sim")
def q_similarity_frame(spark, base):
    """The similarity table with bounded similarity."""
    return sim_table(spark, base)


# ------------------------------------------------------------- F: scores

# Edges in three steps: what the first deliveries hold, then two sets of signed changes; first lines of every
# seventh repository are taken out again by the second.
_CHANGES_SQL = ("WITH e AS (SELECT DISTINCT l_orderkey AS app, l_partkey AS pkg FROM lineitem EXCEPT "
                "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey % 7 = 0 AND l_linenumber = 1), "
                + O.with_ctes("sim")[len("WITH "):].replace(O.CTE["e"] + ",\n", ""))


@register("similarity_incremental", _CHANGES_SQL + "SELECT * FROM sim")
def q_similarity_incremental(spark, base):
    """E6 kept up to date: pair counts and degrees of a first edge table, changed by two sets of signed edges."""
    li = corpus.read_table(spark, base, "lineitem", "l_orderkey", "l_partkey", "l_linenumber").select(
        F.col("l_orderkey").alias("application_id"), F.col("l_partkey").alias("package_id"), "l_linenumber")
    state = similarity.state(li.where("l_linenumber <= 3"))
    sign = lambda df, s: df.select("application_id", "package_id", F.lit(s).alias("sign"))
    second = sign(li.where("l_linenumber between 3 and 4"), 1)          # partly known already
    gone = sign(li.where("l_orderkey % 7 = 0 and l_linenumber = 1").distinct(), -1000)
    third = sign(li.where("l_linenumber > 4"), 1).unionByName(gone)
    for deltas in (second, third):
        state = similarity.State(*(materialize(t, "state") for t in (state.edges, state.counts, state.degrees)))
        state = similarity.merge_state(state, deltas)
    return similarity.scored_mirror(similarity.cosine(state.counts, materialize(state.degrees, "degrees")))


@register("bounded_similarity", O.with_ctes("sim") +
          "SELECT package_a, package_b, bounded_similarity FROM sim")
def q_bounded_similarity(spark, base):
    """width_bucket(similarity, 0, 1, 9)."""
    return sim_table(spark, base).select("package_a", "package_b", "bounded_similarity")


@register("popularity", O.with_ctes("p1") + "SELECT id, popularity FROM p1")
def q_popularity(spark, base):
    """neighbours per package, 0 without any."""
    p = scores.with_popularity(corpus.packages(spark, base), stored_similarity(spark, base))
    return p.select("id", "popularity")


@register("bounded_popularity", O.with_ctes("scored") +
          "SELECT id, popularity, bounded_popularity FROM scored")
def q_bounded_popularity(spark, base):
    """bucket of log10(popularity + 1) between 0 and its maximum."""
    p = scores.with_popularity(corpus.packages(spark, base), stored_similarity(spark, base))
    return scores.bounded_popularity(p).select("id", "popularity", "bounded_popularity")


@register("absolute_trend", O.with_ctes("scored") + "SELECT id, absolute_trend FROM scored")
def q_absolute_trend(spark, base):
    """bucket of log10(last+1) − log10(ago+1) between its min and max."""
    p = scores.fill_null_downloads(corpus.packages(spark, base))
    return scores.trends(p).select("id", "absolute_trend")


@register("relative_trend", O.with_ctes("scored") + "SELECT id, relative_trend FROM scored")
def q_relative_trend(spark, base):
    """bucket of log10(last+1) / (log10(ago+1) + 1) between its min and max."""
    p = scores.fill_null_downloads(corpus.packages(spark, base))
    return scores.trends(p).select("id", "relative_trend")


@register("short_name", O.with_ctes("scored") + "SELECT id, short_name FROM scored")
def q_short_name(spark, base):
    """purl without the `pkg:<eco>/` prefix."""
    return corpus.package_names(spark, base).select("id", purl.short_name("name").alias("short_name"))


@register("npm_url", O.with_ctes("scored") + "SELECT id, url FROM scored WHERE name LIKE 'pkg:npm%'")
def q_npm_url(spark, base):
    """npm package page."""
    p = corpus.package_names(spark, base).where(F.col("name").startswith("pkg:npm"))
    return p.select("id", purl.package_url("name").alias("url"))


@register("pypi_url", O.with_ctes("scored") + "SELECT id, url FROM scored WHERE name LIKE 'pkg:pypi%'")
def q_pypi_url(spark, base):
    """F8: PyPI project page (whole purl appended when it has no numeric version)."""
    p = corpus.package_names(spark, base).where(F.col("name").startswith("pkg:pypi"))
    return p.select("id", purl.package_url("name").alias("url"))


SCORED_COLUMNS = ["id", "name", "short_name", "url", "monthly_downloads_last_month",
                  "monthly_downloads_a_year_ago", "absolute_trend", "relative_trend",
                  "categories", "popularity", "bounded_popularity", "display_date"]


@register("score_packages", O.with_ctes("scored") + "SELECT " + ", ".join(SCORED_COLUMNS) + " FROM scored")
def q_score_packages(spark, base):
    """the whole package refresh in one projection."""
    p = scored_packages(spark, base)
    return p.select(*[_categories_text().alias(c) if c == "categories" else F.col(c)
                      for c in SCORED_COLUMNS])


@register("update_from_join", O.with_ctes("packages", "pop") +
          "SELECT id, pop.popularity AS popularity FROM packages LEFT JOIN pop ON packages.id = pop.package_b")
def q_update_from_join(spark, base):
    """UPDATE packages SET popularity = s.popularity FROM (…) s WHERE id = s.package_b."""
    p = corpus.packages(spark, base).withColumn("popularity", F.lit(None).cast("bigint"))
    upd = joins.update_from(p, scores.popularity(stored_similarity(spark, base)), "id", ["popularity"],
                            source_key="package_b")
    return upd.select("id", "popularity")


@register("fill_null_downloads", O.with_ctes("packages") +
          "SELECT id, coalesce(monthly_downloads_last_month, 0) AS monthly_downloads_last_month, "
          "coalesce(monthly_downloads_a_year_ago, 0) AS monthly_downloads_a_year_ago FROM packages")
def q_fill_null_downloads(spark, base):
    """NULL downloads → 0."""
    p = scores.fill_null_downloads(corpus.packages(spark, base))
    return p.select("id", *scores.DOWNLOAD_COLUMNS)


# -------------------------------------------------------------- D: dates

@register("month_delta",
          "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, "
          "CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH AS DATE) AS back_1, "
          "CAST(CAST(o_orderdate AS DATE) - INTERVAL 12 MONTH AS DATE) AS back_12, "
          "CAST(CAST(o_orderdate AS DATE) - INTERVAL 13 MONTH AS DATE) AS back_13, "
          "CAST(CAST(o_orderdate AS DATE) - INTERVAL 224 MONTH AS DATE) AS back_224 FROM orders")
def q_month_delta(spark, base):
    """Month shifts with the day clamped to the month end."""
    d = (corpus.read_table(spark, base, "orders", "o_orderdate")
         .select(F.to_date("o_orderdate").alias("day")).distinct())
    return d.select("day", *[dates.month_delta("day", n).alias(f"back_{n}") for n in (1, 12, 13, 224)])


@register("download_windows", O.with_ctes("ship") +
          "SELECT l_partkey AS id, last_month AS monthly_downloads_last_month, "
          "year_ago AS monthly_downloads_a_year_ago FROM ship")
def q_download_windows(spark, base):
    """Downloads last month and in the same month a year ago, one pass."""
    m = corpus.shipping_metadata(spark, base)
    return m.select(F.col("l_partkey").alias("id"), *scores.DOWNLOAD_COLUMNS)


# As-of dates of the rolled-up query: a month's last day, a clamped one (leap year) and one within a month.
ROLLED_DATES = [dt.date(2001, 10, 31), dt.date(2000, 2, 29), dt.date(1998, 7, 9)]


def _rolled_sql(day: dt.date) -> str:
    def total(window: str) -> str:
        lo, hi = rollup.windows_of(day)[window]
        return (f"CAST(sum(CASE WHEN CAST(l_shipdate AS DATE) BETWEEN DATE '{lo}' AND DATE '{hi}' "
                f"THEN l_quantity ELSE 0.0 END) AS BIGINT) AS {window}")
    return (f"SELECT DATE '{day}' AS as_of, l_partkey AS id, {total('last_month')}, {total('year_ago')} "
            "FROM lineitem GROUP BY l_partkey")


@register("download_windows_rolled", "SELECT * FROM (" + " UNION ALL ".join(map(_rolled_sql, ROLLED_DATES)) +
          ") WHERE last_month <> 0 OR year_ago <> 0")
def q_download_windows_rolled(spark, base):
    """The windows of three as-of dates from daily and monthly sums, whole months and edge days only."""
    li = corpus.shipments(spark, base)
    days = rollup.store(materialize(rollup.daily(li, "l_partkey", "l_shipdate", "l_quantity"), "days"),
                        scratch_path(spark, "rollup-days"))
    months = rollup.store(materialize(rollup.monthly(days), "months"), scratch_path(spark, "rollup-months"))
    r = rollup.window_downloads(days, months, ROLLED_DATES)
    return r.withColumnRenamed("key", "id")


@register("display_date", O.with_ctes("scored") + "SELECT id, display_date FROM scored")
def q_display_date(spark, base):
    """D3: yyyy-MM-dd of the modified time, NULL kept."""
    p = corpus.packages(spark, base)
    return p.select("id", dates.display_date("modified").alias("display_date"))


# ------------------------------------------------------- G: recommending

def _seed_application(spark, base) -> DataFrame:
    """The repository with the most dependencies (ties: smallest id) — a top-1 report over all edges."""
    sizes = corpus.dependencies(spark, base).groupBy("application_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.orderBy(F.desc("n"), "application_id").limit(1).select("application_id")


def _seed_purls(spark, base) -> DataFrame:
    """That repository's dependencies as full-version purls (`…@<size>.0.0`)."""
    edges = corpus.dependencies(spark, base).join(_seed_application(spark, base), "application_id", "left_semi")
    names = corpus.package_names(spark, base)
    return (edges.join(names, edges["package_id"] == names["id"])
                 .select(F.concat(F.col("name"), F.lit(".0.0")).alias("purl")))


_SEEDS_SQL = ("seeds AS (SELECT DISTINCT pk.id FROM pk JOIN lineitem ON lineitem.l_partkey = pk.id "
              "WHERE lineitem.l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey "
              "ORDER BY count(DISTINCT l_partkey) DESC, l_orderkey LIMIT 1) "
              "AND regexp_matches(pk.name, '@\\d+$'))")
_REC_SELECT = ("SELECT a.short_name AS for_package, b.short_name AS recommended_package, b.url, "
               + O.composite_sql("s.similarity", "b.bounded_popularity", "b.absolute_trend",
                                 "b.relative_trend") + " AS score, "
               "b.absolute_trend, b.relative_trend, b.bounded_popularity, s.bounded_similarity, "
               "b.categories, b.display_date, b.monthly_downloads_last_month, s.similarity, "
               "s.package_a, s.package_b "
               "FROM sim s JOIN scored a ON s.package_a = a.id JOIN scored b ON s.package_b = b.id ")


@register("recommend", O.with_ctes("pk", "sim", "scored", "seeds", extra={"seeds": _SEEDS_SQL}) + _REC_SELECT +
          "WHERE s.package_a IN (SELECT id FROM seeds) AND s.package_b NOT IN (SELECT id FROM seeds) "
          "ORDER BY s.similarity DESC, s.package_a, s.package_b LIMIT 10000")
def q_recommend(spark, base):
    """Recommendations for one application's dependency list."""
    r = recommend.recommend(*trained(spark, base), _seed_purls(spark, base))
    return r.withColumn("categories", _categories_text())




# -------------------------------------------------- B: manifests → purls

_MP = {
    "li": "li AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)",
    "ord": (f"ord AS (SELECT o_orderkey, (o_orderstatus = '{corpus.CORRUPT_STATUS}' AND "
            f"o_orderpriority = '{corpus.CORRUPT_PRIORITY}') AS corrupt FROM orders)"),
    "mp": ("mp AS (SELECT li.l_orderkey AS application_id, pk.*, ord.corrupt FROM li "
           "JOIN pk ON li.l_partkey = pk.id JOIN ord ON ord.o_orderkey = li.l_orderkey)"),
}
O.NEEDS["mp"] = ["pk", "li", "ord"]
O.CTE.update(_MP)
_NPM_OK = f"id % 2 = 0 AND p_size % {corpus.NUMERIC_VERSION_EVERY} <> 0 AND NOT corrupt"
_PY_MAJOR = f"CASE WHEN p_size >= {corpus.VERSIONLESS_MIN_SIZE} THEN '' ELSE CAST(p_size AS VARCHAR) END"
_PY_SERVE = (f"CASE WHEN p_size >= {corpus.VERSIONLESS_MIN_SIZE} THEN '' "
             f"WHEN p_size % {corpus.EXTRAS_EVERY} = 0 THEN '@' || CAST(p_size AS VARCHAR) || '.1' "
             f"ELSE '@' || CAST(p_size AS VARCHAR) || '.0' END")
_NPM_SERVE_SQL = (O.with_ctes("mp") + "SELECT application_id, 'pkg:npm/' || slug || '@' || "
                  f"CAST(p_size AS VARCHAR) || '.0.0' AS purl FROM mp WHERE {_NPM_OK}")
_PY_SERVE_SQL = (O.with_ctes("mp") + f"SELECT application_id, 'pkg:pypi/' || slug || {_PY_SERVE} AS purl "
                 "FROM mp WHERE id % 2 = 1")


def _manifests(spark, base, language=None):
    return corpus.manifests(spark, base, language=language)


def _written_manifests(spark, base, lines="true"):
    """Key, language and text of both languages' manifests, written for queries that parse each language on its own."""
    return materialize(corpus.manifests(spark, base, lines).select("application_id", "language", "text"), "manifests")


@register("manifest_npm_edges", O.with_ctes("mp") +
          "SELECT application_id, 'pkg:npm/' || slug || '@' || CAST(p_size AS VARCHAR) AS purl "
          f"FROM mp WHERE {_NPM_OK}")
def q_manifest_npm_edges(spark, base):
    """B1: package.json `dependencies` → train edges; non-string values skipped."""
    return manifests.npm_train_edges(_manifests(spark, base, "javascript")).select("application_id", "purl")


@register("npm_major_version", O.with_ctes("mp") +
          "SELECT application_id, slug AS dep_name, '^' || CAST(p_size AS VARCHAR) || '.0.0' AS dep_version, "
          f"CAST(p_size AS VARCHAR) AS major FROM mp WHERE {_NPM_OK}")
def q_npm_major_version(spark, base):
    """B2: first digit run of each string version."""
    js = manifests.parse_package_json(_manifests(spark, base, "javascript"))
    e = manifests._dependency_entries(js).where(F.col("dep_version").isNotNull())
    return e.select("application_id", "dep_name", "dep_version",
                    purl.first_digit_run("dep_version").alias("major")).where(F.col("major") != "")


@register("manifest_pypi_edges", O.with_ctes("mp") +
          f"SELECT application_id, 'pkg:pypi/' || slug || '@' || {_PY_MAJOR} AS purl FROM mp WHERE id % 2 = 1")
def q_manifest_pypi_edges(spark, base):
    """Requirements.txt → train edges (major of the first specifier, '' without)."""
    return manifests.pypi_train_edges(_manifests(spark, base, "python")).select("application_id", "purl")


@register("corrupt_manifest_filter", O.with_ctes("mp") +
          "SELECT DISTINCT application_id FROM mp WHERE corrupt AND id % 2 = 0")
def q_corrupt_manifest_filter(spark, base):
    """Package.json texts that are not JSON (skipped as a whole)."""
    return manifests.corrupt_manifests(_manifests(spark, base, "javascript")).select("application_id")


@register("purl_npm", _NPM_SERVE_SQL)
def q_purl_npm(spark, base):
    """Serving-side npm purls, `~`/`^` stripped, full version kept."""
    return manifests.npm_serve_purls(_manifests(spark, base, "javascript")).select("application_id", "purl")


@register("purl_pypi", _PY_SERVE_SQL)
def q_purl_pypi(spark, base):
    """Serving-side PyPI purls, first specifier allowing equality."""
    return manifests.pypi_serve_purls(_manifests(spark, base, "python")).select("application_id", "purl")


@register("npm_fragment", _NPM_SERVE_SQL)
def q_npm_fragment(spark, base):
    """Pasted `"a": "v", …` fragments with stray commas, wrapped and parsed."""
    js = _manifests(spark, base, "javascript")
    frag = js.select("application_id", F.concat(
        F.lit(", "), F.regexp_extract("text", r'"dependencies": \{(.*)\}\}$', 1), F.lit(",")).alias("text"))
    return manifests.npm_fragment_purls(frag).select("application_id", "purl")


@register("parse_dependencies", O.with_ctes("mp") +
          "SELECT application_id, 'javascript' AS language, 'pkg:npm/' || slug || '@' || "
          f"CAST(p_size AS VARCHAR) || '.0.0' AS purl FROM mp WHERE {_NPM_OK} UNION ALL "
          f"SELECT application_id, 'python', 'pkg:pypi/' || slug || {_PY_SERVE} FROM mp WHERE id % 2 = 1")
def q_parse_dependencies(spark, base):
    """Dispatch by manifest language."""
    return manifests.parse_dependencies(_manifests(spark, base)).select("application_id", "language", "purl")


@register("purl_split", O.with_ctes("pk") +
          "SELECT id, regexp_extract(name, '^pkg:([^/]+)/', 1) AS ecosystem, "
          "regexp_extract(name, '^[^/]*/(.*)@[^@]*$', 1) AS package_name FROM pk")
def q_purl_split(spark, base):
    """Ecosystem and name (between the first '/' and the last '@')."""
    p = corpus.package_names(spark, base)
    return p.select("id", purl.ecosystem("name").alias("ecosystem"), purl.purl_name("name").alias("package_name"))


_NL = "chr(10)"
_FULL = ("""'{"name": "app-' || CAST(application_id AS VARCHAR) || '", "dependencies": {' || """
         """coalesce(string_agg('"' || slug || '": ' || CASE WHEN p_size % 10 = 0 THEN CAST(p_size AS VARCHAR) """
         """ELSE '"^' || CAST(p_size AS VARCHAR) || '.0.0"' END, ', ' ORDER BY slug) FILTER (WHERE id % 2 = 0), '') || '}}'""")
_PY_LINE = (f"CASE WHEN p_size >= {corpus.VERSIONLESS_MIN_SIZE} THEN slug "
            f"WHEN p_size % {corpus.EXTRAS_EVERY} = 0 THEN slug || '[extra]==' || CAST(p_size AS VARCHAR) || '.1' "
            f"ELSE slug || '>=' || CAST(p_size AS VARCHAR) || '.0' END")
O.CTE["mtexts"] = (
    "mtexts AS (SELECT application_id, 'javascript' AS language, CASE WHEN n_npm = 0 THEN "
    """'{"name": "app-' || CAST(application_id AS VARCHAR) || '", "private": true}' """
    "WHEN corrupt THEN substring(full_text, 1, length(full_text) - 1) ELSE full_text END AS text FROM ("
    "SELECT application_id, bool_or(corrupt) AS corrupt, count(*) FILTER (WHERE id % 2 = 0) AS n_npm, "
    + _FULL + " AS full_text FROM mp GROUP BY application_id) "
    "UNION ALL SELECT application_id, 'python', '# requirements for app-' || CAST(application_id AS VARCHAR) || "
    + _NL + " || string_agg(" + _PY_LINE + ", " + _NL + " ORDER BY slug) FILTER (WHERE id % 2 = 1) "
    "FROM mp GROUP BY application_id HAVING count(*) FILTER (WHERE id % 2 = 1) > 0)")
O.NEEDS["mtexts"] = ["mp"]


@register("content_hash", O.with_ctes("mtexts") +
          "SELECT application_id, language, sha256(text) AS hash FROM mtexts")
def q_content_hash(spark, base):
    """Change fingerprint of each manifest text (sha-256)."""
    m = _manifests(spark, base)
    return m.select("application_id", "language", F.sha2("text", 256).alias("hash"))


@register("repo_dependency_union", O.with_ctes("mtexts", "mp") +
          "SELECT l.application_id, l.language, coalesce(d.purls, '') AS purls FROM "
          "(SELECT application_id, max(language) AS language FROM mtexts GROUP BY application_id) l LEFT JOIN "
          "(SELECT application_id, string_agg(purl, ' ' ORDER BY purl) AS purls FROM ("
          "SELECT application_id, 'pkg:npm/' || slug || '@' || CAST(p_size AS VARCHAR) || '.0.0' AS purl "
          f"FROM mp WHERE {_NPM_OK} UNION ALL SELECT application_id, 'pkg:pypi/' || slug || {_PY_SERVE} "
          "FROM mp WHERE id % 2 = 1) GROUP BY application_id) d ON l.application_id = d.application_id")
def q_repo_dependency_union(spark, base):
    """Per repository, purls of all its manifests; language = last one found."""
    u = manifests.repo_dependency_union(_manifests(spark, base))
    return u.select("application_id", "language", F.array_join("purls", " ").alias("purls"))


def _dep_lines(lines: str) -> str:
    """Edges of the manifests that list the given lines of lineitem, by the rules of the train side."""
    return (f"SELECT DISTINCT mp.application_id, mp.id % 2 AS eco, CASE WHEN mp.id % 2 = 0 THEN 'pkg:npm/' || slug || '@' || "
            f"CAST(p_size AS VARCHAR) ELSE 'pkg:pypi/' || slug || '@' || {_PY_MAJOR} END AS purl, "
            f"(mp.id % 2 = 1 OR ({_NPM_OK.replace('id %', 'mp.id %')})) AS edge, corrupt FROM mp JOIN lineitem ON l_orderkey = application_id "
            f"AND l_partkey = mp.id WHERE {lines}")


# Two deliveries of the same repositories' manifests: which lines of lineitem they list (our choice).
FIRST_LINES = "l_linenumber > 1 or l_orderkey % 5 <> 0"
SECOND_LINES = "l_linenumber <> 2 or l_orderkey % 7 <> 0"


@register("manifest_changes", O.with_ctes("mp") + f"""
, was AS ({_dep_lines(FIRST_LINES)}), now AS ({_dep_lines(SECOND_LINES)}),
readable AS (SELECT DISTINCT application_id, eco FROM now WHERE eco = 1 OR NOT corrupt)
SELECT application_id, purl, 1 AS sign FROM (SELECT application_id, purl FROM now WHERE edge
  EXCEPT SELECT application_id, purl FROM was WHERE edge)
UNION ALL
SELECT application_id, purl, -1 FROM (
  SELECT was.application_id, purl FROM was JOIN readable r ON r.application_id = was.application_id AND r.eco = was.eco WHERE edge
  EXCEPT SELECT application_id, purl FROM now WHERE edge)""")
def q_manifest_changes(spark, base):
    """B12 → B1/B3/C3: only manifests with a new fingerprint are parsed; their edges come as signed rows."""
    first, second = _written_manifests(spark, base, FIRST_LINES), corpus.manifests(spark, base, SECOND_LINES)
    stored_hashes = first.select("application_id", "language", F.sha2("text", 256).alias("hash"))
    edges = manifests.npm_train_edges(first.where(F.col("language") == "javascript")).select("application_id", "purl").unionByName(
        manifests.pypi_train_edges(first.where(F.col("language") == "python")).select("application_id", "purl"))
    changed = materialize(manifests.changed_manifests(second, stored_hashes), "changed")
    return manifests.edge_changes(changed, edges).select("application_id", "purl", "sign")


# Branches: `main` as landed; `dev` lists the second delivery's lines, and an older copy of it the first one's.
@register("repo_dependency_by_branch", O.with_ctes("mp") + f"""
, lines AS (SELECT 'main' AS branch, application_id, id, slug, p_size, corrupt FROM mp
  UNION ALL SELECT DISTINCT 'dev', application_id, id, slug, p_size, corrupt FROM mp JOIN lineitem
    ON l_orderkey = application_id AND l_partkey = id WHERE {SECOND_LINES}
  UNION ALL SELECT DISTINCT 'dev', application_id, id, slug, p_size, corrupt FROM mp JOIN lineitem
    ON l_orderkey = application_id AND l_partkey = id WHERE ({FIRST_LINES}) AND NOT EXISTS (
      SELECT 1 FROM lineitem x WHERE x.l_orderkey = application_id AND (id % 2 = 0 OR x.l_partkey % 2 = 1)
      AND (x.l_linenumber <> 2 OR x.l_orderkey % 7 <> 0))),
purls AS (SELECT application_id, branch, 'pkg:npm/' || slug || '@' || CAST(p_size AS VARCHAR) || '.0.0' AS purl
  FROM lines WHERE {_NPM_OK} UNION ALL SELECT application_id, branch, 'pkg:pypi/' || slug || {_PY_SERVE} FROM lines WHERE id % 2 = 1),
found AS (SELECT application_id, branch, CASE WHEN bool_or(id % 2 = 1) THEN 'python' ELSE 'javascript' END AS language
  FROM lines GROUP BY application_id, branch
  UNION SELECT DISTINCT application_id, 'dev', 'javascript' FROM mp JOIN lineitem ON l_orderkey = application_id AND l_partkey = id
    WHERE ({FIRST_LINES}) AND application_id NOT IN (SELECT application_id FROM lines WHERE branch = 'dev'))
SELECT f.application_id, f.branch, f.language, coalesce(string_agg(purl, ' ' ORDER BY purl), '') AS purls
FROM found f LEFT JOIN purls p ON p.application_id = f.application_id AND p.branch = f.branch GROUP BY 1, 2, 3""")
def q_repo_dependency_by_branch(spark, base):
    """The union per repository and branch, from the newest manifest of each language of a branch."""
    def landed_as(lines, branch, day):
        return corpus.manifests(spark, base, lines).select(
            "application_id", F.lit(branch).alias("branch"), "language", "text", F.to_date(F.lit(day)).alias("retrieved"))

    rows = (landed_as("true", "main", corpus.AS_OF).unionByName(landed_as(FIRST_LINES, "dev", "2001-10-01"))
            .unionByName(landed_as(SECOND_LINES, "dev", corpus.AS_OF)))
    newest = manifests.latest_by_branch(rows)
    u = manifests.repo_dependency_union(newest, ["application_id", "branch"])
    return u.select("application_id", "branch", "language", F.array_join("purls", " ").alias("purls"))


# ------------------------------------------- G7–G9: the API as a table job

def _valid_requests(spark, base):
    return api.validate_requests(corpus.request_bodies(spark, base))


def _written_requests(spark, base):
    """The validated requests, written for queries that read them several times: what was parsed, without the bodies."""
    return materialize(_valid_requests(spark, base).drop("body"), "requests", PACKED)


_BAD = corpus.BAD_BODY_EVERY
O.CTE["cdeps"] = ("cdeps AS (SELECT o_custkey AS c, count(DISTINCT l_partkey) AS n FROM orders "
                  "JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey % 2 = o_custkey % 2 GROUP BY o_custkey)")
O.CTE["vreq"] = (
    "vreq AS (SELECT c_custkey AS request_id, CASE "
    f"WHEN c_custkey % {_BAD} = 1 THEN '{api.ERR_JSON}' "
    f"WHEN c_custkey % {_BAD} = 2 THEN '{api.ERR_KEYS}' "
    f"WHEN c_custkey % {_BAD} = 3 AND coalesce(n, 0) = 0 THEN '{api.ERR_LIST.format('Not supported value')}' "
    f"WHEN c_custkey % {_BAD} = 3 THEN '{api.ERR_LANGUAGE.format('not supported value')}' "
    f"WHEN c_custkey % {_BAD} = 4 THEN '{api.ERR_LOWER.format('NoneType').replace(chr(39), chr(39) * 2)}' "
    f"WHEN c_custkey % {_BAD} IN (5, 6) OR coalesce(n, 0) = 0 THEN "
    f"(CASE WHEN c_custkey % 2 = 0 THEN 'Javascript' ELSE 'Python' END) || "
    f"' dependencies must be non-empty and of type LIST (i.e. [...]).' END AS error, "
    "CAST(5 + c_custkey % 46 AS BIGINT) AS max_recommendations "
    "FROM customer LEFT JOIN cdeps ON cdeps.c = customer.c_custkey)")
O.NEEDS["vreq"] = ["cdeps"]


@register("validate_requests", O.with_ctes("vreq") +
          "SELECT request_id, CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS status, error FROM vreq")
def q_validate_requests(spark, base):
    """API body checks in order; the first failing check is reported."""
    return _valid_requests(spark, base).select("request_id", "status", "error")


@register("api_dependency_list", O.with_ctes("vreq", "pk") +
          "SELECT DISTINCT o_custkey AS request_id, pk.slug AS name, "
          "CASE WHEN l_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) || '.0.0' "
          f"WHEN p_size < {corpus.VERSIONLESS_MIN_SIZE} THEN CAST(p_size AS VARCHAR) || '.0' END AS version "
          "FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN pk ON pk.id = l_partkey "
          "JOIN vreq ON vreq.request_id = o_custkey "
          "WHERE vreq.error IS NULL AND l_partkey % 2 = o_custkey % 2")
def q_api_dependency_list(spark, base):
    """API entries → manifest form: javascript split at the last '@', python one requirement a line."""
    v = _written_requests(spark, base).where(F.col("status") == "ok")
    t = manifests.api_manifest_text(v)
    js, py = (t.where(F.col("language") == x).select("request_id", "text") for x in ("javascript", "python"))
    doc = F.try_parse_json(F.concat(F.lit("{"), F.col("text"), F.lit("}")))
    entries = js.select("request_id", F.explode(F.try_variant_get(doc, "$", "map<string,string>")).alias("name", "version"))
    lines = manifests.requirement_lines(py).select("request_id", F.col("req.name").alias("name"),
                                                   requirements.serve_version(F.col("req.specs")).alias("version"))
    return entries.unionByName(lines)


O.CTE["rseeds"] = (
    "rseeds AS (SELECT DISTINCT o_custkey AS request_id, l_partkey AS id FROM orders "
    "JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey "
    "JOIN vreq ON vreq.request_id = o_custkey "
    f"WHERE vreq.error IS NULL AND l_partkey % 2 = o_custkey % 2 "
    f"AND NOT (l_partkey % 2 = 1 AND p_size >= {corpus.VERSIONLESS_MIN_SIZE}))")
O.NEEDS["rseeds"] = ["vreq"]


@register("strip_to_major", O.with_ctes("rseeds", "pk") +
          "SELECT request_id, pk.name FROM rseeds JOIN pk ON pk.id = rseeds.id")
def q_strip_to_major(spark, base):
    """Request purls cut to `pkg:<eco>/<name>@<major>`; the rest dropped."""
    rp = api.request_purls(_valid_requests(spark, base))
    return recommend.seed_names(rp).select("request_id", "name").distinct()


@register("resolve_seeds", O.with_ctes("rseeds") + "SELECT request_id, id FROM rseeds")
def q_resolve_seeds(spark, base):
    """G1: seed names → package ids per request (semi join on names)."""
    rp = api.request_purls(_valid_requests(spark, base))
    return recommend.resolve_seeds(corpus.package_names(spark, base), recommend.seed_names(rp), ["request_id"])


O.CTE["cand"] = ("cand AS (SELECT rseeds.request_id, s.package_a, s.package_b, s.similarity, s.bounded_similarity "
                 "FROM rseeds JOIN sim s ON s.package_a = rseeds.id WHERE NOT EXISTS (SELECT 1 FROM rseeds o "
                 "WHERE o.request_id = rseeds.request_id AND o.id = s.package_b))")
O.NEEDS["cand"] = ["rseeds", "sim"]


def _batch_candidates(spark, base, sim=None):
    rp = api.request_purls(_written_requests(spark, base))
    ids = recommend.resolve_seeds(corpus.package_names(spark, base), recommend.seed_names(rp), ["request_id"])
    ids = materialize(ids, "seeds", PACKED)  # read by the size check and both joins
    return recommend.candidates(sim or stored_similarity(spark, base), ids, ["request_id"], ids.count())


@register("exclude_owned", O.with_ctes("cand") + "SELECT request_id, package_a, package_b FROM cand")
def q_exclude_owned(spark, base):
    """Candidate pairs without packages the request already uses (anti join per request)."""
    return _batch_candidates(spark, base).select("request_id", "package_a", "package_b")


_META = ("a.short_name AS for_package, b.short_name AS recommended_package, b.url, b.bounded_popularity, "
         "b.absolute_trend, b.relative_trend, b.categories, b.display_date, b.monthly_downloads_last_month")


@register("pair_metadata", O.with_ctes("cand", "scored") +
          f"SELECT c.request_id, c.package_a, c.package_b, {_META} FROM cand c "
          "JOIN scored a ON a.id = c.package_a JOIN scored b ON b.id = c.package_b")
def q_pair_metadata(spark, base):
    """Seed and recommendation metadata via two equi-joins."""
    sim, packages = trained(spark, base)
    # attached to the similarity rows: a row of them is a candidate of many requests
    m = _batch_candidates(spark, base, recommend.pair_metadata(sim, packages, "package_a"))
    return m.select("request_id", "package_a", "package_b", "for_package", "recommended_package", "url",
                    "bounded_popularity", "absolute_trend", "relative_trend", _categories_text().alias("categories"),
                    "display_date", "monthly_downloads_last_month")


@register("composite_score", O.with_ctes("cand", "scored") +
          "SELECT c.request_id, c.package_a, c.package_b, " +
          O.composite_sql("c.similarity", "b.bounded_popularity", "b.absolute_trend", "b.relative_trend") +
          " AS score FROM cand c JOIN scored b ON b.id = c.package_b")
def q_composite_score(spark, base):
    """ceil(ceil(10·s)·0.5 + bp·0.3 + at·0.1 + rt·0.1) in double arithmetic."""
    sim, packages = trained(spark, base)
    m = _batch_candidates(spark, base, recommend.with_score(recommend.pair_metadata(sim, packages, "package_a")))
    return m.select("request_id", "package_a", "package_b", "score")


@register("top_n", O.with_ctes("sim") +
          "SELECT package_a, package_b, similarity FROM sim ORDER BY similarity DESC, package_a, package_b LIMIT 1000")
def q_top_n(spark, base):
    """The most similar pairs overall (ORDER BY similarity DESC LIMIT n)."""
    return recommend.top_n(stored_similarity(spark, base).select("package_a", "package_b", "similarity"), 1000)


_BATCH_SELECT = (
    "SELECT c.request_id, CAST(row_number() OVER (PARTITION BY c.request_id ORDER BY c.similarity DESC, "
    "c.package_a, c.package_b) AS INTEGER) AS rank, a.short_name AS for_package, "
    "b.short_name AS recommended_package, b.url, "
    + O.composite_sql("c.similarity", "b.bounded_popularity", "b.absolute_trend", "b.relative_trend") +
    " AS score, b.absolute_trend, b.relative_trend, b.bounded_popularity, c.bounded_similarity, b.categories, "
    "b.display_date, b.monthly_downloads_last_month, c.similarity, c.package_a, c.package_b, v.max_recommendations "
    "FROM cand c JOIN scored a ON a.id = c.package_a JOIN scored b ON b.id = c.package_b "
    "JOIN vreq v ON v.request_id = c.request_id")
O.CTE["batch"] = f"batch AS (SELECT * FROM ({_BATCH_SELECT}) WHERE rank <= max_recommendations)"
O.NEEDS["batch"] = ["cand", "scored", "vreq"]
_BATCH_COLS = ["request_id", "rank", *recommend.RESULT_COLUMNS, "similarity", "package_a", "package_b"]


def batch_recommendations(spark, base, valid=None):
    v = valid if valid is not None else _written_requests(spark, base)
    rp = api.request_purls(v)
    limits = v.where(F.col("status") == "ok").select("request_id", "max_recommendations")
    r = recommend.recommend_batch(*trained(spark, base), rp, limits)
    return r.withColumn("rank", F.col("rank").cast("int")).withColumn("categories", _categories_text())


@register("recommend_batch", O.with_ctes("batch") + "SELECT " + ", ".join(_BATCH_COLS) + " FROM batch")
def q_recommend_batch(spark, base):
    """Every valid API request answered in one job, own exclusions and limits."""
    return batch_recommendations(spark, base)


@register("recommendation_records", O.with_ctes("batch") + "SELECT request_id, rank, " + ", ".join(
    f"{c} AS {recommend.RECORD_NAMES[c]}" for c in recommend.RESULT_COLUMNS) + " FROM batch")
def q_recommendation_records(spark, base):
    """The API's field names for the 11 result columns."""
    r = recommend.recommendation_records(batch_recommendations(spark, base))
    return r.select("request_id", "rank", *recommend.RECORD_NAMES.values())


def _json_fields() -> str:
    """A record as JSON text, fields in API order; null fields are left out."""
    def value(column: str) -> str:
        if column == "categories":
            return "'[\"' || replace(categories, ',', '\",\"') || '\"]'"
        quoted = column in ("for_package", "recommended_package", "url", "display_date")
        return f"'\"' || {column} || '\"'" if quoted else f"CAST({column} AS VARCHAR)"
    parts = [f"""'"{name}":' || {value(c)}""" for c, name in recommend.RECORD_NAMES.items()]
    return "'{' || concat_ws(',', " + ", ".join(parts) + ") || '}'"


@register("response_documents", O.with_ctes("batch", "vreq") + f"""
, docs AS (SELECT request_id, string_agg({_json_fields()}, ',' ORDER BY rank) AS recs FROM batch GROUP BY request_id)
SELECT v.request_id, '{{"language":"' || CASE WHEN v.request_id % 2 = 0 THEN 'javascript' ELSE 'python' END
  || '","recommended_dependencies":[' || coalesce(recs, '') || ']}}' AS response
FROM vreq v LEFT JOIN docs ON docs.request_id = v.request_id WHERE v.error IS NULL""")
def q_response_documents(spark, base):
    """One JSON response per valid request."""
    v = _written_requests(spark, base)
    recs = recommend.recommendation_records(batch_recommendations(spark, base, v).withColumn(
        "categories", F.split("categories", ",")))
    return recommend.response_documents(recs, v.where(F.col("status") == "ok"))


# ------------------------------------------------------ C: merge / upsert

O.CTE["apps"] = (
    "apps AS (SELECT o_orderkey AS id, 'https://example.org/app/' || CAST(o_orderkey AS VARCHAR) AS url, "
    "'c' || CAST(o_custkey AS VARCHAR) || '/o' || CAST(o_orderkey AS VARCHAR) AS name, "
    "CAST(floor(o_totalprice / 1000) AS INTEGER) AS followers, "
    "sha256('c' || CAST(o_custkey AS VARCHAR) || '/o' || CAST(o_orderkey AS VARCHAR) || ':' || o_orderstatus) AS hash, "
    "o_orderdate AS retrieved, o_orderstatus FROM orders)")
SPLIT_OLD, SPLIT_NEW, REFRESH = "1997-01-01", "1996-01-01", "2001-11-30"


@register("upsert_applications", O.with_ctes("apps") + f"""
, ex AS (SELECT * FROM apps WHERE retrieved < TIMESTAMP '{SPLIT_OLD}'),
inc AS (SELECT url, name, followers + 1 AS followers, sha256(name) AS hash, TIMESTAMP '{O.AS_OF}' AS retrieved
        FROM apps WHERE retrieved >= TIMESTAMP '{SPLIT_NEW}')
SELECT ex.id, ex.url, CASE WHEN inc.url IS NULL THEN ex.name ELSE inc.name END AS name,
  CASE WHEN inc.url IS NULL THEN ex.followers ELSE inc.followers END AS followers,
  CASE WHEN inc.url IS NULL THEN ex.hash ELSE inc.hash END AS hash,
  strftime(CASE WHEN inc.url IS NULL THEN ex.retrieved ELSE inc.retrieved END, '%Y-%m-%d') AS retrieved
FROM ex LEFT JOIN inc ON ex.url = inc.url
UNION ALL
SELECT (SELECT max(id) FROM ex) + row_number() OVER (ORDER BY url), url, name, followers, hash,
  strftime(retrieved, '%Y-%m-%d') FROM inc WHERE url NOT IN (SELECT url FROM ex)""")
def q_upsert_applications(spark, base):
    """Insert new repositories, overwrite known ones (id kept); C5 ids for the new."""
    apps = corpus.applications(spark, base)
    ex = apps.where(F.col("retrieved") < F.lit(SPLIT_OLD).cast("timestamp"))
    inc = apps.where(F.col("retrieved") >= F.lit(SPLIT_NEW).cast("timestamp")).select(
        "url", "name", (F.col("followers") + 1).alias("followers"), F.sha2("name", 256).alias("hash"),
        F.to_timestamp(F.lit(corpus.AS_OF)).alias("retrieved"))
    out = merge.upsert_applications(ex, inc)
    return out.select("id", "url", "name", "followers", "hash",
                      F.date_format("retrieved", "yyyy-MM-dd").alias("retrieved"))


@register("assign_ids", O.with_ctes("apps") + "SELECT url, row_number() OVER (ORDER BY url) AS id FROM apps")
def q_assign_ids(spark, base):
    """Dense ids in key order without a single-partition window."""
    apps = corpus.applications(spark, base).select("url")
    return merge.assign_ids(apps, [F.col("url")])


O.CTE["train_names"] = (
    "train_names AS (SELECT DISTINCT purl AS name FROM ("
    f"SELECT 'pkg:npm/' || slug || '@' || CAST(p_size AS VARCHAR) AS purl FROM mp WHERE {_NPM_OK} "
    f"UNION ALL SELECT 'pkg:pypi/' || slug || '@' || {_PY_MAJOR} FROM mp WHERE id % 2 = 1))")
O.NEEDS["train_names"] = ["mp"]


@register("upsert_packages", O.with_ctes("packages", "train_names") + f"""
, ex AS (SELECT id, name, monthly_downloads_last_month FROM packages WHERE coalesce(monthly_downloads_last_month, 0) > 0)
SELECT id, name, CASE WHEN name IN (SELECT name FROM train_names) THEN '{REFRESH}' ELSE '{O.AS_OF}' END AS retrieved,
  monthly_downloads_last_month FROM ex
UNION ALL
SELECT (SELECT max(id) FROM ex) + row_number() OVER (ORDER BY name), name, '{REFRESH}', NULL
FROM train_names WHERE name NOT IN (SELECT name FROM ex)""")
def q_upsert_packages(spark, base):
    """New purls get ids; known ones only a new `retrieved`, metadata kept."""
    ex = corpus.packages(spark, base).where(F.coalesce("monthly_downloads_last_month", F.lit(0)) > 0)
    m = _written_manifests(spark, base)
    names = (manifests.npm_train_edges(m.where(F.col("language") == "javascript")).select(F.col("purl").alias("name"))
             .unionByName(manifests.pypi_train_edges(m.where(F.col("language") == "python"))
                          .select(F.col("purl").alias("name"))))
    out = merge.upsert_packages(ex, names, F.to_timestamp(F.lit(REFRESH)))
    return out.select("id", "name", F.date_format("retrieved", "yyyy-MM-dd").alias("retrieved"),
                      "monthly_downloads_last_month")


@register("insert_dependencies", O.with_ctes("e") + "SELECT app AS application_id, pkg AS package_id FROM e")
def q_insert_dependencies(spark, base):
    """Insert-ignore of incoming edges into the existing ones."""
    li = corpus.read_table(spark, base, "lineitem", "l_orderkey", "l_partkey", "l_shipdate").select(
        F.col("l_orderkey").alias("application_id"), F.col("l_partkey").alias("package_id"), "l_shipdate")
    ex = li.where(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    inc = li.where(F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    return merge.insert_dependencies(ex, inc)


OLD_AS_OF = "2000-10-31"


def _ship_sql(name: str, as_of: str) -> str:
    back = lambda m: f"CAST(DATE '{as_of}' - INTERVAL {m} MONTH AS DATE)"
    return (f"{name} AS (SELECT l_partkey, "
            f"CAST(sum(CASE WHEN CAST(l_shipdate AS DATE) BETWEEN {back(1)} AND DATE '{as_of}' THEN l_quantity ELSE 0.0 END) AS BIGINT) AS last_month, "
            f"CAST(sum(CASE WHEN CAST(l_shipdate AS DATE) BETWEEN {back(13)} AND {back(12)} THEN l_quantity ELSE 0.0 END) AS BIGINT) AS year_ago, "
            f"max(l_shipdate) AS modified FROM lineitem GROUP BY l_partkey)")


@register("update_package_metadata", O.with_ctes("pk") + ", " + _ship_sql("old", OLD_AS_OF) + ", "
          + _ship_sql("new", O.AS_OF) + """
SELECT pk.id,
  CASE WHEN pk.id % 2 = 0 THEN new.last_month ELSE old.last_month END AS monthly_downloads_last_month,
  CASE WHEN pk.id % 2 = 0 THEN new.year_ago ELSE old.year_ago END AS monthly_downloads_a_year_ago,
  pk.p_type || ',' || pk.p_brand AS categories,
  strftime(CASE WHEN pk.id % 2 = 0 THEN new.modified ELSE old.modified END, '%Y-%m-%d') AS display_date
FROM pk LEFT JOIN old ON old.l_partkey = pk.id LEFT JOIN new ON new.l_partkey = pk.id""")
def q_update_package_metadata(spark, base):
    """C4: registry refresh by name overwrites downloads, categories, modified (NULLs too)."""
    target = corpus.packages(spark, base, OLD_AS_OF)
    source = corpus.packages(spark, base, corpus.AS_OF).where(F.col("name").startswith("pkg:npm/"))
    out = merge.update_package_metadata(target, source)
    return out.select("id", "monthly_downloads_last_month", "monthly_downloads_a_year_ago",
                      _categories_text().alias("categories"), dates.display_date("modified").alias("display_date"))


@register("clean_categories",
          "SELECT p_partkey AS id, CASE WHEN p_size > 3 THEN p_type || ',' || p_brand || ',' || p_name END "
          "AS categories FROM part")
def q_clean_categories(spark, base):
    """Drop , { } ' \" [ ] in each category, drop empty ones; empty list → NULL."""
    from affinity.functions.categories import clean_categories
    p = corpus.read_table(spark, base, "part", "p_partkey", "p_type", "p_brand", "p_name", "p_size")
    raw = F.when(F.col("p_size") > 3, F.array(
        "p_type", F.concat(F.lit("'"), F.col("p_brand"), F.lit("'")),
        F.concat(F.lit("{"), F.col("p_name"), F.lit("}")), F.lit(","))).otherwise(F.array().cast("array<string>"))
    return p.select(F.col("p_partkey").alias("id"), F.array_join(clean_categories(raw), ",").alias("categories"))


@register("pypi_topics",
          "SELECT p_partkey AS id, CASE WHEN p_size >= 5 THEN p_brand || ',' || p_name || ',' || p_type "
          "ELSE p_type END AS topics FROM part WHERE p_partkey % 2 = 1")
def q_pypi_topics(spark, base):
    """`Topic :: ` classifiers, prefix removed, entries 2..n then 1."""
    from affinity.functions.categories import topics_from_classifiers
    p = corpus.read_table(spark, base, "part", "p_partkey", "p_type", "p_brand", "p_name", "p_size")
    p = p.where(F.col("p_partkey") % 2 == 1)
    t = lambda c: F.concat(F.lit("Topic :: "), F.col(c))
    cls = F.when(F.col("p_size") >= 5, F.array(t("p_type"), F.lit("License :: OSI Approved"), t("p_brand"),
                                                t("p_name"))).otherwise(
        F.array(F.lit("License :: OSI Approved"), t("p_type")))
    return p.select(F.col("p_partkey").alias("id"), F.array_join(topics_from_classifiers(cls), ",").alias("topics"))


# --------------------------------------------------- D4, H: browsing

@register("repo_date", "SELECT o_orderkey AS application_id, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders")
def q_repo_date(spark, base):
    """Date part of an ISO-8601 update time."""
    o = corpus.read_table(spark, base, "orders", "o_orderkey", "o_orderdate")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return o.select(F.col("o_orderkey").alias("application_id"), dates.repo_date(iso).alias("date"))


def _batch_with_arrays(spark, base):
    return batch_recommendations(spark, base).withColumn("categories", F.split("categories", ","))


@register("sort_by_score", O.with_ctes("batch") +
          "SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY score DESC, similarity DESC, "
          "package_a, package_b) AS INTEGER) AS position, package_a, package_b, score FROM batch")
def q_sort_by_score(spark, base):
    """H1: listing order by score."""
    r = browse.sort_by_score(batch_recommendations(spark, base))
    return r.select("request_id", "position", "package_a", "package_b", "score")


@register("filter_category", O.with_ctes("batch") +
          "SELECT request_id, rank, recommended_package, categories FROM batch WHERE lower(categories) LIKE '%small%'")
def q_filter_category(spark, base):
    """H2: recommendations with a category matching the query text."""
    r = browse.filter_category(_batch_with_arrays(spark, base), "Small")
    return r.select("request_id", "rank", "recommended_package", _categories_text().alias("categories"))


_SEARCH_COLS = ["for_package", "recommended_package", "url", "categories", "display_date"]


@register("search_text", O.with_ctes("batch") +
          "SELECT request_id, rank, recommended_package FROM batch WHERE lower(concat_ws(' ', "
          + ", ".join(_SEARCH_COLS) + ")) LIKE '%ring%'")
def q_search_text(spark, base):
    """H3: free-text search over the displayed row."""
    r = browse.search_text(batch_recommendations(spark, base), "RING", _SEARCH_COLS)
    return r.select("request_id", "rank", "recommended_package")


@register("search_text_indexed", O.with_ctes("batch") + "SELECT request_id, rank FROM batch WHERE lower(concat_ws(' ', "
          + ", ".join(_SEARCH_COLS) + ")) LIKE '%red-widget%'")
def q_search_text_indexed(spark, base):
    """H3: the same search through trigram postings of the displayed rows."""
    shown = batch_recommendations(spark, base)
    index = text_search.build(shown, ["request_id", "rank"], text_search.display_text(_SEARCH_COLS),
                              scratch_path(spark, "search-index"))
    return text_search.search(spark, index, "RED-Widget")


def _human_sql(x: str) -> str:
    parts = []
    for unit, suf in browse.MAGNITUDES:
        t = f"(({x}) * 10 + {unit // 2}) // {unit}"
        parts.append(f"WHEN {x} >= {unit} THEN CAST({t} // 10 AS VARCHAR) || '.' || CAST({t} % 10 AS VARCHAR) || '{suf}'")
    return ("CASE " + " ".join(parts) + f" ELSE CAST({x} AS VARCHAR) || '.0' END")


@register("downloads_human", O.with_ctes("scored") +
          "SELECT id, monthly_downloads_last_month, " + _human_sql("monthly_downloads_last_month") +
          " AS downloads_text FROM scored")
def q_downloads_human(spark, base):
    """H4: `0.0a` display of last month's downloads."""
    p = stored_packages(spark, base)
    return p.select("id", "monthly_downloads_last_month",
                    browse.downloads_human("monthly_downloads_last_month").alias("downloads_text"))


@register("score_components", O.with_ctes("batch") +
          "SELECT request_id, rank, score, CAST(CEIL(10 * similarity) AS DOUBLE) * CAST(0.5 AS DOUBLE) AS similarity_part, "
          "CAST(bounded_popularity * 0.3 AS DOUBLE) AS popularity_part, CAST(absolute_trend * 0.1 AS DOUBLE) AS absolute_part, "
          "CAST(relative_trend * 0.1 AS DOUBLE) AS relative_part FROM batch")
def q_score_components(spark, base):
    """H5: the composite score and its four weighted parts."""
    r = browse.score_components(batch_recommendations(spark, base))
    return r.select("request_id", "rank", "score", "similarity_part", "popularity_part", "absolute_part",
                    "relative_part")


@register("repositories_listing", O.with_ctes("mp", "apps") + f"""
, flags AS (SELECT application_id, bool_or({_NPM_OK}) AS has_js, bool_or(id % 2 = 1) AS has_py FROM mp GROUP BY application_id)
SELECT apps.name, CASE WHEN has_py THEN 'python' ELSE 'javascript' END AS language,
  strftime(apps.retrieved, '%Y-%m-%d') AS date, replace(apps.name, '/', '%2F') AS name_escaped
FROM flags JOIN apps ON apps.id = flags.application_id WHERE has_js OR has_py""")
def q_repositories_listing(spark, base):
    """H6: repositories with at least one dependency, later language wins, newest first."""
    m = _manifests(spark, base)
    apps = corpus.applications(spark, base).select(F.col("id").alias("application_id"), "retrieved")
    repos = m.join(apps, "application_id").select(
        "name", F.date_format("retrieved", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at"), "language", "text")
    return browse.repositories_listing(repos)


# ------------------------------------------- E2/E4: one-hot export

O.CTE["vocab"] = "vocab AS (SELECT pkg AS package_id, row_number() OVER (ORDER BY n DESC, pkg) - 1 AS index FROM deg)"
O.NEEDS["vocab"] = ["deg"]


def _vocabulary(spark, base):
    e = similarity.dedupe_edges(corpus.raw_edges(spark, base))
    deg = e.groupBy("package_id").agg(F.count(F.lit(1)).alias("n"))
    v = merge.assign_ids(deg, [F.desc("n"), F.col("package_id")], -1, "index")
    return e, v


@register("vocabulary_map", O.with_ctes("vocab") + "SELECT index, package_id FROM vocab")
def q_vocabulary_map(spark, base):
    """Vector column index → package id (most used first), as a joinable table."""
    return _vocabulary(spark, base)[1].select("index", "package_id")


@register("one_hot", O.with_ctes("vocab", "e") +
          "SELECT e.app AS application_id, vocab.index, CAST(1.0 AS DOUBLE) AS value FROM e JOIN vocab ON vocab.package_id = e.pkg")
def q_one_hot(spark, base):
    """Binary application × package matrix in coordinate form (never densified)."""
    e, v = _vocabulary(spark, base)
    return similarity.one_hot_coordinates(e, v)


# ---------------------------------------------- A: sources and sinks

@register("ingest_search_pages", O.with_ctes("mp", "apps") + """
, langs AS (SELECT application_id, bool_or(id % 2 = 1) AS has_py FROM mp GROUP BY application_id)
SELECT 'javascript' AS language, apps.url, apps.name AS name_with_owner, apps.followers FROM langs JOIN apps ON apps.id = langs.application_id
UNION ALL
SELECT 'python', apps.url, apps.name, apps.followers FROM langs JOIN apps ON apps.id = langs.application_id WHERE has_py""")
def q_ingest_search_pages(spark, base):
    """A3: landed search pages → one row per repository with a manifest."""
    folder = scratch_path(spark, "pages")
    apps = corpus.applications(spark, base)
    m = _manifests(spark, base)
    pages = []
    for lang in ("javascript", "python"):
        t = m.where(F.col("language") == lang).select("application_id", "text")
        repos = apps.join(t, apps["id"] == t["application_id"], "left").select(
            F.col("id").alias("page_key"), "url", "name", "followers", "text")
        pages.append(landed.build_search_pages(repos).withColumn("language", F.lit(lang)))
    # one job: what is moved to make the manifests is moved once for both languages
    reduce(DataFrame.unionByName, pages).write.mode("errorifexists").partitionBy("language").text(folder, compression="gzip")
    out = []
    for lang in ("javascript", "python"):
        found = landed.read_search_pages(spark, folder, by="language").where(F.col("language") == lang)
        out.append(landed.search_page_repositories(found).select(
            F.lit(lang).alias("language"), "url", "name_with_owner", "followers"))
    return reduce(DataFrame.unionByName, out)


@register("ingest_slices", O.with_ctes("apps") + """
, lim AS (SELECT CAST(max(o_orderdate) AS DATE) AS as_of FROM orders),
days AS (SELECT CAST(lim.as_of - CAST(i AS INTEGER) AS DATE) AS day FROM lim, range(0, 30) t(i)),
langs AS (SELECT * FROM (VALUES ('javascript'), ('python')) l(language))
SELECT language, days.day, 'created:' || strftime(days.day - 1, '%Y-%m-%d') || '..' || strftime(days.day, '%Y-%m-%d') AS search,
  apps.url FROM days LEFT JOIN apps ON CAST(apps.retrieved AS DATE) IN (days.day, days.day - 1) CROSS JOIN langs""")
def q_ingest_slices(spark, base):
    """A4: daily crawl slices `created:D-1..D` over the last 30·months days, per language."""
    from affinity.plans import ingest
    apps = corpus.applications(spark, base).select("url", F.to_date("retrieved").alias("created"))
    as_of = corpus.read_table(spark, base, "orders", "o_orderdate").agg(
        F.to_date(F.max("o_orderdate"))).scalar()
    return ingest.crawl_slices(apps, as_of, months=1)


O.CTE["landed"] = ("landed AS (SELECT pk.id, pk.name, pk.p_size, pk.p_type, pk.p_brand, ship.last_month, ship.year_ago, "
                   "ship.modified FROM pk LEFT JOIN ship ON ship.l_partkey = pk.id)")
O.NEEDS["landed"] = ["pk", "ship"]


@register("ingest_npm_metadata", O.with_ctes("landed") + f"""
SELECT name AS package, coalesce(last_month, 0) AS monthly_downloads_last_month,
  coalesce(year_ago, 0) AS monthly_downloads_a_year_ago,
  CASE WHEN p_size % {corpus.KEYWORDS_ABSENT_EVERY} = 0 THEN NULL WHEN p_size % {corpus.KEYWORD_STRING_EVERY} = 0 THEN p_type
       ELSE p_type || ',' || p_brand END AS categories,
  strftime(modified, '%Y-%m-%dT%H:%M:%SZ') AS modified
FROM landed WHERE id % 2 = 0""")
def q_ingest_npm_metadata(spark, base):
    """A5: landed npm packuments and download bodies → metadata rows."""
    paths = corpus.land_registry_bodies(spark, base, scratch_path(spark, "registry"))
    r = spark.read
    md = landed.npm_metadata(r.schema(landed.NPM_BODY).json(paths["npm_packuments"]),
                             r.schema(landed.DOWNLOADS_BODY).json(paths["npm_last_month"]),
                             r.schema(landed.DOWNLOADS_BODY).json(paths["npm_year_ago"]))
    return md.withColumn("categories", _categories_text())


@register("ingest_pypi_metadata", O.with_ctes("landed") + f"""
SELECT name AS package, last_month AS monthly_downloads_last_month,
  CASE WHEN modified IS NOT NULL THEN CAST(0 AS BIGINT) END AS monthly_downloads_a_year_ago,
  CASE WHEN modified IS NOT NULL AND p_size % {corpus.PYPI_NO_CLASSIFIERS_EVERY} <> 0 THEN p_brand || ',' || p_type END AS categories,
  CASE WHEN modified IS NOT NULL AND p_size % {corpus.PYPI_NO_URLS_EVERY} <> 0 THEN strftime(modified, '%Y-%m-%dT%H:%M:%SZ') END AS modified
FROM landed WHERE id % 2 = 1""")
def q_ingest_pypi_metadata(spark, base):
    """Landed PyPI stats and project bodies → metadata rows (failures stay NULL)."""
    paths = corpus.land_registry_bodies(spark, base, scratch_path(spark, "registry"))
    r = spark.read
    names = corpus.package_names(spark, base).where(F.col("name").startswith("pkg:pypi/")).select(
        F.col("name").alias("package"))
    md = landed.pypi_metadata(r.schema(landed.PYPI_STATS_BODY).json(paths["pypi_stats"]),
                              r.schema(landed.PYPI_JSON_BODY).json(paths["pypi_projects"]), names)
    return md.withColumn("categories", _categories_text())


@register("write_similarity", O.with_ctes("sim") + "SELECT * FROM sim")
def q_write_similarity(spark, base):
    """The similarity table written in folders by bucket of package_a, read back."""
    return stored_similarity(spark, base).select("package_a", "package_b", "similarity", "bounded_similarity")


def _constraints_sql(apps: str, pk: str, deps: str, sim: str) -> str:
    """The report over tables of the given names (deps: app, pkg)."""
    return f"""
SELECT 'applications.url unique' AS rule, CAST(count(*) AS BIGINT) AS violations FROM (SELECT url FROM {apps} GROUP BY url HAVING count(*) > 1)
UNION ALL SELECT 'applications not null', count(*) FROM {apps} WHERE url IS NULL OR name IS NULL OR hash IS NULL OR retrieved IS NULL
UNION ALL SELECT 'packages.name unique', count(*) FROM (SELECT name FROM {pk} GROUP BY name HAVING count(*) > 1)
UNION ALL SELECT 'packages not null', count(*) FROM {pk} WHERE name IS NULL OR retrieved IS NULL
UNION ALL SELECT 'dependencies pair unique', count(*) FROM (SELECT app, pkg FROM {deps} GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'dependencies.application_id references applications', count(*) FROM {deps} WHERE app NOT IN (SELECT id FROM {apps})
UNION ALL SELECT 'dependencies.package_id references packages', count(*) FROM {deps} WHERE pkg NOT IN (SELECT id FROM {pk})
UNION ALL SELECT 'similarity pair unique', count(*) FROM (SELECT package_a, package_b FROM {sim} GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'similarity not null', count(*) FROM {sim} WHERE similarity IS NULL
UNION ALL SELECT 'similarity.package_a references packages', count(*) FROM {sim} WHERE package_a NOT IN (SELECT id FROM {pk})
UNION ALL SELECT 'similarity.package_b references packages', count(*) FROM {sim} WHERE package_b NOT IN (SELECT id FROM {pk})"""


_RETRIEVED = f"TIMESTAMP '{corpus.AS_OF}'"


@register("check_constraints", O.with_ctes("apps", "pk", "sim") + f"""
, pkr AS (SELECT id, name, {_RETRIEVED} AS retrieved FROM pk),
deps AS (SELECT l_orderkey AS app, l_partkey AS pkg FROM lineitem)""" + _constraints_sql("apps", "pkr", "deps", "sim"))
def q_check_constraints(spark, base):
    """The table rules as one violations report (0 = rule holds)."""
    return constraints.check_constraints(corpus.applications(spark, base), corpus.packages(spark, base),
                                         corpus.raw_edges(spark, base), stored(lambda: sim_table(spark, base)))


@register("check_constraints_faults", O.with_ctes("apps", "pk", "sim") + f"""
, fapps AS (SELECT id, url, CASE WHEN id % 10 <> 2 THEN name END AS name, hash, retrieved FROM apps WHERE id % 10 <> 6
  UNION ALL SELECT id, url, name, hash, retrieved FROM apps WHERE id % 10 = 1),
fpk AS (SELECT id, name, CASE WHEN id % 10 <> 4 THEN {_RETRIEVED} END AS retrieved FROM pk WHERE id % 10 <> 5
  UNION ALL SELECT id, name, {_RETRIEVED} FROM pk WHERE id % 10 = 3),
deps AS (SELECT l_orderkey AS app, l_partkey AS pkg FROM lineitem UNION ALL SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
fsim AS (SELECT package_a, package_b, CASE WHEN package_a % 10 <> 8 THEN similarity END AS similarity FROM sim
  UNION ALL SELECT package_a, package_b, similarity FROM sim WHERE package_a % 10 = 7)"""
          + _constraints_sql("fapps", "fpk", "deps", "fsim"))
def q_check_constraints_faults(spark, base):
    """A8 on whole tables with planted faults: repeated rows, NULLs and missing parents, so that every rule counts."""
    return constraints.check_constraints(*_faulty_tables(spark, base))


def _faulty_tables(spark, base):
    digit = F.col("id") % 10
    apps = corpus.applications(spark, base).select("id", "url", "name", "hash", "retrieved")
    pkgs = corpus.packages(spark, base).select("id", "name", "retrieved")
    sim = stored(lambda: sim_table(spark, base)).select("package_a", "package_b", "similarity")
    edges = corpus.raw_edges(spark, base)
    return (
        apps.where(digit != 6).withColumn("name", F.when(digit != 2, F.col("name"))).unionByName(apps.where(digit == 1)),
        pkgs.where(digit != 5).withColumn("retrieved", F.when(digit != 4, F.col("retrieved")))
            .unionByName(pkgs.where(digit == 3)),
        edges.unionByName(corpus.dependencies(spark, base)),
        sim.withColumn("similarity", F.when(F.col("package_a") % 10 != 8, F.col("similarity")))
           .unionByName(sim.where(F.col("package_a") % 10 == 7)))


_FAULTY = ORACLE["check_constraints_faults"].split("SELECT 'applications.url unique'")[0]


@register("check_constraints_keys", _FAULTY + """
SELECT 'applications.url unique' AS rule, url AS key, count(*) AS rows FROM fapps GROUP BY url HAVING count(*) > 1
UNION ALL SELECT 'applications not null', url, count(*) FROM fapps WHERE url IS NULL OR name IS NULL OR hash IS NULL OR retrieved IS NULL GROUP BY url
UNION ALL SELECT 'packages.name unique', name, count(*) FROM fpk GROUP BY name HAVING count(*) > 1
UNION ALL SELECT 'packages not null', name, count(*) FROM fpk WHERE name IS NULL OR retrieved IS NULL GROUP BY name
UNION ALL SELECT 'dependencies pair unique', CAST(app AS VARCHAR) || ',' || CAST(pkg AS VARCHAR), count(*) FROM deps GROUP BY app, pkg HAVING count(*) > 1
UNION ALL SELECT 'dependencies.application_id references applications', CAST(app AS VARCHAR), count(*) FROM deps WHERE app NOT IN (SELECT id FROM fapps) GROUP BY app
UNION ALL SELECT 'dependencies.package_id references packages', CAST(pkg AS VARCHAR), count(*) FROM deps WHERE pkg NOT IN (SELECT id FROM fpk) GROUP BY pkg
UNION ALL SELECT 'similarity pair unique', CAST(package_a AS VARCHAR) || ',' || CAST(package_b AS VARCHAR), count(*) FROM fsim GROUP BY package_a, package_b HAVING count(*) > 1
UNION ALL SELECT 'similarity not null', CAST(package_a AS VARCHAR) || ',' || CAST(package_b AS VARCHAR), count(*) FROM fsim WHERE similarity IS NULL GROUP BY package_a, package_b
UNION ALL SELECT 'similarity.package_a references packages', CAST(package_a AS VARCHAR), count(*) FROM fsim WHERE package_a NOT IN (SELECT id FROM fpk) GROUP BY package_a
UNION ALL SELECT 'similarity.package_b references packages', CAST(package_b AS VARCHAR), count(*) FROM fsim WHERE package_b NOT IN (SELECT id FROM fpk) GROUP BY package_b""")
def q_check_constraints_keys(spark, base):
    """Every key that breaks a rule, on the tables with planted faults."""
    return constraints.violating_keys(*_faulty_tables(spark, base))


@register("refresh_metadata", O.with_ctes("landed") + f"""
SELECT id, name,
  CASE WHEN id % 2 = 0 THEN coalesce(last_month, 0) ELSE last_month END AS monthly_downloads_last_month,
  CASE WHEN id % 2 = 0 THEN coalesce(year_ago, 0) WHEN modified IS NOT NULL THEN CAST(0 AS BIGINT) END AS monthly_downloads_a_year_ago,
  CASE WHEN id % 2 = 0 THEN (CASE WHEN p_size % {corpus.KEYWORDS_ABSENT_EVERY} = 0 THEN NULL
                                  WHEN p_size % {corpus.KEYWORD_STRING_EVERY} = 0 THEN p_type ELSE p_type || ',' || p_brand END)
       WHEN modified IS NOT NULL AND p_size % {corpus.PYPI_NO_CLASSIFIERS_EVERY} <> 0 THEN p_brand || ',' || p_type END AS categories,
  CASE WHEN id % 2 = 0 OR p_size % {corpus.PYPI_NO_URLS_EVERY} <> 0 THEN strftime(modified, '%Y-%m-%d') END AS display_date
FROM landed""")
def q_refresh_metadata(spark, base):
    """A2, A5, A6, C4 as one job: stale packages of both ecosystems updated from the landed registry bodies."""
    from affinity.plans import refresh
    paths = corpus.land_registry_bodies(spark, base, scratch_path(spark, "registry"))
    out = refresh.refresh_metadata(spark, corpus.packages(spark, base, OLD_AS_OF), paths)
    return out.select("id", "name", "monthly_downloads_last_month", "monthly_downloads_a_year_ago",
                      _categories_text().alias("categories"), dates.display_date("modified").alias("display_date"))


# ------------------------------------------ dense corpus (buckets 3..7)

_DENSE = {
    "e": ("e AS (SELECT DISTINCT user_id AS app, CAST(regexp_extract(props, '\"k\":\\s*(\\d+)', 1) AS BIGINT) AS pkg "
          "FROM events WHERE regexp_extract(props, '\"k\":\\s*(\\d+)', 1) <> '')"),
}


@register("similarity_frame_dense", O.with_ctes("sim", extra=None).replace(O.CTE["e"], _DENSE["e"]) + "SELECT * FROM sim")
def q_similarity_frame_dense(spark, base):
    """E6 on the dense corpus (users × event keys): cosine 0.3–0.7, buckets 3–7."""
    return similarity.similarity_frame(corpus.event_edges(spark, base))
