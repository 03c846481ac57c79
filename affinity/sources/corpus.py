"""Adapters from the driver's test tables to the data model.

orders    → applications (one repository per order)
part      → packages (npm for even keys, pypi for odd keys)
lineitem  → dependencies (order uses part), download counts and dates
orders ⋈ lineitem ⋈ part → manifest texts (package.json, requirements.txt)

Every adapter is a lazy DataFrame over the Parquet scans, so filters and
projections of callers reach the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.functions import dates
from affinity.functions.purl import NPM, PYPI
from affinity.sources.tables import read_table

# Fixed corpus parameters (our choice; the oracle SQL uses the same values).
AS_OF = "2001-10-31"            # lineitem ships 1995-01-02 … 2001-11-04
APP_URL_BASE = "https://example.org/app/"
VERSIONLESS_MIN_SIZE = 46       # pypi parts of size ≥ 46 carry no version
NUMERIC_VERSION_EVERY = 10      # npm versions given as bare numbers when size % 10 = 0
EXTRAS_EVERY = 7                # pypi lines with extras and `==` when size % 7 = 0
CORRUPT_STATUS = "P"            # orders in this status and priority have a
CORRUPT_PRIORITY = "1-URGENT"   # truncated, unparsable package.json


# ---------------------------------------------------------------- packages

def part_ecosystem(partkey: Column) -> Column:
    return F.when(partkey % 2 == 0, F.lit(NPM)).otherwise(F.lit(PYPI))


def part_slug(p_name: Column, partkey: Column) -> Column:
    return F.concat(F.regexp_replace(p_name, " ", "-"), F.lit("-"), partkey.cast("string"))


def part_major(partkey: Column, p_size: Column) -> Column:
    versionless = (partkey % 2 == 1) & (p_size >= VERSIONLESS_MIN_SIZE)
    return F.when(versionless, F.lit("")).otherwise(p_size.cast("string"))


def package_names(spark: SparkSession, base: str) -> DataFrame:
    """(id, name, slug, p_size) for every part."""
    p = read_table(spark, base, "part", "p_partkey", "p_name", "p_size")
    key = F.col("p_partkey")
    return p.select(
        key.alias("id"),
        F.concat(F.lit("pkg:"), part_ecosystem(key), F.lit("/"),
                 part_slug(F.col("p_name"), key), F.lit("@"),
                 part_major(key, F.col("p_size"))).alias("name"),
        part_slug(F.col("p_name"), key).alias("slug"),
        F.col("p_size"))


def shipments(spark: SparkSession, base: str) -> DataFrame:
    """Every shipped line: part, quantity and time."""
    return read_table(spark, base, "lineitem", "l_partkey", "l_quantity", "l_shipdate")


def shipping_metadata(spark: SparkSession, base: str, as_of: str = AS_OF) -> DataFrame:
    """Per part: downloads in the two windows (sum of quantity) and last ship time.

    One pass over lineitem with two conditional sums; partial aggregation
    happens before the shuffle on l_partkey.
    """
    li = shipments(spark, base)
    w = dates.download_windows(F.lit(as_of))
    day = F.to_date("l_shipdate")

    def window_sum(name: str) -> Column:
        lo, hi = w[name]
        return F.sum(F.when(day.between(lo, hi), F.col("l_quantity")).otherwise(F.lit(0.0)))

    return (li.groupBy("l_partkey")
              .agg(window_sum("last_month").cast("bigint").alias("monthly_downloads_last_month"),
                   window_sum("year_ago").cast("bigint").alias("monthly_downloads_a_year_ago"),
                   F.max("l_shipdate").alias("modified")))


def packages(spark: SparkSession, base: str, as_of: str = AS_OF) -> DataFrame:
    """Raw packages with metadata, before scoring.

    Parts never shipped keep NULL downloads and NULL modified, as a failed
    registry lookup would.
    """
    part = read_table(spark, base, "part", "p_partkey", "p_name", "p_size", "p_type", "p_brand")
    key = F.col("p_partkey")
    named = part.select(
        key.alias("id"),
        F.concat(F.lit("pkg:"), part_ecosystem(key), F.lit("/"),
                 part_slug(F.col("p_name"), key), F.lit("@"),
                 part_major(key, F.col("p_size"))).alias("name"),
        F.array(F.col("p_type"), F.col("p_brand")).alias("categories"))
    meta = shipping_metadata(spark, base, as_of)
    return (named.join(meta, named["id"] == meta["l_partkey"], "left")
                 .select("id", "name", "monthly_downloads_last_month",
                         "monthly_downloads_a_year_ago", "categories",
                         F.col("modified").cast("timestamp").alias("modified"),
                         F.to_timestamp(F.lit(as_of)).alias("retrieved")))


# ------------------------------------------------------------ applications

def applications(spark: SparkSession, base: str) -> DataFrame:
    """One repository per order."""
    o = read_table(spark, base, "orders", "o_orderkey", "o_custkey", "o_totalprice",
                   "o_orderdate", "o_orderstatus")
    name = F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("/o"),
                    F.col("o_orderkey").cast("string"))
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit(APP_URL_BASE), F.col("o_orderkey").cast("string")).alias("url"),
        name.alias("name"),
        F.floor(F.col("o_totalprice") / 1000).cast("int").alias("followers"),
        F.sha2(F.concat(name, F.lit(":"), F.col("o_orderstatus")), 256).alias("hash"),
        F.col("o_orderdate").cast("timestamp").alias("retrieved"))


# ------------------------------------------------------------ dependencies

def raw_edges(spark: SparkSession, base: str) -> DataFrame:
    """Every (order, part) line: duplicates included, as a crawl would land them."""
    li = read_table(spark, base, "lineitem", "l_orderkey", "l_partkey")
    return li.select(F.col("l_orderkey").alias("application_id"),
                     F.col("l_partkey").alias("package_id"))


def dependencies(spark: SparkSession, base: str) -> DataFrame:
    """The dependencies table: unique (application, package) pairs."""
    return raw_edges(spark, base).dropDuplicates(["application_id", "package_id"])


# --------------------------------------------------------------- manifests

def _sorted_join(entries: Column, sep: str) -> Column:
    """Join struct(key, text) entries by key order; deterministic text."""
    return F.array_join(F.transform(F.array_sort(entries), lambda e: e["text"]), sep)


def manifests(spark: SparkSession, base: str, lines: str = "true", language: str | None = None) -> DataFrame:
    """Per order: package.json text (npm parts) and requirements.txt text (pypi parts).

    - package.json lists npm parts as `"slug": "^size.0.0"`, or as a bare number
      when size % 10 = 0 (a non-string value the parser must skip). Orders in
      status P with priority 1-URGENT get a truncated, unparsable document. Orders without npm parts get
      a document without a `dependencies` key.
    - requirements.txt starts with a comment line and lists pypi parts as
      `slug>=size.0`, `slug[extra]==size.1` (size % 7 = 0) or a bare `slug`
      (size ≥ 46).
    Output: application_id, url, name, followers, language, text; one row per
    (order, language) with a manifest (requirements.txt only when it has parts).
    `lines` is a condition on lineitem: which lines the manifests list. Both
    texts of an order are made from one row; with `language`, only that one is.
    """
    li = (read_table(spark, base, "lineitem", "l_orderkey", "l_partkey", "l_linenumber").where(lines)
          .select("l_orderkey", "l_partkey").dropDuplicates())
    part = read_table(spark, base, "part", "p_partkey", "p_name", "p_size")
    key, size = F.col("p_partkey"), F.col("p_size")
    slug = part_slug(F.col("p_name"), key)
    parts = part.select(key, slug.alias("slug"), size, (key % 2 == 0).alias("is_npm"))

    def npm_entry(slug: Column, size: Column) -> Column:
        value = F.when(size % NUMERIC_VERSION_EVERY == 0, size.cast("string")).otherwise(
            F.concat(F.lit('"^'), size.cast("string"), F.lit('.0.0"')))
        return F.concat(F.lit('"'), slug, F.lit('": '), value)

    def py_line(slug: Column, size: Column) -> Column:
        return (F.when(size >= VERSIONLESS_MIN_SIZE, slug)
                 .when(size % EXTRAS_EVERY == 0, F.concat(slug, F.lit("[extra]=="), size.cast("string"), F.lit(".1")))
                 .otherwise(F.concat(slug, F.lit(">="), size.cast("string"), F.lit(".0"))))

    def joined(listed: str, entry, sep: str) -> Column:
        return _sorted_join(F.transform(listed, lambda p: F.struct(p["slug"].alias("k"), entry(p["slug"], p["p_size"]).alias("text"))), sep)

    # rows of name and size move; entries, which hold the name twice, are made where an order's rows are
    lines = li.join(parts, li["l_partkey"] == parts["p_partkey"]).select("l_orderkey", "slug", "p_size", "is_npm")
    listed = F.struct("slug", "p_size")
    per_order = lines.repartition("l_orderkey").groupBy("l_orderkey").agg(
        F.collect_list(F.when(F.col("is_npm"), listed)).alias("npm"), F.collect_list(F.when(~F.col("is_npm"), listed)).alias("py"))
    apps = applications(spark, base).join(
        read_table(spark, base, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority"),
        F.col("id") == F.col("o_orderkey"))
    j = (apps.join(per_order, apps["id"] == per_order["l_orderkey"])
             .withColumnRenamed("id", "application_id"))
    head = F.concat(F.lit('{"name": "app-'), F.col("application_id").cast("string"), F.lit('"'))
    full = F.concat(head, F.lit(', "dependencies": {'), joined("npm", npm_entry, ", "), F.lit("}}"))
    npm_text = (F.when(F.size("npm") == 0, F.concat(head, F.lit(', "private": true}')))
                 .when((F.col("o_orderstatus") == CORRUPT_STATUS)
                       & (F.col("o_orderpriority") == CORRUPT_PRIORITY),
                       F.expr("substring(full_text, 1, length(full_text) - 1)"))
                 .otherwise(F.col("full_text")))
    py_text = F.concat(F.lit("# requirements for app-"), F.col("application_id").cast("string"), F.lit("\n"),
                       joined("py", py_line, "\n"))
    base_cols = ["application_id", "url", "name", "followers"]
    j = j.withColumn("full_text", full)
    if language == "javascript":
        return j.select(*base_cols, F.lit("javascript").alias("language"), npm_text.alias("text"))
    if language == "python":
        return j.where(F.size("py") > 0).select(*base_cols, F.lit("python").alias("language"), py_text.alias("text"))
    both = F.array(F.struct(F.lit("javascript").alias("language"), npm_text.alias("text")),
                   F.when(F.size("py") > 0, F.struct(F.lit("python").alias("language"), py_text.alias("text"))))
    return j.select(*base_cols, F.explode(F.array_compact(both)).alias("m")).select(*base_cols, "m.language", "m.text")


# ---------------------------------------------------------------- requests

# Fixed corpus parameters for API requests (our choice).
BAD_BODY_EVERY = 50   # c_custkey % 50 picks an invalid body variant (1..6)


def request_bodies(spark: SparkSession, base: str) -> DataFrame:
    """One API request per customer: (request_id, body).

    Even customers ask in Javascript with `slug@size.0.0` entries, odd ones in
    Python with `slug==size.0` (a bare `slug` for version-less parts); the
    dependencies are the parts of the customer's orders in that ecosystem,
    sorted, and max_recommendations = 5 + c_custkey % 46. Some customers send
    invalid bodies, picked by c_custkey % 50: 1 not JSON, 2 `{}`, 3 an
    unsupported language, 4 a null language, 5 an object instead of a list,
    6 an empty list.
    """
    cust = read_table(spark, base, "customer", "c_custkey")
    orders = read_table(spark, base, "orders", "o_orderkey", "o_custkey")
    li = read_table(spark, base, "lineitem", "l_orderkey", "l_partkey")
    part = read_table(spark, base, "part", "p_partkey", "p_name", "p_size")
    key, size = F.col("p_partkey"), F.col("p_size")
    slug = part_slug(F.col("p_name"), key)
    js_dep = F.concat(slug, F.lit("@"), size.cast("string"), F.lit(".0.0"))
    py_dep = F.when(size >= VERSIONLESS_MIN_SIZE, slug).otherwise(
        F.concat(slug, F.lit("=="), size.cast("string"), F.lit(".0")))
    parts = part.select(key, F.when(key % 2 == 0, js_dep).otherwise(py_dep).alias("dep"))
    # a part's ecosystem is in its key: the other half isn't moved to the parts, and texts move once, to their customer
    used = (li.join(orders, li["l_orderkey"] == orders["o_orderkey"])
              .where(F.col("l_partkey") % 2 == F.col("o_custkey") % 2).select("o_custkey", "l_partkey")
              .join(parts, F.col("l_partkey") == F.col("p_partkey"))
              .select(F.col("o_custkey").alias("c_custkey"), "dep").repartition("c_custkey"))
    deps = used.groupBy("c_custkey").agg(F.array_sort(F.collect_set("dep")).alias("deps"))
    c = cust.join(deps, "c_custkey", "left")
    k = F.col("c_custkey")
    lang = F.when(k % 2 == 0, F.lit("Javascript")).otherwise(F.lit("Python"))
    dep_list = F.concat(F.lit("["), F.array_join(
        F.transform(F.coalesce("deps", F.array().cast("array<string>")),
                    lambda d: F.concat(F.lit('"'), d, F.lit('"'))), ", "), F.lit("]"))
    variant = k % BAD_BODY_EVERY

    def body(language, dependencies):
        return F.concat(F.lit('{"language": '), language, F.lit(', "dependencies": '), dependencies,
                        F.lit(', "max_recommendations": '), (F.lit(5) + k % 46).cast("string"),
                        F.lit("}"))

    quoted = F.concat(F.lit('"'), lang, F.lit('"'))
    text = (F.when(variant == 1, F.lit("THIS IS NOT A JSON!"))
             .when(variant == 2, F.lit("{}"))
             .when(variant == 3, body(F.lit('"NOT SUPPORTED VALUE"'), dep_list))
             .when(variant == 4, body(F.lit("null"), dep_list))
             .when(variant == 5, body(quoted, F.lit("{}")))
             .when(variant == 6, body(quoted, F.lit("[]")))
             .otherwise(body(quoted, dep_list)))
    return c.select(k.alias("request_id"), text.alias("body"))


# ------------------------------------------------------- landed bodies

KEYWORDS_ABSENT_EVERY = 5     # npm packuments without keywords when size % 5 = 0
KEYWORD_STRING_EVERY = 9      # ... a bare string keyword when size % 9 = 0
PYPI_NO_URLS_EVERY = 4        # PyPI bodies with an empty `urls` list when size % 4 = 0
PYPI_NO_CLASSIFIERS_EVERY = 6 # ... without `classifiers` when size % 6 = 0


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def land_registry_bodies(spark: SparkSession, base: str, folder: str) -> dict[str, str]:
    """Write the registry responses a crawl would land, derived from part and lineitem.

    npm packuments for every npm part; download bodies only for parts that
    shipped (others answer with an error body); PyPI stats and project bodies
    only for pypi parts that shipped (the lookup of the others fails).
    Returns the folder of each body kind.
    """
    names = package_names(spark, base)
    meta = shipping_metadata(spark, base)
    part = read_table(spark, base, "part", "p_partkey", "p_type", "p_brand")
    p = (names.join(part, names["id"] == part["p_partkey"])
              .join(meta, names["id"] == meta["l_partkey"], "left"))
    size = F.col("p_size")
    shipped = F.col("modified").isNotNull()
    npm = p.where(F.col("id") % 2 == 0)
    py = p.where(F.col("id") % 2 == 1)
    keywords = (F.when(size % KEYWORDS_ABSENT_EVERY == 0, F.lit(None))
                 .when(size % KEYWORD_STRING_EVERY == 0, F.concat(F.lit('"'), F.col("p_type"), F.lit('"')))
                 .otherwise(F.to_json(F.array("p_type", "p_brand"))))
    packument = F.to_json(F.struct(F.col("name"), F.parse_json(keywords).alias("keywords"),
                                   F.when(shipped, F.struct(_iso(F.col("modified")).alias("modified")))
                                   .alias("time")))

    def downloads(col: str) -> Column:
        return F.when(shipped, F.to_json(F.struct(F.col("name").alias("package"),
                                                  F.col(col).alias("downloads")))
                      ).otherwise(F.to_json(F.struct(F.col("name").alias("package"),
                                                     F.lit("package not found").alias("error"))))

    topics = F.array(F.concat(F.lit("Topic :: "), F.col("p_type")), F.lit("License :: OSI Approved"),
                     F.concat(F.lit("Topic :: "), F.col("p_brand")))
    urls = F.when(size % PYPI_NO_URLS_EVERY == 0, F.array().cast("array<struct<upload_time_iso_8601:string>>")
                  ).otherwise(F.array(F.struct(_iso(F.col("modified")).alias("upload_time_iso_8601"))))
    info_json = F.when(size % PYPI_NO_CLASSIFIERS_EVERY == 0,
                       F.to_json(F.struct(F.col("name").alias("name")))).otherwise(
        F.to_json(F.struct(F.col("name").alias("name"), topics.alias("classifiers"))))
    pypi_body = F.to_json(F.struct(F.parse_json(info_json).alias("info"), urls.alias("urls")))
    stats = F.to_json(F.struct(F.col("name").alias("package"),
                               F.struct(F.col("monthly_downloads_last_month").alias("last_month")).alias("data")))
    out = {}
    for kind, df, body in [("npm_packuments", npm, packument),
                           ("npm_last_month", npm, downloads("monthly_downloads_last_month")),
                           ("npm_year_ago", npm, downloads("monthly_downloads_a_year_ago")),
                           ("pypi_stats", py.where(shipped), stats),
                           ("pypi_projects", py.where(shipped), pypi_body)]:
        path = f"{folder}/{kind}"
        df.select(body.alias("value")).write.mode("errorifexists").text(path)
        out[kind] = path
    return out



def event_edges(spark: SparkSession, base: str) -> DataFrame:
    """Dense corpus: users as applications, the `k` of each event's props as packages."""
    ev = read_table(spark, base, "events", "user_id", "props")
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return ev.select(F.col("user_id").alias("application_id"), k.alias("package_id")) \
             .where(F.col("package_id").isNotNull())
