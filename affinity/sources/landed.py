"""Landed JSON sources (search pages, registry bodies) and table sinks.

Network clients are out of scope: their responses are landed as JSON files
(one document per line) and read here with explicit schemas, so nothing is
inferred and every column is typed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, LongType, StringType, StructField,
                               StructType)

from affinity.functions.categories import topics_from_classifiers
from affinity.schemas import SEARCH_PAGE
from affinity.session import PACKED

# ------------------------------------------------------------ search pages


def read_search_pages(spark: SparkSession, path: str, multi_line: bool = False, by: str | None = None) -> DataFrame:
    """The pages below `path`; `by` names the text column whose values name its folders, if it has any."""
    schema = SEARCH_PAGE if by is None else StructType([*SEARCH_PAGE.fields, StructField(by, StringType())])
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def search_page_repositories(pages: DataFrame) -> DataFrame:
    """One row per repository node that carries a manifest (null objects skipped)."""
    nodes = pages.select(F.explode("data.search.edges").alias("e")).select("e.node.*")
    return nodes.where(F.col("object").isNotNull() & F.col("object.text").isNotNull()).select(
        F.col("url"), F.col("nameWithOwner").alias("name_with_owner"),
        F.col("watchers.totalCount").alias("followers"), F.col("object.text").alias("text"))


def build_search_pages(repos: DataFrame, page_size: int = 100) -> DataFrame:
    """Wrap repositories into search-result pages of at most `page_size` nodes.

    repos(page_key long, url, name, followers, text nullable). Output: one JSON
    text per page (column `value`), ready for `write.text`.
    """
    node = F.struct(
        F.struct(F.col("name").alias("nameWithOwner"), F.col("url").alias("url"),
                 F.struct(F.col("followers").alias("totalCount")).alias("watchers"),
                 F.when(F.col("text").isNotNull(), F.struct(F.col("text").alias("text"))).alias("object")
                 ).alias("node"),
        F.col("page_key").cast("string").alias("cursor"))
    pages = (repos.groupBy((F.col("page_key") / page_size).cast("long").alias("page"))
                  .agg(F.collect_list(node).alias("edges")))
    doc = F.struct(F.struct(F.struct(F.col("edges"), F.size("edges").alias("repositoryCount"))
                            .alias("search")).alias("data"))
    return pages.select(F.to_json(doc).alias("value"))


# ------------------------------------------------------- registry bodies

NPM_BODY = StructType([
    StructField("name", StringType()),
    StructField("keywords", StringType()),
    StructField("time", StructType([StructField("modified", StringType())])),
])
DOWNLOADS_BODY = StructType([
    StructField("package", StringType()),
    StructField("downloads", LongType()),
    StructField("error", StringType()),
])
PYPI_STATS_BODY = StructType([
    StructField("package", StringType()),
    StructField("data", StructType([StructField("last_month", LongType())])),
])
PYPI_JSON_BODY = StructType([
    StructField("info", StructType([
        StructField("name", StringType()),
        StructField("classifiers", ArrayType(StringType())),
    ])),
    StructField("urls", ArrayType(StructType([StructField("upload_time_iso_8601", StringType())]))),
])


def keywords_list(raw: Column) -> Column:
    """npm `keywords`: an array as is, a bare string as one entry, else NULL.

    The JSON reader hands a string field the raw text of an array, and the
    unquoted content of a string value.
    """
    v = F.try_parse_json(raw)
    kind = F.schema_of_variant(v)
    arr = F.try_variant_get(v, "$", "array<string>")
    lst = (F.when(kind.startswith("ARRAY"), arr)
            .when(kind == "STRING", F.array(F.try_variant_get(v, "$", "string")))
            .when(v.isNull() & raw.isNotNull(), F.array(raw)))
    return F.when(F.size(lst) > 0, lst)


def npm_metadata(packuments: DataFrame, last_month: DataFrame, year_ago: DataFrame) -> DataFrame:
    """(package name, last_month, year_ago, categories, modified) from landed npm bodies.

    Joined by package name. Missing or falsy download counts → 0; empty or
    missing keywords and modified → NULL.
    """
    def downloads(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("package"), F.coalesce(F.col("downloads"), F.lit(0)).alias(name))

    p = packuments.select(F.col("name").alias("package"), keywords_list(F.col("keywords")).alias("categories"),
                          F.when(F.col("time.modified") != "", F.col("time.modified")).alias("modified"))
    j = (p.join(downloads(last_month, "monthly_downloads_last_month"), "package", "left")
          .join(downloads(year_ago, "monthly_downloads_a_year_ago"), "package", "left"))
    return j.select("package",
                    F.coalesce("monthly_downloads_last_month", F.lit(0)).alias("monthly_downloads_last_month"),
                    F.coalesce("monthly_downloads_a_year_ago", F.lit(0)).alias("monthly_downloads_a_year_ago"),
                    "categories", "modified")


def pypi_metadata(stats: DataFrame, bodies: DataFrame, names: DataFrame) -> DataFrame:
    """(package name, last_month, year_ago, categories, modified) from landed PyPI bodies.

    names(package): every package asked for. Without a stats body the lookup
    failed: everything stays NULL. With stats but without the project body:
    downloads are set (year_ago always 0), categories and modified NULL.
    With both: categories are the `Topic :: ` classifiers (NULL when the key
    is missing or none match) and modified the first file's upload time.
    """
    s = stats.select("package", F.col("data.last_month").alias("last_month"), F.lit(True).alias("_s"))
    b = bodies.select(F.col("info.name").alias("package"), F.col("info.classifiers").alias("classifiers"),
                      F.get(F.col("urls"), 0)["upload_time_iso_8601"].alias("modified"),
                      F.lit(True).alias("_b"))
    j = names.select("package").join(s, "package", "left").join(b, "package", "left")
    has_s = F.col("_s").isNotNull()
    both = has_s & F.col("_b").isNotNull()
    topics = topics_from_classifiers(F.coalesce("classifiers", F.array().cast("array<string>")))
    return j.select(
        "package",
        F.when(has_s, F.col("last_month")).alias("monthly_downloads_last_month"),
        F.when(has_s, F.lit(0).cast("bigint")).alias("monthly_downloads_a_year_ago"),
        F.when(both & (F.size(topics) > 0), topics).alias("categories"),
        F.when(both, F.col("modified")).alias("modified"))


# ------------------------------------------------------------------ sinks

def write_table(df: DataFrame, path: str, partition_cols: list[str] | None = None,
                sort_within: list[str] | None = None) -> str:
    """Write a table to a NEW folder; readers switch to it afterwards."""
    w = df
    if sort_within:
        w = w.sortWithinPartitions(*sort_within)
    writer = w.write.mode("errorifexists")
    if partition_cols:
        writer = writer.partitionBy(*partition_cols)
    writer.parquet(path, compression=PACKED)
    return path


# A bucket of the similarity table holds at least this many rows until there
# are MANY_BUCKETS of them; from there buckets grow to BUCKET_ROWS rows.
LEAST_BUCKET_ROWS, BUCKET_ROWS, MANY_BUCKETS = 100_000, 8_000_000, 4096
BUCKET = "key_bucket"
BUCKETS = "key_buckets"     # metadata of package_a: into how many buckets the table was written
MIRRORED = "mirrored"       # metadata of package_a: the table has every pair in both directions


def bucket_count(rows: int) -> int:
    """Buckets of a similarity table of so many rows."""
    return max(1, -(-rows // BUCKET_ROWS), min(MANY_BUCKETS, -(-rows // LEAST_BUCKET_ROWS)))


def bucket_of(key: Column, buckets: int) -> Column:
    """The bucket of a package id: the partition that `repartition(buckets, package_a)` gives it."""
    return F.pmod(F.hash(key.cast("long")), F.lit(buckets))


def write_similarity(similarity: DataFrame, path: str, buckets: int | None = None,
                     rank: bool = False, max_neighbours: int | None = None, mirrored: bool = False) -> str:
    """Write the scored similarity table in folders by bucket of package_a, so that a lookup reads its seeds' only.

    `buckets` should come from `bucket_count`; without it the session's shuffle
    partitions are used. It is kept as metadata of package_a in the files, for
    readers. Within `WINDOW_GROUP_ROWS` neighbours a package, a bucket is one
    task and one file, since the bucket is Spark's own partition of the key.
    Beyond it the lists are ranked and written by range of (bucket, rank,
    package_a), so that a long list spreads over tasks and files. `mirrored`
    says that every pair is there in both directions, which readers may use;
    without bounded similarities these are added where rows are written; ranking has
    written the table already, so the sampling pass reads a copy. Ranked files
    have all packages' best neighbours first, in pages that a filter on the
    rank selects.
    """
    from affinity.operators.similarity import WINDOW_GROUP_ROWS, rank_neighbours, with_bounded
    n = int(buckets or similarity.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = (similarity.withColumn("package_a", F.col("package_a").cast("long"))
             .withColumn(BUCKET, bucket_of(F.col("package_a"), n)))
    order = [BUCKET, "neighbor_rank", "package_a"]
    if rank and (max_neighbours is None or max_neighbours > WINDOW_GROUP_ROWS):
        placed = rank_neighbours(keyed, max_neighbours).repartitionByRange(n, *order).sortWithinPartitions(*order)
    elif rank:
        # the window reuses this partitioning: no second shuffle; the bucket follows from the key and isn't moved
        moved = keyed.drop(BUCKET).repartition(n, "package_a").withColumn(BUCKET, bucket_of(F.col("package_a"), n))
        placed = rank_neighbours(moved, max_neighbours).sortWithinPartitions(*order)
    else:
        placed = keyed.repartition(n, "package_a").sortWithinPartitions(BUCKET, "package_a", "package_b")
    about = {BUCKETS: n, MIRRORED: True} if mirrored else {BUCKETS: n}
    return write_table(with_bounded(placed).withMetadata("package_a", about), path, partition_cols=[BUCKET])


def similarity_buckets(similarity: DataFrame) -> int | None:
    """Into how many buckets a similarity table was written; None if it has none."""
    if BUCKET not in similarity.columns:
        return None
    return similarity.schema["package_a"].metadata.get(BUCKETS)
