"""Table schemas of the data model."""

from pyspark.sql.types import (ArrayType, DoubleType, IntegerType, LongType,
                               StringType, StructField, StructType,
                               TimestampType)

APPLICATIONS = StructType([
    StructField("id", LongType(), False),
    StructField("url", StringType(), False),
    StructField("name", StringType(), False),
    StructField("followers", IntegerType(), True),
    StructField("hash", StringType(), False),
    StructField("retrieved", TimestampType(), False),
])

PACKAGES = StructType([
    StructField("id", LongType(), False),
    StructField("name", StringType(), False),
    StructField("short_name", StringType(), True),
    StructField("url", StringType(), True),
    StructField("monthly_downloads_last_month", LongType(), True),
    StructField("monthly_downloads_a_year_ago", LongType(), True),
    StructField("absolute_trend", IntegerType(), True),
    StructField("relative_trend", IntegerType(), True),
    StructField("categories", ArrayType(StringType()), True),
    StructField("popularity", LongType(), True),
    StructField("bounded_popularity", IntegerType(), True),
    StructField("modified", TimestampType(), True),
    StructField("display_date", StringType(), True),
    StructField("retrieved", TimestampType(), False),
])

DEPENDENCIES = StructType([
    StructField("application_id", LongType(), False),
    StructField("package_id", LongType(), False),
])

SIMILARITY = StructType([
    StructField("package_a", LongType(), False),
    StructField("package_b", LongType(), False),
    StructField("similarity", DoubleType(), False),
    StructField("bounded_similarity", IntegerType(), True),
])

# One landed page of a repository search: nodes carry the manifest text, or a
# null object when the repository has no manifest of the searched kind.
SEARCH_PAGE = StructType([
    StructField("data", StructType([
        StructField("search", StructType([
            StructField("edges", ArrayType(StructType([
                StructField("node", StructType([
                    StructField("nameWithOwner", StringType()),
                    StructField("url", StringType()),
                    StructField("watchers", StructType([
                        StructField("totalCount", IntegerType()),
                    ])),
                    StructField("object", StructType([
                        StructField("text", StringType()),
                    ])),
                ])),
                StructField("cursor", StringType()),
            ]))),
            StructField("repositoryCount", IntegerType()),
        ])),
    ])),
])

# Landed registry bodies (one JSON document per package and request).
NPM_PACKUMENT = StructType([
    StructField("name", StringType()),
    StructField("keywords", StringType()),  # raw JSON: array, string or absent
    StructField("time", StructType([StructField("modified", StringType())])),
])

NPM_DOWNLOADS = StructType([
    StructField("package", StringType()),
    StructField("start", StringType()),
    StructField("end", StringType()),
    StructField("downloads", LongType()),
])
