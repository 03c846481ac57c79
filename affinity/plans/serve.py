"""Serving plans over the written tables: one list, or a batch of API bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.operators import api, recommend
from affinity.session import PACKED, materialize


def tables(spark: SparkSession, similarity_path: str, packages_path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(similarity_path), spark.read.parquet(packages_path)


def recommend_one(spark: SparkSession, similarity_path: str, packages_path: str, purls: DataFrame,
                  max_recommendations: int = recommend.DEFAULT_MAX_RECOMMENDATIONS) -> DataFrame:
    sim, pk = tables(spark, similarity_path, packages_path)
    return recommend.recommend(sim, pk, purls, max_recommendations)


def answer_requests(spark: SparkSession, similarity_path: str, packages_path: str,
                    bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """bodies(request_id, body) → (status rows, recommendation records)."""
    sim, pk = tables(spark, similarity_path, packages_path)
    # one row per request, read by four consumers (status, limits, two parsers)
    valid = materialize(api.validate_requests(bodies).drop("body"), "requests", PACKED)
    limits = valid.where(F.col("status") == "ok").select("request_id", "max_recommendations")
    recs = recommend.recommend_batch(sim, pk, api.request_purls(valid), limits)
    return valid.select("request_id", "status", "error"), recommend.recommendation_records(recs)
