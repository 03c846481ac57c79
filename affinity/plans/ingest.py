"""Ingest plan: crawl slices, landed pages → applications, packages, dependencies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.operators import manifests, merge
from affinity.session import materialize
from affinity.sources import landed

LANGUAGES = ["javascript", "python"]
DAYS_PER_MONTH = 30


def crawl_slices(repos: DataFrame, as_of: Column, months: int = 1) -> DataFrame:
    """Which daily search slice finds which repository.

    The crawl asks, per language, for repositories created in `D-1..D` for
    each of the last 30·months days D up to as_of. A repository created on
    day c is therefore found by the slices D = c and D = c + 1 (twice, so
    the upserts must be idempotent). repos(url, created date).
    Output: language, day, search, url (NULL where a slice finds nothing).
    """
    n = DAYS_PER_MONTH * months
    hits = repos.select("url", F.explode(F.array(F.col("created"), F.date_add("created", 1))).alias("day"))
    # every slice is in the plan, whether or not it finds a repository
    one = repos.sparkSession.range(1).select(as_of.alias("as_of"))
    days = one.select(F.explode(F.sequence(F.date_sub("as_of", n - 1), F.col("as_of"))).alias("day"))
    hits = days.join(hits, "day", "left")
    langs = F.explode(F.array(*[F.lit(lang) for lang in LANGUAGES]))
    search = F.concat(F.lit("created:"), F.date_format(F.date_sub("day", 1), "yyyy-MM-dd"), F.lit(".."),
                      F.date_format("day", "yyyy-MM-dd"))
    return hits.select(langs.alias("language"), "day", search.alias("search"), "url")


def ingest_pages(pages: DataFrame, language: str, as_of: Column, existing_apps: DataFrame,
                 existing_packages: DataFrame, existing_deps: DataFrame,
                 settle: Callable[[str, DataFrame], DataFrame] = lambda name, df: df):
    """One language's landed search pages merged into the three tables.

    Returns (applications, packages, dependencies) as new DataFrames.
    `settle(name, df)` may write a table and return the written copy;
    the dependencies are then built from the copies.
    """
    repos = landed.search_page_repositories(pages).withColumn("language", F.lit(language))
    if language == manifests.JAVASCRIPT:
        apps_in = manifests.npm_applications(repos)
        edges = manifests.npm_train_edges(apps_in)
    else:
        apps_in = repos
        edges = manifests.pypi_train_edges(repos)
    incoming_apps = apps_in.select("url", F.col("name_with_owner").alias("name"), "followers",
                                   F.sha2("text", 256).alias("hash"), as_of.alias("retrieved"))
    apps = settle("applications", merge.upsert_applications(existing_apps, incoming_apps))
    pkgs = settle("packages", merge.upsert_packages(existing_packages, edges.select(F.col("purl").alias("name")), as_of))
    deps_in = (edges.join(apps.select(F.col("id").alias("application_id"), "url"), "url")
                    .join(pkgs.select(F.col("id").alias("package_id"), F.col("name").alias("purl")), "purl"))
    deps = settle("dependencies", merge.insert_dependencies(existing_deps, deps_in))
    return apps, pkgs, deps



def changed_edges(repos: DataFrame, stored_hashes: DataFrame, applications: DataFrame, packages: DataFrame,
                  dependencies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signed edges for `train.refresh`, and the fingerprints to store, from newly landed manifests.

    repos(url, language, text); stored_hashes(url, language, hash). Manifests
    whose hash is stored are not parsed. Packages that a change adds must be in
    `packages` already (`merge.upsert_packages`).
    """
    changed = materialize(manifests.changed_manifests(repos.select("url", "language", "text"), stored_hashes, "url"), "changed")
    apps = applications.select(F.col("id").alias("application_id"), "url")
    pkgs = packages.select(F.col("id").alias("package_id"), F.col("name").alias("purl"))
    # the stored edges of repositories with a changed manifest, by their names
    edges = (dependencies.join(apps.join(changed.select("url").distinct(), "url", "left_semi"), "application_id")
             .join(pkgs, "package_id").select("url", "purl"))
    signed = manifests.edge_changes(changed, edges, "url").join(apps, "url").join(pkgs, "purl")
    return signed.select("application_id", "package_id", "sign"), changed.select("url", "language", "hash")
