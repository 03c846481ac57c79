"""Recommendation queries over the similarity and scored package tables.

Single list (`recommend`) and many requests at once (`recommend_batch`):
seeds are resolved to ids by a semi join, owned packages are removed by an
anti join, metadata comes from two equi-joins, and a weighted score is added.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from affinity.session import PACKED, materialize

from affinity.functions import purl, scoring
from affinity.operators.joins import MAX_BROADCAST_ROWS, checked_broadcast, checked_broadcast_with_count
from affinity.sources.landed import BUCKET, bucket_of, similarity_buckets

# Fixed value: default result limit of the recommendation service.
DEFAULT_MAX_RECOMMENDATIONS = 10000

RESULT_COLUMNS = ["for_package", "recommended_package", "url", "score", "absolute_trend",
                  "relative_trend", "bounded_popularity", "bounded_similarity",
                  "categories", "display_date", "monthly_downloads_last_month"]

# Output field names of the API records, in tuple order.
RECORD_NAMES = {
    "for_package": "forPackage",
    "recommended_package": "recommendedPackage",
    "url": "url",
    "score": "score",
    "absolute_trend": "absoluteTrendScore",
    "relative_trend": "relativeTrendScore",
    "bounded_popularity": "boundedPopularityScore",
    "bounded_similarity": "boundedSimilarityScore",
    "categories": "categories",
    "display_date": "displayDate",
    "monthly_downloads_last_month": "monthlyDownloadsLastMonth",
}


def seed_names(dependencies: DataFrame, column: str = "purl") -> DataFrame:
    """Dependency purls cut to `pkg:<eco>/<name>@<major>`; non-matching ones dropped."""
    # a filter above the projection would be pushed below it and search every text twice
    found = F.filter(F.array(purl.strip_to_major(column)), lambda name: name != "")
    return dependencies.select(*[c for c in dependencies.columns if c != column], F.explode(found).alias("name"))


def resolve_seeds(packages: DataFrame, names: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Ids of the named packages (`id IN (SELECT id … WHERE name IN …)`), per key group."""
    keys = keys or []
    p = packages.select("id", "name")
    found = names.select(*keys, "name").join(p, "name").select(*keys, "id")
    # moved by the keys alone: what callers join by them then needs no move of its own
    return (found.repartition(*keys) if keys else found).dropDuplicates(keys + ["id"])


def _in_bucket(seeds: DataFrame, buckets: int | None) -> DataFrame:
    """The seeds with the bucket of the similarity table that holds their rows, if it has buckets.

    Joined on, it is the scan's partition column: Spark reads only the folders
    of the seeds' buckets (dynamic partition pruning).
    """
    return seeds if not buckets else seeds.withColumn(BUCKET, bucket_of(F.col("package_a"), buckets))


def _any_id(seeds: DataFrame) -> DataFrame:
    """All seeds, under a filter that keeps every id: Spark prunes by a join's keys only if they come from a filter."""
    return seeds.where(F.col("id") >= F.lit(-(2 ** 63)))


# Requests of at most this many seeds carry them in their rows as a list, to which each neighbour is compared on the spot.
OWNED_IN_ROW = 256


def long_lists(seed_ids: DataFrame, keys: list[str]) -> DataFrame | None:
    """The keys of the requests of more than OWNED_IN_ROW seeds, if there are any. A request without a key owns nothing."""
    seeds = seed_ids.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    long = seeds.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > OWNED_IN_ROW)
    long = materialize(long.select(*keys), "long-lists")
    return None if long.isEmpty() else checked_broadcast(long)


def _is_mine(package: Column) -> Column:
    return F.coalesce(F.array_contains("_mine", package), F.lit(False))


def _kept_pairs(seeds: DataFrame, similarity: DataFrame, seed_ids: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Pairs of many requests without owned packages; seeds (keys, package_a, perhaps `_bound`) and similarity are moved.

    Their pairs aren't, except those of a request of more than OWNED_IN_ROW seeds, which an anti join takes.
    """
    def pairs(seeds: DataFrame) -> DataFrame:
        found = seeds.join(similarity, "package_a")
        return found.where(F.col("neighbor_rank") <= F.col("_bound")) if "_bound" in seeds.columns else found

    long = long_lists(seed_ids, keys)
    listed = seeds if long is None else seeds.join(long, keys, "left_anti")
    # a request's seeds meet in one row, which is what it owns
    keyed = " AND ".join(f"`{k}` IS NOT NULL" for k in keys)
    rest = [c for c in seeds.columns if c not in keys]
    mine = F.transform("_seeds", lambda x: x["package_a"])
    rows = (listed.where(keyed).groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias("_seeds"))
            .select(*keys, mine.alias("_mine"), F.inline("_seeds")))
    unkeyed = listed.where(f"NOT ({keyed})").withColumn("_mine", F.lit(None).cast(rows.schema["_mine"].dataType))
    # the seeds are held in memory, a partition at a time: similarity rows may be wide, and aren't sorted
    kept = pairs(rows.unionByName(unkeyed).hint("shuffle_hash")).where(~_is_mine(F.col("package_b"))).select(*keys, *cols)
    if long is None:
        return kept
    owned = seed_ids.join(long, keys, "left_semi").select(*keys, F.col("id").alias("package_b"))
    rest = pairs(seeds.join(long, keys, "left_semi")).select(*keys, *cols)
    return kept.unionByName(rest.join(owned, keys + ["package_b"], "left_anti"))


def candidates(similarity: DataFrame, seed_ids: DataFrame, keys: list[str] | None = None,
               seed_count: int | None = None, limit=None) -> DataFrame:
    """Pairs whose package_a is a seed and whose package_b is not owned (per key group).

    The seed table is broadcast only when its row count (given, or counted
    here) is within the broadcast bound; otherwise the seeds, with what their
    request owns, and the similarity table are shuffled, their pairs aren't.
    Other columns of the similarity table are kept.

    With `limit` (an int, or a column of seed_ids) and a similarity table
    carrying `neighbor_rank`, only each seed's first limit + owned neighbours
    are read, and of a table written in buckets only those of the seeds. Exact: a pair in the final top `limit` has at most limit - 1
    kept pairs of the same seed ahead of it, plus at most `owned` removed ones.
    """
    keys = keys or []
    seed_ids = seed_ids.select(*keys, "id", *([] if limit is None or isinstance(limit, int) else [limit]))
    if seed_count is None:
        seed_count = seed_ids.count()
    buckets = similarity_buckets(similarity)
    seed_ids = _any_id(seed_ids)
    owned = seed_ids.select(*keys, F.col("id").alias("package_b"))
    if seed_count <= MAX_BROADCAST_ROWS:
        owned = F.broadcast(owned)
    cols = ["package_a", "package_b", "similarity", "bounded_similarity"]
    cols += [c for c in similarity.columns if c not in (*cols, BUCKET, "neighbor_rank")]
    ranked = limit is not None and "neighbor_rank" in similarity.columns
    at = ["package_a"] + ([BUCKET] if buckets else [])
    s = similarity.select(*cols, *at[1:], *(["neighbor_rank"] if ranked else []))
    if ranked:
        lim = F.lit(limit) if isinstance(limit, int) else F.col(limit)
        seeds = seed_ids.select(*keys, F.col("id").alias("package_a"), lim.alias("_lim"))
        if keys:
            n_owned = seed_ids.groupBy(*keys).agg(F.count(F.lit(1)).alias("_owned"))
            seeds = seeds.join(n_owned, keys)
        else:
            seeds = seeds.withColumn("_owned", seed_ids.agg(F.count(F.lit(1))).scalar())
        seeds = seeds.select(*keys, "package_a", (F.col("_lim") + F.col("_owned")).alias("_bound"))
        if keys and seed_count > MAX_BROADCAST_ROWS:
            return _kept_pairs(seeds, s, seed_ids, keys, cols)
        if seed_count <= MAX_BROADCAST_ROWS:
            seeds = F.broadcast(seeds)
        pairs = (_in_bucket(seeds, buckets).join(s, at).where(F.col("neighbor_rank") <= F.col("_bound"))
                      .select(*keys, *cols))
    else:
        seeds = owned.select(*keys, F.col("package_b").alias("package_a"))
        if keys and seed_count > MAX_BROADCAST_ROWS:
            return _kept_pairs(seeds, s, seed_ids, keys, cols)
        seeds = _in_bucket(seeds, buckets)
        pairs = seeds.join(s, at).select(*keys, *cols) if keys else s.join(seeds, at, "left_semi").select(*cols)
    return pairs.join(owned, keys + ["package_b"], "left_anti")


# A round reads this many times further down the neighbour lists than the one before.
ROUND_GROWTH = 8


@dataclass
class EarlyTop:
    """The ranked pairs of `top_candidates`, and what it took to find them."""
    pairs: DataFrame
    rounds: int
    rows_read: int


def top_candidates(similarity: DataFrame, seed_ids: DataFrame) -> EarlyTop:
    """Each request's best pairs, reading its seeds' neighbour lists only as far as they can matter.

    similarity carries `neighbor_rank`; seed_ids(request_id, id,
    max_recommendations) is written. A list is read in blocks of falling
    similarity. The last row read is an upper bound of the rest: once as many
    kept pairs of the request as it may return come before or at that row, in
    the order of the answer (similarity, package_a, package_b), nothing further
    down that list is in the answer. The other lists go into the next round,
    eight times as far. The first block of a request is four times its share of
    `max_recommendations` per seed. Exact: the rows are those of the whole
    lists ranked together. Between rounds an unanswered request has its best pairs
    and one row a list, written to the checkpoint folder.
    """
    order = [F.desc("similarity"), F.col("package_a"), F.col("package_b")]
    buckets = similarity_buckets(similarity)
    at = ["package_a"] + ([BUCKET] if buckets else [])
    cols = ["request_id", "package_a", "package_b", "similarity", "bounded_similarity", "limit"]
    # one row a request: its lists, and what it owns
    requests = (seed_ids.where("request_id IS NOT NULL").groupBy("request_id")
                .agg(F.collect_list(F.struct(F.col("id").cast("long").alias("id"), F.col("max_recommendations").alias("limit"))).alias("seeds"))
                .transform(lambda d: materialize(d, "owned", PACKED)))
    active = (requests.select("request_id", F.size("seeds").alias("n"), F.explode("seeds").alias("seed"))
              .select("request_id", F.col("seed.id").alias("package_a"), F.col("seed.limit").alias("limit"), F.lit(0).cast("long").alias("lo"),
                      (F.ceil(4 * F.col("seed.limit") / F.col("n")) + 2).alias("hi")).where(F.col("limit") > 0))
    owned = seed_ids.select("request_id", F.col("id").cast("long").alias("package_b"), F.lit(True).alias("mine"))
    in_rows = seed_ids.count() > MAX_BROADCAST_ROWS
    if in_rows:
        short = F.size("seeds") <= OWNED_IN_ROW
        mine = requests.where(short).select("request_id", F.col("seeds.id").alias("_mine"))
        long = materialize(requests.where(~short).select("request_id"), "long-lists")
        long = None if long.isEmpty() else checked_broadcast(long)
        owned = owned if long is None else owned.join(long, "request_id", "left_semi")
    else:
        owned = F.broadcast(owned)
    w = Window.partitionBy("request_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    best, done, rounds, rows_read = None, [], 0, 0
    while True:
        n, lo, hi = active.agg(F.count(F.lit(1)), F.min("lo"), F.max("hi")).first()
        if n == 0:
            break
        # a filter on the lists' side of the join: their files are pruned by bucket, their pages by rank
        lists = active.where(F.col("hi") > 0)
        s = (similarity.where((F.col("neighbor_rank") > lo) & (F.col("neighbor_rank") <= hi))
             .select("package_a", "package_b", "similarity", "bounded_similarity", "neighbor_rank", *at[1:]))
        few = n <= MAX_BROADCAST_ROWS
        cap = None if few else active.agg(F.percentile_approx("hi", max(0.0, 1 - 0.9 * MAX_BROADCAST_ROWS / n))).first()[0]

        def read(lists: DataFrame) -> DataFrame:
            def found(lists: DataFrame, s: DataFrame, at: list[str]) -> DataFrame:
                return lists.join(s, at).where("neighbor_rank > lo and neighbor_rank <= hi")

            if few:
                return found(F.broadcast(_in_bucket(lists, buckets)), s, at)
            # the similarity table is moved only as far down as most lists are read; the few deeper ones are sent to it
            moved = s.where(F.col("neighbor_rank") <= cap).drop(BUCKET)
            shallow = found(lists.where(F.col("hi") <= cap), moved, ["package_a"])
            if cap >= hi:
                return shallow
            deep = checked_broadcast(_in_bucket(lists.where(F.col("hi") > cap), buckets), max_rows=MAX_BROADCAST_ROWS)
            return shallow.unionByName(found(deep, s, at).select(*shallow.columns))

        def marked(rows: DataFrame, kept: Column) -> DataFrame:
            return rows.select(*cols, kept.alias("kept"), F.when(F.col("neighbor_rank") == F.col("hi"), F.col("hi")).alias("read_to"))

        def compared(lists: DataFrame) -> DataFrame:
            return marked(read(lists).join(owned, ["request_id", "package_b"], "left"), F.col("mine").isNull())

        if not in_rows:
            rows = compared(lists)
        elif long is None:
            rows = marked(read(lists), F.lit(None).cast("boolean"))
        else:
            rows = (marked(read(lists.join(long, "request_id", "left_anti")), F.lit(None).cast("boolean"))
                    .unionByName(compared(lists.join(long, "request_id", "left_semi"))))
        seen = Observation(f"read-{rounds}")
        rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
        if best is not None:
            rows = rows.unionByName(best.select(*cols, F.lit(True).alias("kept"), F.lit(None).cast("long").alias("read_to")))
        if in_rows:
            # where a request's rows are ranked, they are compared with the list of what it owns, which moves once, not with each seed
            rows = (rows.join(mine.hint("shuffle_hash"), "request_id", "left")
                    .withColumn("kept", F.coalesce("kept", ~_is_mine(F.col("package_b")))).drop("_mine"))
        goes_on = F.col("read_to").isNotNull() & (F.col("rank") < F.col("limit"))
        found = materialize(rows.withColumn("rank", F.sum(F.col("kept").cast("int")).over(w))
                            .withColumn("open", F.max(F.coalesce(goes_on, F.lit(False))).over(Window.partitionBy("request_id")))
                            .where((F.col("kept") & (F.col("rank") <= F.col("limit"))) | goes_on), "best", PACKED)
        # a request without a list that goes on is answered: its rows stay where they are written
        best = found.where(F.col("kept") & F.col("open"))
        done.append(found.where(F.col("kept") & ~F.col("open")))
        # a list goes on if its last row read may be followed by a row of the answer
        active = found.where(goes_on).select(
            "request_id", "package_a", "limit", F.col("read_to").alias("lo"), (F.col("read_to") * ROUND_GROWTH).alias("hi"))
        rounds, rows_read = rounds + 1, rows_read + seen.get["rows"]
    if not done:
        done = [seed_ids.limit(0).join(similarity.limit(0).select("package_a", "package_b", "similarity", "bounded_similarity"),
                                       F.col("id") == F.col("package_a")).withColumn("rank", F.lit(0))]
    pairs = reduce(DataFrame.unionByName, [d.select("request_id", "package_a", "package_b", "similarity", "bounded_similarity",
                                                    F.col("rank").cast("int").alias("rank")) for d in done])
    return EarlyTop(pairs, rounds, rows_read)


def pair_metadata(pairs: DataFrame, packages: DataFrame, end_with: str = "package_b") -> DataFrame:
    """Attach the seed's short name and the recommendation's scores and display data.

    The packages (a written table) are broadcast within the bounds; beyond them
    the pairs end up with the other rows of `end_with`: with package_b, they
    are moved before the wide columns are on them; with package_a, whole
    similarity rows end up with the seed's other rows. For that last join a
    partition of the packages at a time is held in memory: pairs that may be
    wide by then aren't sorted. Before it they are, so that rows of equal texts
    move side by side.
    """
    a = packages.select(F.col("id").alias("package_a"), F.col("short_name").alias("for_package"))
    b = packages.select(F.col("id").alias("package_b"),
                        F.col("short_name").alias("recommended_package"), "url",
                        "bounded_popularity", "absolute_trend", "relative_trend",
                        "categories", "display_date", "monthly_downloads_last_month")
    sides = {"package_a": a, "package_b": b}
    for key in sorted(sides, key=lambda k: k == end_with):
        side = checked_broadcast(sides[key])
        held = key == end_with and side is sides[key]
        pairs = pairs.join(side.hint("shuffle_hash") if held else side, key)
    return pairs


def with_score(df: DataFrame) -> DataFrame:
    return df.withColumn("score", scoring.composite_score(
        "similarity", "bounded_popularity", "absolute_trend", "relative_trend"))


def top_n(df: DataFrame, n: int) -> DataFrame:
    """Highest similarity first; ties by (package_a, package_b) so the cut is deterministic."""
    return df.orderBy(F.desc("similarity"), "package_a", "package_b").limit(n)


def recommend(similarity: DataFrame, packages: DataFrame, dependencies: DataFrame,
              max_recommendations: int = DEFAULT_MAX_RECOMMENDATIONS) -> DataFrame:
    """Recommendations for one dependency list (`dependencies(purl)`).

    One row per (seed, recommended package) pair: the same package may be
    recommended once per seed. An empty or unknown list gives no rows.
    """
    deps, n_deps = checked_broadcast_with_count(dependencies)
    # names are unique in packages, so the seed ids are at most n_deps rows
    # written once: the owned side, the seeds and their count read it
    ids = materialize(resolve_seeds(packages, seed_names(deps)), "seeds")
    # rank the bare pairs first; metadata is joined to the kept rows only
    best = top_n(candidates(similarity, ids, seed_count=n_deps, limit=max_recommendations),
                 max_recommendations)
    rows = with_score(pair_metadata(best, packages))
    return rows.orderBy(F.desc("similarity"), "package_a", "package_b").select(
        *RESULT_COLUMNS, "similarity", "package_a", "package_b")


def recommend_batch(similarity: DataFrame, packages: DataFrame, requests: DataFrame,
                    limits: DataFrame) -> DataFrame:
    """Recommendations for many requests at once.

    requests(request_id, purl): the parsed dependencies of each request;
    limits(request_id, max_recommendations). Owned packages are excluded per
    request, and each request keeps its own top `max_recommendations`.
    Lists with a `neighbor_rank` are read block by block (`top_candidates`),
    which leaves each request's answer to be numbered. Either way the rank
    filter uses the largest limit as a literal first, so Catalyst applies a
    partial per-request top-k before the shuffle (no request's full candidate
    list is moved); whole lists then take the exact per-request limit.
    """
    keys = ["request_id"]
    # The resolved seed table (requests × their known dependencies) is written
    # once; its size check, the limit and both joins read the written copy.
    ids = (resolve_seeds(packages, seed_names(requests), keys)
           .join(limits.select("request_id", "max_recommendations"), "request_id")
           .transform(lambda d: materialize(d, "seeds", PACKED)))
    cap = F.lit(int(ids.agg(F.max("max_recommendations")).first()[0] or 0))
    w = Window.partitionBy("request_id").orderBy(F.desc("similarity"), "package_a", "package_b")
    if "neighbor_rank" in similarity.columns:
        pairs = top_candidates(similarity, ids).pairs.drop("rank")
        ranked = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)
    else:
        n_ids = ids.count()
        lim = ids.select("request_id", "max_recommendations").distinct()
        lim = F.broadcast(lim) if n_ids <= MAX_BROADCAST_ROWS else lim
        ranked = (candidates(similarity, ids, keys, n_ids).withColumn("rank", F.row_number().over(w))
                  .where(F.col("rank") <= cap).join(lim, "request_id").where(F.col("rank") <= F.col("max_recommendations")))
    # only the kept rows get metadata and a score
    rows = with_score(pair_metadata(ranked, packages))
    return rows.select("request_id", "rank", *RESULT_COLUMNS, "similarity", "package_a", "package_b")


def recommendation_records(df: DataFrame) -> DataFrame:
    """API field names for the 11 result columns (other columns kept)."""
    return df.withColumnsRenamed(RECORD_NAMES)


def response_documents(records: DataFrame, requests: DataFrame) -> DataFrame:
    """One JSON response per valid request: {language, recommended_dependencies[]}.

    records(request_id, rank, <API fields>); requests(request_id, language).
    The list is ordered by rank and holds at most that request's limit.
    """
    fields = list(RECORD_NAMES.values())
    per_request = records.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", *fields))).alias("recs"))
    j = requests.select("request_id", "language").join(per_request, "request_id", "left")
    recs = F.coalesce(F.transform("recs", lambda r: r.dropFields("rank")),
                      F.array().cast("array<struct<%s>>" % ",".join(
                          f"{f}:{records.schema[f].dataType.simpleString()}" for f in fields)))
    return j.select("request_id", F.to_json(F.struct(F.col("language"),
                                                     recs.alias("recommended_dependencies")))
                    .alias("response"))
