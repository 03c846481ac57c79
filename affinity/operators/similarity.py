"""Item-to-item cosine similarity of the application × package 0/1 matrix.

For packages a and b used by n_a and n_b applications, c of them shared,
cosine = c / sqrt(n_a * n_b). Only pairs with c > 0 exist; the matrix is never
densified and no row passes through the driver.

Edges move once, into baskets: one row per application with its sorted distinct
packages. A basket's pairs are made inside its row, where they stand, and only
the pairs move again, combined before the shuffle. An application holding more
than `cell_rows` packages is split into g hash chunks instead, and each pair of
chunks is one cell, so no task makes more than about `cell_rows`² pairs.

Pair counts c and degrees n are sums over applications, so both are a state
that changes of edges are added to (`edge_changes`, `merge_state`).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinity.session import PACKED, materialize as write_once

from affinity.functions.scoring import bounded_similarity
from affinity.operators.joins import checked_broadcast
from affinity.operators.merge import rank_within

APP = "application_id"
PKG = "package_id"
# Basket rows per side of one pair-generation cell. Baskets larger than this
# are split into ceil(size / cell_rows) hash chunks.
DEFAULT_CELL_ROWS = 4096
# Pairs that one task makes and combines before the shuffle (a single basket may have more): its hash map holds them.
PAIRS_A_TASK = 1_000_000


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """Unique (application_id, package_id) pairs."""
    return edges.select(APP, PKG).dropDuplicates([APP, PKG])


def oversized_baskets(edges: DataFrame, cell_rows: int = DEFAULT_CELL_ROWS) -> DataFrame:
    """(application_id, g): the number of chunks of each application of more than `cell_rows` distinct packages.

    Rows are counted first (map-side combined, one long per application); only
    applications with that many rows, repeated edges included, have their
    distinct packages counted.
    """
    rows = edges.groupBy(APP).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > cell_rows)
    rows = write_once(rows.select(APP, F.lit(1).alias("g")), "oversized")
    if rows.isEmpty():
        return rows
    rows = rows.select(APP)
    sizes = (dedupe_edges(edges.join(checked_broadcast(rows), APP, "left_semi"))
             .groupBy(APP).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_rows))
    return write_once(sizes.select(APP, F.ceil(F.col("n") / cell_rows).cast("int").alias("g")), "oversized")


def chunked_baskets(edges: DataFrame, cell_rows: int = DEFAULT_CELL_ROWS) -> DataFrame:
    """(application_id, g, chunk, package_ids sorted): one row per application, g rows for an oversized one."""
    e = edges.select(APP, PKG)
    heavy = oversized_baskets(e, cell_rows)
    ids = F.sort_array(F.collect_set(PKG)).alias("package_ids")
    # moved before they are collected: few edges repeat, so collecting on the map side would save nothing
    if heavy.isEmpty():
        return e.repartition(APP).groupBy(APP).agg(ids).select(APP, F.lit(1).alias("g"), F.lit(0).alias("chunk"), "package_ids")
    keyed = (e.join(checked_broadcast(heavy), APP, "left")
              .select(APP, PKG, F.coalesce("g", F.lit(1)).alias("g"))
              .withColumn("chunk", F.pmod(F.xxhash64(PKG), F.col("g")).cast("int")))
    return keyed.repartition(APP, "g", "chunk").groupBy(APP, "g", "chunk").agg(ids)


def spread(chunks: DataFrame, pairs_a_task: int) -> DataFrame:
    """The baskets over so many tasks that each makes about `pairs_a_task` pairs: a scan's tasks follow the cores."""
    size = F.size("package_ids").cast("long")
    pairs = chunks.agg(F.sum(F.floor(size * (size - 1) / 2))).first()[0] or 0
    tasks = -(-pairs // pairs_a_task)
    return chunks if tasks <= 1 else chunks.repartition(max(tasks, chunks.sparkSession.sparkContext.defaultParallelism))


def _triangle(chunks: DataFrame) -> DataFrame:
    """(package_a, package_b), a < b, of each row's sorted packages, made row by row."""
    heads = chunks.where(F.size("package_ids") > 1).select(
        "package_ids", F.posexplode("package_ids").alias("i", "package_a"))
    rest = F.slice("package_ids", F.col("i") + 2, F.size("package_ids"))
    return heads.select("package_a", F.explode(rest).alias("package_b"))


def _between_chunks(chunks: DataFrame) -> DataFrame:
    """Pairs whose packages are in two chunks i < j of one application: one cell, and one task at most, each."""
    split = chunks.where(F.col("g") > 1)
    left = split.select(APP, F.col("chunk").alias("i"), F.col("package_ids").alias("xs"),
                        F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("j")).where("i < j")
    right = split.select(APP, F.col("chunk").alias("j"), F.col("package_ids").alias("ys"),
                         F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("i")).where("i < j")
    cells = left.join(right, [APP, "i", "j"])
    x = cells.select("ys", F.explode("xs").alias("x")).select("x", F.explode("ys").alias("y"))
    return x.select(F.least("x", "y").alias("package_a"), F.greatest("x", "y").alias("package_b"))


@dataclass
class State:
    """What similarity is computed from, all sums over applications: edges, shared applications, degrees."""
    edges: DataFrame           # application_id, package_id: unique
    counts: DataFrame          # package_a, package_b (a < b), c > 0
    degrees: DataFrame         # package_id, n > 0

def state(edges: DataFrame, cell_rows: int = DEFAULT_CELL_ROWS) -> State:
    """The state of a whole edge table (duplicates allowed). The baskets are written once."""
    chunks = write_once(chunked_baskets(edges, cell_rows), "baskets", PACKED)
    pairs = [_triangle(spread(chunks, PAIRS_A_TASK))]
    if not chunks.where(F.col("g") > 1).isEmpty():
        pairs.append(_between_chunks(chunks))
    counts = reduce(DataFrame.unionByName, pairs).groupBy("package_a", "package_b").agg(F.count(F.lit(1)).alias("c"))
    members = chunks.select(APP, F.explode("package_ids").alias(PKG))
    return State(members, counts, members.groupBy(PKG).agg(F.count(F.lit(1)).alias("n")))


def cosine(counts: DataFrame, degrees: DataFrame) -> DataFrame:
    """(package_a, package_b, similarity) from pair counts and (written) degrees; exactly 1.0 for identical columns."""
    n = checked_broadcast(degrees)
    a = n.select(F.col(PKG).alias("package_a"), F.col("n").alias("n_a"))
    b = n.select(F.col(PKG).alias("package_b"), F.col("n").alias("n_b"))
    return counts.join(a, "package_a").join(b, "package_b").select(
        "package_a", "package_b",
        (F.col("c") / F.sqrt(F.col("n_a").cast("double") * F.col("n_b").cast("double"))).alias("similarity"))


def similarity_pairs(edges: DataFrame, cell_rows: int = DEFAULT_CELL_ROWS) -> DataFrame:
    """Upper triangle (package_a < package_b) of the cosine matrix, non-zero cells only.

    `edges` holds (application_id, package_id), duplicates allowed.
    """
    s = state(edges, cell_rows)
    return cosine(s.counts, write_once(s.degrees, "degrees"))


def edge_changes(current: State, deltas: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What signed edges (application_id, package_id, sign ±1) change: (edges, counts, degrees), signed.

    The signs of an edge are added up: above zero it is there afterwards, below
    zero it isn't, at zero nothing changes. Adding an edge that is there or
    removing one that isn't changes nothing. Only the baskets of applications
    with a real change are read further, and only pairs of a changed package.
    """
    net = (deltas.groupBy(APP, PKG).agg(F.sum("sign").alias("net")).where("net <> 0"))
    found = net.join(current.edges.select(APP, PKG, F.lit(1).alias("before")), [APP, PKG], "left")
    changed = (found.select(APP, PKG, F.coalesce("before", F.lit(0)).alias("before"),
                            F.when(F.col("net") > 0, 1).otherwise(0).alias("after"))
               .where("before <> after").transform(lambda d: write_once(d, "changed")))
    touched = current.edges.join(changed.select(APP).distinct(), APP, "left_semi")
    stay = touched.join(changed.select(APP, PKG), [APP, PKG], "left_anti").select(
        APP, F.col(PKG).alias("other"), F.lit(1).alias("o_before"), F.lit(1).alias("o_after"))
    also = changed.select(APP, F.col(PKG).alias("other"), F.col("before").alias("o_before"), F.col("after").alias("o_after"))
    # a pair of two changed packages is taken once, from the smaller one
    pairs = (changed.join(stay, APP).unionByName(changed.join(also, APP).where(F.col(PKG) < F.col("other")))
             .withColumn("c", F.col("after") * F.col("o_after") - F.col("before") * F.col("o_before")).where("c <> 0"))
    counts = pairs.groupBy(F.least(PKG, "other").alias("package_a"), F.greatest(PKG, "other").alias("package_b")).agg(
        F.sum("c").alias("c"))
    signed = changed.select(APP, PKG, (F.col("after") - F.col("before")).alias("sign"))
    return signed, counts.where("c <> 0"), signed.groupBy(PKG).agg(F.sum("sign").alias("n"))


def merge_state(current: State, deltas: DataFrame) -> State:
    """The state after signed edges: equal to the state of the changed edge table, without going through all baskets."""
    edges, counts, degrees = edge_changes(current, deltas)
    gone = edges.where("sign < 0").select(APP, PKG)
    return State(
        current.edges.join(gone, [APP, PKG], "left_anti").unionByName(edges.where("sign > 0").select(APP, PKG)),
        current.counts.unionByName(counts).groupBy("package_a", "package_b").agg(F.sum("c").alias("c")).where("c > 0"),
        current.degrees.unionByName(degrees).groupBy(PKG).agg(F.sum("n").alias("n")).where("n > 0"))


def mirror_pairs(pairs: DataFrame) -> DataFrame:
    """Both directions of every pair, so lookups only search package_a.

    One pass: each pair row yields its two orientations (no union of two
    scans of the pair table).
    """
    both = F.explode(F.array(
        F.struct(F.col("package_a").alias("a"), F.col("package_b").alias("b")),
        F.struct(F.col("package_b").alias("a"), F.col("package_a").alias("b"))))
    return (pairs.select(both.alias("d"), "similarity")
                 .select(F.col("d.a").alias("package_a"), F.col("d.b").alias("package_b"), "similarity"))


def similarity_frame(edges: DataFrame, **kwargs) -> DataFrame:
    """The similarity table: mirrored pairs with their bounded similarity (1..10)."""
    return scored_mirror(similarity_pairs(edges, **kwargs))


def with_bounded(pairs: DataFrame) -> DataFrame:
    """The pairs with their bounded similarity (1..10), unless they have it; it follows from the similarity and needn't be moved."""
    if "bounded_similarity" in pairs.columns:
        return pairs
    cols = ["package_a", "package_b", "similarity"]
    return pairs.select(*cols, bounded_similarity("similarity").alias("bounded_similarity"), *[c for c in pairs.columns if c not in cols])


def scored_mirror(pairs: DataFrame) -> DataFrame:
    """Both directions of every pair with its bounded similarity (1..10)."""
    return with_bounded(mirror_pairs(pairs))


def baskets(edges: DataFrame, cell_rows: int = DEFAULT_CELL_ROWS) -> DataFrame:
    """Sorted package ids per application, `cell_rows` to a chunk.

    The packages of an application are numbered by a distributed ranking, and
    package number p (from 1) is in chunk (p - 1) div cell_rows, so the result
    has one meaning at every size and no row or task holds a whole large basket.
    """
    ranked = rank_within(dedupe_edges(edges), APP, [F.col(PKG)], "position")
    chunk = F.floor((F.col("position") - 1) / cell_rows).cast("int")
    return (ranked.groupBy(APP, chunk.alias("chunk"))
             .agg(F.array_sort(F.collect_list(PKG)).alias("package_ids")))



def one_hot_coordinates(edges: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Binary application × package matrix as (application_id, index, value=1.0) entries.

    vocabulary(index, package_id) is a table (see `merge.assign_ids`), joined
    like any dimension; the matrix is never densified or collected.
    """
    e = dedupe_edges(edges)
    return e.join(vocabulary, PKG).select(APP, "index", F.lit(1.0).alias("value"))


# Largest group one task may sort for a window (rows).
WINDOW_GROUP_ROWS = 2_000_000


def longest_list(counts: DataFrame, packages: int) -> int:
    """A bound of the rows of one neighbour list: the number of packages, or if that is large the longest list itself."""
    if packages <= WINDOW_GROUP_ROWS:
        return packages
    ends = counts.select(F.explode(F.array("package_a", "package_b")).alias(PKG))
    return ends.groupBy(PKG).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def rank_neighbours(sim: DataFrame, max_neighbours: int | None = None) -> DataFrame:
    """Adds neighbor_rank: position of package_b among package_a's neighbours.

    Order: similarity descending, then package_b — the serving order within
    one seed. Computed once at train time. A neighbour list holds at most one
    row per package, so `max_neighbours` (the package count) bounds every
    group: within WINDOW_GROUP_ROWS a window ranks it in one task, beyond it
    (or without a bound) the distributed `merge.rank_within` does. Serving
    uses the rank to read only the top (limit + owned) neighbours of each
    seed, which is exact (see `recommend.candidates`).
    """
    order = [F.desc("similarity"), F.col("package_b")]
    if max_neighbours is not None and max_neighbours <= WINDOW_GROUP_ROWS:
        w = Window.partitionBy("package_a").orderBy(*order)
        return sim.withColumn("neighbor_rank", F.row_number().over(w))
    from affinity.operators.merge import rank_within
    return rank_within(sim, "package_a", order, "neighbor_rank")
