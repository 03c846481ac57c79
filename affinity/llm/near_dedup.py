"""Operator 1: near-duplicate documents by SetSketch registers.

Sketch. A document's set of word shingles is reduced to `REGISTERS` registers:
each is the exponent of the smallest of the set's exponentially distributed
hash values, cut to 16 bits. Registers merge by their maximum, and two sets
agree on a register with a probability close to their Jaccard similarity.

Candidates. Documents with equal sets become one node. Bands of `ROWS`
registers are hashed; nodes that share a band's bucket are candidates. At a
similarity of 0.8 a pair misses all 32 buckets with probability 5e-8.

Links. In each bucket the node whose buckets are fullest is the hub, and the
others are compared with it; in a group of edited copies that is the copy
closest to what they have in common. The members of a hub that its links leave
in several components are then compared with each other, in pairs of blocks of
`BLOCK` nodes, first by registers and then by the full sets of the nodes that
may have a partner; a block pair returns the links that tie components
together. So no link that matters is lost, no task emits pairs, and a group
that has come together costs nothing more. A pair is given up when the joint
likelihood of its registers (their order and ties, given the exact set sizes)
makes the threshold hopeless (a log-likelihood ratio over `SURELY`); all others
are confirmed on the full sets. Components follow from the links.

Shingles are 64-bit hashes of word sequences; sets are compared by them.

Defined results: a document without words (or null) has an empty set and is
linked with nothing; one with fewer words than a shingle has one shingle, its
whole sequence; rows sharing an id belong to one component; a row without an
id is linked with nothing and kept; repeated rows get the same result each;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinity.llm.common import fresh, release, text_or_empty
from affinity.operators.joins import checked_broadcast
from affinity.llm.components import components
from affinity.session import materialize

REGISTERS = 128
ROWS = 4                  # registers a band: 32 bands
BASE = 1.001
RATE = 20.0
TOP = (1 << 16) - 1
SURELY = 18.0             # a true link is given up with a probability of about 1e-8
BLOCK = 512
COLUMNS = 4_096           # shingles in a slice of a block's membership matrix

_random = np.random.default_rng(1)
_TIMES = _random.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _random.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text (A-Z lower-cased)."""
    digest = xxhash.xxh3_64_intdigest
    words = np.array([digest(w) for w in text.encode().lower().split()], np.uint64)
    if not len(words):
        return words
    length = min(size, len(words))
    out = np.full(len(words) - length + 1, length, np.uint64)
    for k in range(length):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + words[k:k + len(out)])
    return np.unique(out)


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[at:at + 1024, None] * _TIMES + _PLUS).min(0))
    # the smallest of uniform values, as the smallest of exponential ones
    smallest = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0 ** 64 * (1 - 1e-16))
    exponent = np.floor(1 - np.log(np.maximum(smallest, 1e-300) / RATE) / np.log(BASE))
    return np.clip(exponent, 0, TOP).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def _share(x: np.ndarray) -> np.ndarray:
    """How far a share of the smaller hash values shows in the order of registers."""
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def _log_likelihood(j: np.ndarray, u: np.ndarray, above: np.ndarray, below: np.ndarray, ties: np.ndarray) -> np.ndarray:
    v = 1 - u
    p_above, p_below = _share(np.maximum(u - v * j, 0)), _share(np.maximum(v - u * j, 0))
    p_tie = np.maximum(1 - p_above - p_below, 1e-12)
    return (above * np.log(np.maximum(p_above, 1e-12)) + below * np.log(np.maximum(p_below, 1e-12))
            + ties * np.log(p_tie))


def estimate(n_a, n_b, above, below, ties) -> tuple[np.ndarray, np.ndarray]:
    """Most likely Jaccard similarity and its log-likelihood, from the order and ties of two sketches' registers."""
    n_a, n_b, above, below, ties = (np.asarray(x, np.float64) for x in (n_a, n_b, above, below, ties))
    u = n_a / (n_a + n_b)
    low, high = np.zeros_like(u), np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    for _ in range(30):                     # the likelihood is concave in j
        a, b = low + (high - low) / 3, high - (high - low) / 3
        better = _log_likelihood(a, u, above, below, ties) < _log_likelihood(b, u, above, below, ties)
        low, high = np.where(better, a, low), np.where(better, high, b)
    j = (low + high) / 2
    return j, _log_likelihood(j, u, above, below, ties)


def hopeful(n_a: np.ndarray, n_b: np.ndarray, above: np.ndarray, below: np.ndarray, ties: np.ndarray,
            percent: int) -> np.ndarray:
    """Pairs that may reach the threshold: by their sizes, and by the likelihood of their registers."""
    n_a, n_b = np.asarray(n_a, np.float64), np.asarray(n_b, np.float64)
    fits = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    j, best = estimate(n_a, n_b, above, below, ties)
    at = np.minimum(percent / 100, np.minimum(n_a, n_b) / np.maximum(n_a, n_b))
    there = _log_likelihood(at, n_a / (n_a + n_b), *(np.asarray(x, np.float64) for x in (above, below, ties)))
    return fits & ((j >= percent / 100) | (best - there <= SURELY))


def sketch_documents(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text_key, n, set_key, registers, node) of every row, written once; set_key names the set, node is its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            counts, keys, made = [], [], []
            for text in batch.column(2).to_pylist():
                s = shingle_set(text, shingle)
                counts.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                made.append(registers(s).tobytes() if len(s) else b"")
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()),
                                   pa.array(made, pa.binary())], ["doc_id", "text_key", "n", "set_key", "registers"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"),
                       text_or_empty().alias("text"))
    made = rows.mapInArrow(run, "doc_id long, text_key long, n long, set_key binary, registers binary")
    return materialize(made.withColumn("node", F.xxhash64("set_key")), "sketches")


def _bands(nodes: DataFrame) -> DataFrame:
    """(bucket, node): one row a node and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sketch = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, -1, ROWS)
            quad = np.ascontiguousarray(sketch).view(np.uint64)[:, :, 0]
            buckets = _mix(_mix(quad) + np.arange(quad.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            repeat = pa.array(np.repeat(np.arange(batch.num_rows), quad.shape[1]))
            yield pa.record_batch([pa.array(buckets.view(np.int64).ravel()), batch.column(0).take(repeat)],
                                  ["bucket", "node"])

    return nodes.select("node", "registers").mapInArrow(run, "bucket long, node long")


def _promising(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that their registers don't rule out."""
    def side(name: str) -> DataFrame:
        return nodes.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"),
                            F.col("registers").alias(f"r_{name}"))

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "r_a", "r_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
                    for i in (4, 5))
            keep = pa.array(hopeful(batch.column(2).to_numpy(), batch.column(3).to_numpy(),
                                    (x > y).sum(1), (x < y).sum(1), (x == y).sum(1), percent))
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(keep)

    return materialize(joined.mapInArrow(run, "a long, b long").distinct(), "promising")


def _sets(wanted: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles): the full sets of the nodes in `wanted` (node), made again from a text of each."""
    ends = materialize(wanted.distinct().join(nodes.select("node", "doc", "set_key"), "node"), "wanted-sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sets = [], []
            for k, (text, key) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                s = shingle_set(text, shingle)
                if xxhash.xxh3_128_digest(s.tobytes()) == key:
                    rows.append(k)
                    sets.append(s.view(np.int64))
            yield pa.record_batch([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(sets, pa.list_(pa.int64()))],
                                  ["node", "shingles"])

    # the filter holds for every row; with it Spark sends a bounded Bloom filter of the ids to the scan of the
    # texts, so that only about the wanted ones are shuffled
    ends = ends.where("set_key <> X''")
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc"), text_or_empty().alias("text"))
             .join(ends, "doc").select("node", "text", "set_key"))
    sets = texts.mapInArrow(run, "node long, shingles array<long>")
    # rows that share the id and the set give it more than once
    return materialize(sets.dropDuplicates(["node"]), "sets")


def _confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    sets = _sets(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))), docs, nodes, shingle)
    both = (pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("s_b")), "b")
            .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s_a")), "a"))
    common = F.size(F.array_intersect("s_a", "s_b"))
    union = F.size("s_a") + F.size("s_b") - common
    return materialize(both.where(100 * common >= percent * union).select("a", "b").distinct(), "confirmed")


def _hub_members(shared: DataFrame) -> DataFrame:
    """(hub, node): the nodes that share a bucket (bucket, node, members) with the bucket's hub.

    The hub is the node with the most members in all its buckets, the
    smallest node on a tie.
    """
    scores = shared.groupBy("node").agg(F.sum("members").alias("score"))
    hubs = (shared.join(scores, "node").groupBy("bucket")
            .agg(F.max(F.struct("score", (-F.col("node")).alias("minus"))).alias("hub"))
            .select("bucket", (-F.col("hub.minus")).alias("hub")))
    return shared.join(hubs, "bucket").where("hub <> node").select("hub", "node").distinct()


def _apart(members: DataFrame, links: DataFrame) -> DataFrame:
    """(hub, node, component, members) of the hubs whose nodes are still in several components."""
    found = components(links)
    rows = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    hubs = rows.groupBy("hub").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                   F.count("*").alias("members")).where("lo <> hi").select("hub", "members")
    return materialize(rows.join(hubs, "hub").select("hub", "node", "component", "members"), "apart")


def _by_blocks(rows: DataFrame, run, schema: str) -> DataFrame:
    """Apply `run` to every pair of blocks of a hub's rows; at most 2 * BLOCK rows on average meet in a task."""
    dealt = (rows.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
             .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
             .drop("blocks", "other", "members"))
    return dealt.groupBy("hub", "i", "j").applyInArrow(run, schema)


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of the left and the right block, and whether they are one."""
    own, i, j = table["own"].to_numpy(), table["i"][0].as_py(), table["j"][0].as_py()
    return np.flatnonzero(own == i), np.flatnonzero(own == j), i == j


def _promising_members(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(hub, node, component): those with a promising pair across components in their hub's block pairs."""

    def run(table: pa.Table) -> pa.Table:
        left, right, _ = _sides(table)
        part, n = (table[c].to_numpy() for c in ("component", "n"))
        some = np.zeros(table.num_rows, bool)
        if len(np.unique(part)) > 1:
            sketch = np.frombuffer(b"".join(table["registers"].to_pylist()), np.uint16).reshape(table.num_rows, -1)
            for x in left:
                y = right[part[right] != part[x]]
                same = (sketch[y] == sketch[x]).sum(1)
                y, same = y[same >= REGISTERS // 3], same[same >= REGISTERS // 3]   # at 0.8 fewer have odds below 1e-30
                if len(y):
                    above = (sketch[y] < sketch[x]).sum(1)
                    y = y[hopeful(np.full(len(y), n[x]), n[y], above, REGISTERS - same - above, same, percent)]
                    some[y] = True
                    some[x] |= len(y) > 0
        return table.select(["hub", "node", "component"]).filter(pa.array(some))

    found = _by_blocks(rows.join(nodes.select("node", "n", "registers"), "node"), run,
                       "hub long, node long, component long").distinct()
    return materialize(found, "promising-members")


def _exact_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links across components among a hub's members, by their full sets.

    Of the links in a pair of blocks, those that tie components together are
    returned (a spanning forest), which leaves the components as they are.
    """

    def run(table: pa.Table) -> pa.Table:
        left, right, one = _sides(table)
        node, part = (table[c].to_numpy() for c in ("node", "component"))
        shingles = [np.asarray(s) for s in (x.values.to_numpy() for x in table["shingles"])]
        n = np.array([len(s) for s in shingles])
        ids = np.unique(np.concatenate(shingles), return_inverse=True)[1]
        owner = np.repeat(np.arange(len(n)), n)
        counts = np.bincount(ids)
        frequent = np.cumsum(counts > 1) - 1                       # only a shared shingle adds to an intersection
        keep = counts[ids] > 1
        ids, owner = frequent[ids[keep]], owner[keep]
        order = np.argsort(ids, kind="stable")
        ids, owner = ids[order], owner[order]
        common = np.zeros((len(left), len(right)), np.float32)
        for at in range(0, int(ids[-1]) + 1 if len(ids) else 0, COLUMNS):
            lo, hi = np.searchsorted(ids, [at, at + COLUMNS])
            x = np.zeros((len(n), COLUMNS), np.float32)
            x[owner[lo:hi], ids[lo:hi] - at] = 1
            common += x[left] @ x[right].T
        common = np.rint(common).astype(np.int64)
        linked = 100 * common >= percent * (n[left][:, None] + n[right][None] - common)
        linked &= part[left][:, None] != part[right][None]
        root = {int(c): int(c) for c in part}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        a, b = [], []
        for x, y in zip(*np.nonzero(linked)):
            x, y = left[x], right[y]
            c, d = find(int(part[x])), find(int(part[y]))
            if c != d:
                root[max(c, d)] = min(c, d)
                a.append(min(node[x], node[y]))
                b.append(max(node[x], node[y]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    counted = members.join(members.groupBy("hub").agg(F.count("*").alias("members")), "hub")
    return materialize(_by_blocks(counted.join(sets, "node"), run, "a long, b long").distinct(), "exact-links")


def set_links(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sketches, nodes, links): a node is a distinct shingle set of rows with an id; links (a, b) tie nodes together.

    The links join whatever reaches the threshold into one component; copies
    of a text are one node, combined before they are shuffled.
    """
    sketches = sketch_documents(docs, shingle)
    usable = sketches.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    nodes = materialize(usable.groupBy("node").agg(F.min("doc_id").alias("doc"), F.min("set_key").alias("set_key"),
                                                   F.max("n").alias("n"), F.max("registers").alias("registers")), "nodes")
    bands = _bands(nodes)
    members = bands.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    shared = materialize(bands.join(members, "bucket"), "shared-buckets")
    members = materialize(_hub_members(shared), "hub-members")
    pairs = members.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    links = _confirmed(_promising(pairs, nodes, percent), docs, nodes, shingle, percent)
    left = _promising_members(_apart(members, links), nodes, percent)
    return sketches, nodes, links.union(_exact_links(left, _sets(left.select("node"), docs, nodes, shingle), percent))


def _component_of_nodes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) of every node; a component is named by one of its nodes."""
    return nodes.select("node").join(components(links), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; linked: Jaccard similarity of `percent` or more."""
    sketches, nodes, links = set_links(docs, shingle, percent)
    usable = sketches.where(F.col("doc_id").isNotNull() & (F.col("n") > 0)).select("doc_id", "node")
    # rows that share an id but not a set tie their sets together
    several = materialize(usable.groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
                          .select("doc_id", "lo"), "shared-ids")
    if not several.isEmpty():
        links = links.union(usable.join(several, "doc_id").select(F.col("lo").alias("a"), F.col("node").alias("b")))
    of_nodes = _component_of_nodes(nodes, links)
    least = of_nodes.join(nodes.select("node", "doc"), "node")
    named = least.join(least.groupBy("component").agg(F.min("doc").alias("component_id")), "component").select("node", "component_id")
    return (sketches.select("doc_id", F.col("n").alias("n_shingles"), "node")
            .join(named, "node", "left")
            .select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id"))
                    .otherwise(F.col("doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


# Rows to be dropped are broadcast up to this size; more are joined by a shuffle.
MAX_SENT_BYTES = 32 << 20


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component of texts, the one of the smallest id, with its columns.

    Here a row is known by its id and text: of rows that share an id but
    resemble nothing kept, each stays; of equal rows, and of an id's rows of
    one component, one stays (of the smallest text hash). Rows without id or
    without shingles stay.
    """
    id_, key, of = (fresh(x, docs.columns) for x in ("__id", "__key", "__row"))
    sketches, nodes, links = set_links(docs, shingle, percent)
    rows = (sketches.where(F.col("doc_id").isNotNull() & (F.col("n") > 0)).select("doc_id", "text_key", "node").distinct()
            .join(_component_of_nodes(nodes, links), "node"))
    best = rows.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("best"))
    dropped = materialize(rows.join(best, "component").where(F.struct("doc_id", "text_key") != F.col("best"))
                          .select(F.col("doc_id").alias(id_), F.col("text_key").alias(key)), "dropped")
    same = (docs["doc_id"].cast("long") == F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(key))
    out = docs.join(checked_broadcast(dropped, max_bytes=MAX_SENT_BYTES), same, "left_anti")
    repeated = sketches.where("doc_id is not null and n > 0").groupBy("doc_id", "text_key").count().where("count > 1")
    if not repeated.isEmpty():
        order = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.xxhash64("text"))
        first = F.when(F.col("doc_id").isNull() | ~text_or_empty().rlike("[^ \t-\r]"), 1).otherwise(F.row_number().over(order))
        out = out.withColumn(of, first).where(F.col(of) == 1).drop(of)
    return out
