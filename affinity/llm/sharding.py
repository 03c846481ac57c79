"""Operator 5: sharding by fixed virtual slots.

A record is hashed into one of a fixed number of virtual slots, by its id and
its text. The bytes of each slot are aggregated, and a slot-to-shard map,
which has one row a slot however large the input is, places whole slots so
that the shards' bytes come out near equal. The map is a versioned table:
rebalancing reads the newest version, moves as few slots as it needs, and
writes the next version; records keep their slots for good, so only the moved
slots' records change shard. Law: `bytes`.

Within a shard records are numbered from 0 in the order of (virtual slot, id,
size, checksum): the count of the shard's earlier slots plus the place in the
slot, so no task ever sees more than one slot's keys.

Defined results: null text has size 1 (no bytes plus 1) and the checksum of
empty text; a null id is hashed like any other value; repeated rows share a
slot and take consecutive places; an empty table gives an empty map of zero
bytes and no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinity.llm.common import text_or_empty

SLOTS = 4_096
MAP_SCHEMA = "version int, virtual_slot int, shard int, bytes long, records long"


def virtual_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot."""
    text = text_or_empty()
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"),
                       F.pmod(F.xxhash64("doc_id", text), F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_totals(records: DataFrame, slots: int = SLOTS) -> dict[int, tuple[int, int]]:
    """(bytes, records) of each slot; `slots` rows at most come to the driver."""
    rows = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("records")).collect()
    found = {r["virtual_slot"]: (r["bytes"], r["records"]) for r in rows}
    return {s: found.get(s, (0, 0)) for s in range(slots)}


def place_slots(totals: dict[int, tuple[int, int]], shards: int) -> dict[int, int]:
    """A first map: the largest slot first, each to the shard with the fewest bytes."""
    heap = [(0, shard) for shard in range(shards)]
    placed = {}
    for slot, (size, _) in sorted(totals.items(), key=lambda x: (-x[1][0], x[0])):
        load, shard = heapq.heappop(heap)
        placed[slot] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def rebalance_slots(placed: dict[int, int], totals: dict[int, tuple[int, int]], shards: int,
                    tolerance: float = 0.02) -> dict[int, int]:
    """An edited map for new totals or another number of shards, moving few slots.

    Slots of shards that are gone are placed first. Then, while the fullest
    shard is more than `tolerance` above the mean, its largest slot that fits
    in the emptiest shard moves there.
    """
    out = {s: shard for s, shard in placed.items() if shard < shards}
    load = [0] * shards
    for s, shard in out.items():
        load[shard] += totals[s][0]
    for s in sorted(set(totals) - set(out), key=lambda s: (-totals[s][0], s)):
        out[s] = min(range(shards), key=lambda k: (load[k], k))
        load[out[s]] += totals[s][0]
    mean = sum(load) / shards
    for _ in range(len(totals)):
        full = max(range(shards), key=lambda k: (load[k], -k))
        empty = min(range(shards), key=lambda k: (load[k], k))
        if load[full] <= mean * (1 + tolerance):
            break
        room = (load[full] - load[empty]) / 2
        fits = [s for s, shard in out.items() if shard == full and 0 < totals[s][0] <= room]
        if not fits:
            break
        slot = max(fits, key=lambda s: (totals[s][0], -s))
        out[slot] = empty
        load[full] -= totals[slot][0]
        load[empty] += totals[slot][0]
    return out


def write_map(spark: SparkSession, path: str, version: int, placed: dict[int, int],
              totals: dict[int, tuple[int, int]]) -> DataFrame:
    """Write one version of the map (one row a slot) and read it back."""
    rows = [(version, s, placed[s], *totals[s]) for s in sorted(totals)]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.parquet(f"{path}/version={version}")
    return read_map(spark, path, version)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the map, the newest by default."""
    rows = spark.read.option("recursiveFileLookup", "true").schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = rows.agg(F.max("version")).first()[0]
    return rows.where(F.col("version") == version)


def assign_shards(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Records of `virtual_slots` with their shard and their place `slot` in it.

    The map is broadcast: it has as many rows as there are virtual slots.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slot_map.select("virtual_slot", "shard", "version",
                              F.coalesce(F.sum("records").over(before), F.lit(0)).alias("before"))
    place = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")
    return (records.withColumn("place", F.row_number().over(place) - 1)
            .join(F.broadcast(offsets), "virtual_slot")
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("before") + F.col("place")).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
                    F.col("version").alias("map_version")))


def shard_documents(docs: DataFrame, shards: int, map_path: str, slots: int = SLOTS) -> DataFrame:
    """Place every document: slots, byte totals, a stored first map, then shard and place."""
    records = virtual_slots(docs, slots)
    totals = slot_totals(records, slots)
    return assign_shards(records, write_map(docs.sparkSession, map_path, 1, place_slots(totals, shards), totals))


def reshard_documents(docs: DataFrame, shards: int, map_path: str, slots: int = SLOTS) -> DataFrame:
    """Place documents again after the data or the number of shards has changed, editing the newest map."""
    spark = docs.sparkSession
    records = virtual_slots(docs, slots)
    totals = slot_totals(records, slots)
    rows = read_map(spark, map_path).collect()          # one row a slot
    placed = rebalance_slots({r["virtual_slot"]: r["shard"] for r in rows}, totals, shards)
    return assign_shards(records, write_map(spark, map_path, rows[0]["version"] + 1, placed, totals))
