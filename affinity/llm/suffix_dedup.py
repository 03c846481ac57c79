"""Operator 4: removal of repeated strings by a difference-cover blockwise suffix order.

Every byte covered by a `LENGTH`-byte string that also starts somewhere else is
removed. What has to be known about a suffix is only whether its first
`LENGTH` bytes equal those of another, so the order that brings equal suffixes
together is that of 64-bit fingerprints (the README says what this leaves of a
lexicographic order). It is built in two rounds, each one bucket of suffixes
at a time.

1. Cover sample. Positions whose residue modulo `V` lies in a perfect
   difference set are sampled. Two equal strings of `LENGTH` bytes, wherever
   they start, have a sampled offset in common within their first `V` bytes,
   and the `LENGTH - V + 1` bytes from there are equal. These sample strings
   are named by fingerprints, dealt to buckets by name, and each bucket is
   sorted alone to find the names that occur twice.
2. Suffixes. Only a position with a repeated sample name at a cover offset
   after it can start a repeated string. The fingerprints of these positions'
   whole strings are dealt and sorted in the same way.

A message holds the names that about `FLUSH` positions of a task have for one
bucket; the bucket answers with one bit a name, and a message's answers are put
together again by document (or `CHUNK` of a long one), so positions are never
sent. Names seen twice in one message's positions are settled there and sent on
once, so a passage shared by a third of all documents reaches its bucket once a
message. The number of
buckets grows with the input and bounds a bucket; a chunk bounds the arrays of
a long document. Texts that occur twice as a whole are settled by a count and
stand in the second round once.

Defined results: null counts as empty text; a text shorter than `LENGTH`
loses nothing; repeated rows are documents of their own, so each repeats the
other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.llm.common import text_or_empty
from affinity.session import materialize

LENGTH = 400
ORDER = 13                          # a prime: V = ORDER**2 + ORDER + 1 residues, ORDER + 1 of them sampled
V = ORDER * ORDER + ORDER + 1
CHUNK = 1 << 18                     # bytes of a document worked on at once
FLUSH = 1 << 20                     # names compared in a task before they are sent
BUCKET_NAMES = 4 << 20
LEAST_BUCKETS = 16


@functools.cache
def difference_cover(order: int = ORDER) -> np.ndarray:
    """A perfect difference set modulo order**2 + order + 1, from powers of a primitive cubic element.

    The exponents whose power has no square term form a line of the
    projective plane; its differences give every residue once.
    """
    for c in range(order ** 3):
        a0, a1, a2 = c % order, c // order % order, c // order ** 2
        power, line, seen = (1, 0, 0), [], 0
        for exponent in range(order ** 3 - 1):
            if exponent < order * order + order + 1 and power[2] == 0:
                line.append(exponent)
            x0, x1, x2 = power                       # times x, where x**3 = a2 x**2 + a1 x + a0
            power = (a0 * x2 % order, (x0 + a1 * x2) % order, (x1 + a2 * x2) % order)
            seen += 1
            if power in ((1, 0, 0), (0, 0, 0)):
                break
        if power == (1, 0, 0) and seen == order ** 3 - 1 and len(line) == order + 1:
            return np.array(line)
    raise ValueError(order)


_random = np.random.default_rng(4)
_VALUE = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = int(_random.integers(1 << 62, 1 << 63)) * 2 + 1


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse modulo 2**64."""
    with np.errstate(over="ignore"):
        out = []
        for step in (_STEP, pow(_STEP, -1, 1 << 64)):
            p = np.full(CHUNK + LENGTH + 1, step % (1 << 64), np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        return out[0], out[1]


def fingerprints(data: bytes, length: int, positions: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of the `length` bytes from each position of at most CHUNK + LENGTH bytes."""
    up, down = _powers()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[np.frombuffer(data, np.uint8)] * up[:len(data)], out=sums[1:])
    x = (sums[positions + length] - sums[positions]) * down[positions]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sampled(size: int, at: int) -> np.ndarray:
    """Sampled positions of the chunk at `at`, relative to it."""
    stop = min(at + CHUNK, size - (LENGTH - V + 1) + 1)
    if stop <= at:
        return np.empty(0, np.int64)
    first = at // V * V
    grid = (np.arange(first, stop, V)[:, None] + difference_cover()[None]).ravel()
    return grid[(grid >= at) & (grid < stop)] - at


def sample_names(data: bytes, at: int, _: object = None) -> np.ndarray:
    return fingerprints(data[at:at + CHUNK + LENGTH], LENGTH - V + 1, _sampled(len(data), at))


def _in_ranges(size: int, at: int, ranges: np.ndarray) -> np.ndarray:
    """Positions of the chunk at `at` inside the ranges [lo, hi), relative to it."""
    stop = min(at + CHUNK, size - LENGTH + 1)
    edge = np.zeros(max(stop - at, 0) + 1, np.int32)
    for lo, hi in ranges:
        lo, hi = max(lo, at), min(hi, stop)
        if lo < hi:
            edge[lo - at] += 1
            edge[hi - at] -= 1
    return np.flatnonzero(np.cumsum(edge)[:-1])


def string_names(data: bytes, at: int, ranges: np.ndarray) -> np.ndarray:
    return fingerprints(data[at:at + CHUNK + LENGTH], LENGTH, _in_ranges(len(data), at, ranges))


def _ranges(flat: list[int] | None) -> np.ndarray:
    return np.asarray(flat or [], np.int64).reshape(-1, 2)


MESSAGE = pa.schema([("bucket", pa.int32()), ("flush", pa.int64()), ("keys", pa.binary()), ("chunks", pa.binary()),
                     ("counts", pa.binary()), ("asked", pa.binary()), ("known_bits", pa.binary()),
                     ("asked_bits", pa.binary())])
ANSWER = pa.schema([("flush", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary()), ("chunks", pa.binary()),
                    ("counts", pa.binary()), ("bits", pa.binary())])
FLAGGED = pa.schema([("key", pa.binary()), ("chunk", pa.int32()), ("buckets", pa.list_(pa.int32())),
                     ("bits", pa.list_(pa.binary()))])
KEY_BYTES = 16


def _bucket_of(names: np.ndarray, buckets: int) -> np.ndarray:
    return ((names >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)


def repeated_bits(rows: DataFrame, name: Callable[[bytes, int, np.ndarray], np.ndarray], buckets: int,
                  kind: type) -> DataFrame:
    """(key, chunk, buckets, bits): which names of `rows` (key, text, ranges) occur twice anywhere.

    For each bucket with a repeated name of the key's chunk, a bit for each of
    the chunk's names in the bucket, in the order of positions. Chunks without
    repeated names are left out.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[bytes] = []
        chunks: list[int] = []
        held: list[np.ndarray] = []
        size = 0
        number = TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            nonlocal keys, chunks, held, size, number
            names = np.concatenate(held)
            owner = np.repeat(np.arange(len(held)), [len(h) for h in held])
            _, first, inverse, counts = np.unique(names, return_index=True, return_inverse=True, return_counts=True)
            known = counts[inverse] > 1
            asked = ~known
            asked[first] = True
            bucket = _bucket_of(names, buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out = {c: [] for c in MESSAGE.names}
            for b in np.flatnonzero(np.diff(cuts)):
                own = order[cuts[b]:cuts[b + 1]]
                there, counts = np.unique(owner[own], return_counts=True)
                out["bucket"].append(b)
                out["flush"].append(number)
                out["keys"].append(b"".join([keys[o] for o in there]))
                out["chunks"].append(np.array([chunks[o] for o in there], np.int32).tobytes())
                out["counts"].append(counts.astype(np.int32).tobytes())
                out["asked"].append(names[own[asked[own]]].astype(kind).tobytes())
                out["known_bits"].append(np.packbits(known[own]).tobytes())
                out["asked_bits"].append(np.packbits(asked[own]).tobytes())
            keys, chunks, held, size, number = [], [], [], 0, number + 1
            return pa.RecordBatch.from_pydict(out, MESSAGE)

        for batch in batches:
            for key, text, flat in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data, ranges = text.encode(), _ranges(flat)
                for chunk, at in enumerate(range(0, len(data), CHUNK)):
                    names = name(data, at, ranges)
                    if len(names):
                        keys.append(key)
                        chunks.append(chunk)
                        held.append(names)
                        size += len(names)
                    if size >= FLUSH:
                        yield flush()
        if size:
            yield flush()

    def answer(table: pa.Table) -> pa.Table:
        asked = [np.frombuffer(b, kind) for b in table["asked"].to_pylist()]
        _, inverse, counts = np.unique(np.concatenate(asked), return_inverse=True, return_counts=True)
        twice = counts[inverse] > 1
        out = {c: [] for c in ANSWER.names}
        start = 0
        columns = (table[c].to_pylist() for c in MESSAGE.names if c != "asked")
        for own, (bucket, flush, keys, chunks, counts, known, sent) in zip(asked, zip(*columns)):
            counts = np.frombuffer(counts, np.int32)
            n = counts.sum()
            flags = np.unpackbits(np.frombuffer(known, np.uint8), count=n).astype(bool)
            flags[np.unpackbits(np.frombuffer(sent, np.uint8), count=n).astype(bool)] |= twice[start:start + len(own)]
            start += len(own)
            some = np.logical_or.reduceat(flags, np.cumsum(counts) - counts)
            if some.any():
                out["flush"].append(flush)
                out["bucket"].append(bucket)
                out["keys"].append(np.frombuffer(keys, f"V{KEY_BYTES}")[some].tobytes())
                out["chunks"].append(np.frombuffer(chunks, np.int32)[some].tobytes())
                out["counts"].append(counts[some].tobytes())
                out["bits"].append(np.packbits(flags[np.repeat(some, counts)]).tobytes())
        return pa.Table.from_pydict(out, ANSWER)

    def gather(table: pa.Table) -> pa.Table:
        found: dict[tuple[bytes, int], tuple[list[int], list[bytes]]] = {}
        for _, bucket, keys, chunks, counts, bits in zip(*(table[c].to_pylist() for c in ANSWER.names)):
            counts = np.frombuffer(counts, np.int32)
            flags, at = np.unpackbits(np.frombuffer(bits, np.uint8)), 0
            for k, (chunk, n) in enumerate(zip(np.frombuffer(chunks, np.int32).tolist(), counts.tolist())):
                own = found.setdefault((keys[k * KEY_BYTES:(k + 1) * KEY_BYTES], chunk), ([], []))
                own[0].append(bucket)
                own[1].append(np.packbits(flags[at:at + n]).tobytes())
                at += n
        return pa.Table.from_pydict({"key": [k for k, _ in found], "chunk": [c for _, c in found],
                                     "buckets": [b for b, _ in found.values()], "bits": [b for _, b in found.values()]},
                                    FLAGGED)

    messages = rows.select("key", "text", "ranges").mapInArrow(
        send, "bucket int, flush long, keys binary, chunks binary, counts binary, asked binary, known_bits binary, "
              "asked_bits binary")
    answers = messages.groupBy("bucket").applyInArrow(
        answer, "flush long, bucket int, keys binary, chunks binary, counts binary, bits binary")
    return answers.groupBy("flush").applyInArrow(gather, "key binary, chunk int, buckets array<int>, bits array<binary>")


def _flags(data: bytes, ranges: np.ndarray, name, answers: list[dict], buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(chunk's start, a flag for each of its names) of a document, from its answers."""
    for a in sorted(answers, key=lambda a: a["chunk"]):
        at = a["chunk"] * CHUNK
        bucket = _bucket_of(name(data, at, ranges), buckets)
        flags = np.zeros(len(bucket), bool)
        for b, bits in zip(a["buckets"], a["bits"]):
            own = np.flatnonzero(bucket == b)
            flags[own] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)).astype(bool)
        yield at, flags


def _joined(places: np.ndarray, before: int, after: int) -> list[int]:
    """Runs [lo, hi) covered by [place - before, place + after) of sorted places, flat."""
    if not len(places):
        return []
    lo, hi = np.maximum(places - before, 0), places + after
    new = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
    ends = np.concatenate([hi[new[1:] - 1], hi[-1:]])
    return np.stack([lo[new], ends], 1).ravel().tolist()


def _answered(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """Rows (key, text, ranges) with their answers; a key's answers are as many as its chunks and buckets at most."""
    answers = bits.groupBy("key").agg(F.collect_list(F.struct("chunk", "buckets", "bits")).alias("answers"))
    return rows.join(answers, "key").select("key", "text", "ranges", "answers")


def repeated_strings(docs: DataFrame) -> DataFrame:
    """(key, n_removed, n_spans, kept_sha256, kept) of the distinct texts that lose bytes; key is the text's MD5."""
    rows = docs.select(F.unhex(F.md5("text")).alias("key"), "text", F.lit(None).cast("array<int>").alias("ranges")) \
               .where(F.octet_length("text") >= LENGTH)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-total * (ORDER + 1) // V // BUCKET_NAMES))
    bits = materialize(repeated_bits(rows, sample_names, buckets, np.uint32), "sample-answers")

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, ranges, sizes = [], [], [], []
            for key, text, answers in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                data, places = text.encode(), []
                for at, flags in _flags(data, _ranges(None), sample_names, answers, buckets):
                    places.append(at + _sampled(len(data), at)[flags])
                found = _joined(np.concatenate(places), V - 1, 1)
                size = sum(max(min(hi, len(data) - LENGTH + 1) - lo, 0) for lo, hi in _ranges(found).tolist())
                if size:
                    keys.append(key)
                    texts.append(text)
                    ranges.append(found)
                    sizes.append(size)
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(texts, pa.string()),
                                   pa.array(ranges, pa.list_(pa.int32())), pa.array(sizes, pa.int64())],
                                  ["key", "text", "ranges", "size"])

    # a copy's answers are those of its text: one set of them, one text
    once = bits.dropDuplicates(["key", "chunk"])
    some = materialize(_answered(rows.dropDuplicates(["key"]), once).mapInArrow(
        narrow, "key binary, text string, ranges array<int>, size long"), "repeat-candidates")
    positions = some.agg(F.sum("size")).first()[0] or 0
    buckets_2 = max(LEAST_BUCKETS, -(-positions // BUCKET_NAMES))
    bits = materialize(repeated_bits(some, string_names, buckets_2, np.uint64), "string-answers")
    copies = docs.groupBy(F.unhex(F.md5("text")).alias("key")).agg(
        (F.count("*") > 1).alias("copied"), F.max(F.octet_length("text")).alias("size")) \
        .where(F.col("copied") & (F.col("size") >= LENGTH)).select("key", "size")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, removed, spans, digests, kept = [], [], [], [], []
            for key, text, flat, answers in zip(*(batch.column(i).to_pylist() for i in range(4))):
                data, ranges, places = text.encode(), _ranges(flat), []
                for at, flags in _flags(data, ranges, string_names, answers, buckets_2):
                    places.append(at + _in_ranges(len(data), at, ranges)[flags])
                runs = _ranges(_joined(np.concatenate(places), 0, LENGTH)).tolist()
                parts, last = [], 0
                for lo, hi in runs:
                    parts.append(data[last:lo])
                    last = hi
                parts.append(data[last:])
                keys.append(key)
                removed.append(sum(hi - lo for lo, hi in runs))
                spans.append(len(runs))
                kept.append(b"".join(parts))
                digests.append(hashlib.sha256(kept[-1]).hexdigest())
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                                   pa.array(digests, pa.string()), pa.array(kept, pa.binary())],
                                  ["key", "n_removed", "n_spans", "kept_sha256", "kept"])

    cut = _answered(some, bits).mapInArrow(
        remove, "key binary, n_removed long, n_spans long, kept_sha256 string, kept binary")
    whole = copies.select("key", F.col("size").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
                          F.sha2(F.lit(""), 256).alias("kept_sha256"), F.lit(b"").alias("kept"))
    return cut.join(copies.select("key"), "key", "left_anti").unionByName(whole)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    cut = repeated_strings(rows).drop("kept")
    whole = rows.select("doc_id", F.unhex(F.md5("text")).alias("key"),
                        F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("own_sha256"))
    return whole.join(cut, "key", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("kept_sha256", "own_sha256").alias("kept_sha256"))
