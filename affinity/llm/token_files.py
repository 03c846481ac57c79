"""Operator 8: token ids in binary files with a shared compression dictionary.

File format. A written table holds segments: runs of consecutive documents in
ascending id order. A segment is one row with its documents' ids, their token
counts, the byte offset of each document's frame and one binary of frames.
Every document is compressed on its own as one zstandard frame, with a
dictionary trained on serialized id arrays and shared by all frames, so one
short document can be read without the others (`read_document`). The
dictionary lies beside the segments and each segment names its hash. Ids are
serialized as little-endian unsigned 16-bit integers, or 32-bit where the
vocabulary is larger.

Order. Segments belong to ranges of the document id whose borders are
quantiles of that column. A range is sorted in one task, which streams, so
memory is bounded by a segment; the first token position of a document is the
total of the ranges before it (one row a range) plus its place in its range.

The dictionary is trained on at most `DICTIONARY_DOCS` texts of at most
`DICTIONARY_TEXT_BYTES` bytes, chosen by hash; it changes sizes, never ids.

Defined results: null text counts as empty text, which has the end id only;
a null id sorts first; repeated rows are documents of their own; an empty
table gives no segments; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinity.llm.common import kept, shuffle_partitions, text_or_empty
from affinity.llm.pieces import Splitter, is_common

DICTIONARY_DOCS = 1_000
DICTIONARY_TEXT_BYTES = 16_384
DICTIONARY_BYTES = 65_536
SEGMENT_BYTES = 1 << 20
RANGE_BYTES = 32 << 20        # bytes of text of a range, on average
LEVEL = 3
MAX_PIECES = 500_000
GROUP_CHARS = 1_000_000       # characters split into pieces at a time, except that a text is never cut


def _byte_characters() -> dict[int, str]:
    """The character of each byte: its own where it is printed in Latin-1, else the next from U+0100 on."""
    printed = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = count(0x100)
    return {b: chr(b if b in printed else next(others)) for b in range(256)}


_BYTE_CHARACTERS = _byte_characters()


def byte_level(piece: str) -> str:
    """A piece as the ByteLevel step hands it to the model: one character a byte of its UTF-8."""
    return piece if piece.isascii() and piece.isprintable() and " " not in piece else \
        piece.encode().decode("latin-1").translate(_BYTE_CHARACTERS)


class PieceTokenizer:
    """A `tokenizers` file, with the ids of pieces seen before kept (a table of bounded size).

    A tokenizer that normalises to NFC, collapses white space, lower-cases and
    then splits by one pattern gives each piece the same ids everywhere. Such
    a tokenizer's common texts are split here and only new pieces go to the
    library's model, spelled as its ByteLevel step spells them (normalising and
    splitting a piece again would give the piece); every other text or
    tokenizer goes through the library whole.
    """

    STEPS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        import json

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = {2: "H", 4: "I"}[self.width]
        self.known: dict[str, bytes] = {}
        self.split = None
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        if ((spec.get("normalizer") or {}).get("normalizers") == self.STEPS and len(pre) == 2
                and pre[0].get("type") == "Split" and pre[0].get("invert") and pre[0].get("behavior") == "Removed"
                and pre[1].get("type") == "ByteLevel" and not pre[1].get("add_prefix_space")
                and not pre[1].get("use_regex") and spec.get("post_processor") is None):
            self.split = Splitter(pre[0]["pattern"]["Regex"])
            self.merge = self.tokenizer.model.tokenize
            added = [re.escape(t["content"]) for t in spec.get("added_tokens", [])]
            self.added = re.compile("|".join(added) or r"(?!)")

    def pack(self, ids: list[int]) -> bytes:
        return np.asarray(ids, f"<u{self.width}").tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Serialized ids of each text, texts of GROUP_CHARS characters at a time."""
        out, group, held = [], [], 0
        for t in texts:
            if group and held + len(t) > GROUP_CHARS:
                out += self._encode_group(group)
                group, held = [], 0
            group.append(t)
            held += len(t)
        return out + self._encode_group(group)

    def _encode_group(self, texts: list[str]) -> list[bytes]:
        """New pieces of all the texts go through the library together."""
        split = [self.split(t.lower()) if self.split and is_common(t) and not self.added.search(t) else None for t in texts]
        if len(self.known) > MAX_PIECES:
            self.known.clear()
        known = self.known
        new = list(set().union(*filter(None, split)).difference(known))
        for p in new:
            known[p] = array(self.code, [t.id for t in self.merge(byte_level(p))]).tobytes()
        return [self.pack(self.tokenizer.encode(t, add_special_tokens=False).ids) if pieces is None
                else b"".join(map(known.__getitem__, pieces)) for t, pieces in zip(texts, split)]

    def encode(self, text: str) -> bytes:
        """Serialized ids of a text."""
        return self.encode_all([text])[0]


def piece_tokenizer(path: str) -> PieceTokenizer:
    """One tokenizer a Python worker, kept between the tasks of a stage."""
    return kept(("tokenizer", path), lambda: PieceTokenizer(path))


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int, max_docs: int = DICTIONARY_DOCS,
                     max_text_bytes: int = DICTIONARY_TEXT_BYTES) -> bytes:
    """A zstandard dictionary from the id arrays of a bounded sample; empty where there is too little to train on."""
    texts = docs.select(text_or_empty().alias("text")).where(F.octet_length("text") <= max_text_bytes) \
                .withColumn("hash", F.xxhash64("text"))
    # the smallest hashes first, so that only the chosen texts travel
    last = texts.select("hash").orderBy("hash").limit(max_docs).agg(F.max("hash")).first()[0]
    sample = texts.where(F.col("hash") <= F.lit(last)).dropDuplicates(["hash"]).orderBy("hash").collect()
    tok = piece_tokenizer(tokenizer_path)
    arrays = [tok.encode(r.text) + tok.pack([end_id]) for r in sample]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, arrays).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_hash(dictionary: bytes) -> str:
    return hashlib.sha256(dictionary).hexdigest()


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def range_borders(docs: DataFrame, ranges: int) -> list[float]:
    """Borders that cut the document ids into about equal ranges."""
    probabilities = [i / ranges for i in range(1, ranges)]
    if not probabilities:
        return []
    return sorted(set(docs.select(F.col("doc_id").cast("double")).approxQuantile("doc_id", probabilities, 0.5 / ranges)))


def encode_frames(docs: DataFrame, tokenizer_path: str, end_id: int, dictionary: bytes,
                  borders: list[float]) -> DataFrame:
    """(range, doc_id, n_tokens, frame): every document's ids, serialized and compressed on their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = piece_tokenizer(tokenizer_path)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))
        end = tok.pack([end_id])
        for batch in batches:
            ids = batch.column(0).to_pylist()
            arrays = [a + end for a in tok.encode_all(batch.column(1).to_pylist())]
            where = [-1 if i is None else int(np.searchsorted(borders, float(i))) for i in ids]
            yield pa.record_batch([pa.array(where, pa.int32()), batch.column(0),
                                   pa.array([len(a) // tok.width for a in arrays], pa.int64()),
                                   pa.array([pack.compress(a) for a in arrays], pa.binary())],
                                  ["range", "doc_id", "n_tokens", "frame"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "range int, doc_id long, n_tokens long, frame binary")


SEGMENT = T.StructType([
    T.StructField("range", T.IntegerType()), T.StructField("segment", T.LongType()),
    T.StructField("start", T.LongType()), T.StructField("n_ids", T.LongType()),
    T.StructField("first_id", T.LongType()), T.StructField("last_id", T.LongType()),
    T.StructField("dictionary", T.StringType()), T.StructField("width", T.IntegerType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("n_tokens", T.ArrayType(T.LongType())),
    T.StructField("offsets", T.ArrayType(T.LongType())), T.StructField("frames", T.BinaryType())])


def _segments(width: int, digest: str):
    """Sorted frames to segment rows; `start` counts the ids before the segment in its range."""
    schema = pa.schema([("range", pa.int32()), ("segment", pa.int64()), ("start", pa.int64()), ("n_ids", pa.int64()),
                        ("first_id", pa.int64()), ("last_id", pa.int64()), ("dictionary", pa.string()),
                        ("width", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())),
                        ("offsets", pa.list_(pa.int64())), ("frames", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = number = start = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, number, start
            counts = [r[2] for r in held]
            frames = [r[3] for r in held]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).tolist()
            row = {"range": held[0][0], "segment": number, "start": start, "n_ids": sum(counts),
                   "first_id": held[0][1], "last_id": held[-1][1], "dictionary": digest, "width": width,
                   "doc_ids": [r[1] for r in held], "n_tokens": counts, "offsets": offsets, "frames": b"".join(frames)}
            start += row["n_ids"]
            number += 1
            held, size = [], 0
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and (row[0] != held[0][0] or size >= SEGMENT_BYTES):
                    other = row[0] != held[0][0]
                    yield flush()
                    if other:
                        number = start = 0
                held.append(row)
                size += len(row[3])
        if held:
            yield flush()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int,
                      ranges: int | None = None) -> None:
    """Encode every document, append `end_id`, and write dictionary and segments under `path`."""
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer_path, end_id)
    digest = dictionary_hash(dictionary)
    spark.createDataFrame([(digest, bytearray(dictionary))], "dictionary string, data binary").coalesce(1) \
         .write.parquet(f"{path}/dictionary")
    if ranges is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        ranges = max(shuffle_partitions(spark), -(-size // RANGE_BYTES))
    frames = encode_frames(docs, tokenizer_path, end_id, dictionary, range_borders(docs, ranges))
    (frames.repartition(ranges, "range")
     .sortWithinPartitions("range", "doc_id", "n_tokens", "frame")
     .mapInArrow(_segments(piece_tokenizer(tokenizer_path).width, digest), SEGMENT)
     .write.parquet(f"{path}/segments"))


def _dictionaries(spark: SparkSession, path: str) -> dict[str, bytes]:
    """One row a written file set: bounded by DICTIONARY_BYTES."""
    return {r.dictionary: bytes(r.data) for r in spark.read.parquet(f"{path}/dictionary").collect()}


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids array<int>, from the files."""
    return _read(spark, path, "ids array<int>", lambda ids: ids.astype(np.int32).tolist(), pa.list_(pa.int32()))


def token_file_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), from the files."""
    return _read(spark, path, "ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64())


def _read(spark: SparkSession, path: str, column: str, of, kind: pa.DataType) -> DataFrame:
    segments = spark.read.schema(SEGMENT).parquet(f"{path}/segments")
    dictionaries = _dictionaries(spark, path)
    totals = segments.groupBy("range").agg(F.sum("n_ids").alias("total"))
    # one row a range, as many as write_token_files made ranges
    bases: dict[int, int] = {}
    running = 0
    for r in totals.orderBy("range").collect():
        bases[r["range"]] = running
        running += r["total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = {h: zstandard.ZstdDecompressor(dict_data=_dictionary(d)) for h, d in dictionaries.items()}
        for batch in batches:
            for row in batch.to_pylist():
                reader, blob, start = readers[row["dictionary"]], row["frames"], bases[row["range"]] + row["start"]
                starts, made = [], []
                for k, n in enumerate(row["n_tokens"]):
                    frame = blob[row["offsets"][k]:row["offsets"][k + 1]]
                    made.append(of(np.frombuffer(reader.decompress(frame), f"<u{row['width']}")))
                    starts.append(start)
                    start += n
                yield pa.record_batch([pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()),
                                       pa.array(row["n_tokens"], pa.int64()), pa.array(made, kind)],
                                      ["doc_id", "start", "n_tokens", column.split()[0]])

    used = segments.select("range", "start", "dictionary", "width", "doc_ids", "n_tokens", "offsets", "frames")
    return used.mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[int]:
    """The ids of one document: only its segment's row is read and only its frame decompressed."""
    row = (spark.read.schema(SEGMENT).parquet(f"{path}/segments")
           .where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id) & F.array_contains("doc_ids", doc_id))
           .first())
    if row is None:
        raise KeyError(doc_id)
    k = row["doc_ids"].index(doc_id)
    frame = bytes(row["frames"])[row["offsets"][k]:row["offsets"][k + 1]]
    data = _dictionary(_dictionaries(spark, path)[row["dictionary"]])
    return np.frombuffer(zstandard.ZstdDecompressor(dict_data=data).decompress(frame), f"<u{row['width']}").tolist()
