"""Operator 3: benchmark decontamination with a distributed positional inverted index.

The windows of the test items (10 consecutive words; a shorter item is one
window) are found in the training documents in four steps. Document
frequencies of the windows' words are counted over all documents. A window
with a word that no document has cannot occur; of any other, the `ANCHORS`
rarest words are kept with their offsets. The index stores, for every document
and anchor word, its positions, as a table sorted by word in each file. The
lists of a window's anchors, each moved back by the anchor's offset, are
intersected by (document, window, start). What is left is compared with the
document's words, so matches are exact. `proximity_matches` instead accepts
anchors whose moved positions differ by a few words.

Windows are worked on in slices of at most `MAX_WINDOWS`, which bounds what is
broadcast whatever the number of items; documents are never collected, and a
document's positions stay with the document.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters.

Defined results: null and empty texts have no words and are not contaminated;
an item without words, or without an id, takes no part; rows sharing an item
id are one item; repeated documents get the same result each, and rows that
share an id but not a text are judged separately; an empty table of items
leaves every document clean; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.llm.common import fresh, release, text_or_empty
from affinity.operators.joins import checked_broadcast
from affinity.session import materialize

WINDOW = 10
ANCHORS = 2
MAX_WINDOWS = 500_000
MAX_SENT_BYTES = 32 << 20     # found documents up to this size are broadcast; more are joined by a shuffle

_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256))


def words(text: str) -> list[bytes]:
    """The lower-cased words of a text."""
    return text.encode().translate(_WORD_BYTES).split()


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, phrase): the distinct windows of every item, words joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str]] = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words(text)
                for i in range(max(len(w) - window, 0) + 1 if w else 0):
                    out.append((item, b" ".join(w[i:i + window]).decode()))
            yield pa.record_batch([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string())],
                                  ["item", "phrase"])

    rows = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"),
                                                            text_or_empty().alias("text"))
    return rows.mapInArrow(run, "item string, phrase string").distinct()


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, text: a row of documents is known by its id and text."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), text_or_empty().alias("text"))


def document_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many documents each word of a bounded vocabulary occurs; counted over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        found: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(vocabulary.intersection(words(text)))
        yield pa.record_batch([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())],
                              ["word", "n"])

    rows = docs.select(text_or_empty().alias("text")).mapInArrow(run, "word binary, n long")
    return {bytes(r.word): r.n for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def anchors_of(phrases: list[str], frequencies: dict[bytes, int], anchors: int = ANCHORS) -> list[tuple]:
    """(word, anchor number, offset, anchors of the window, its number, its words), rarest words first."""
    out = []
    for number, phrase in enumerate(phrases):
        w = phrase.encode().split(b" ")
        if all(x in frequencies for x in w):
            rarest = sorted(set(w), key=lambda x: (frequencies[x], x))[:anchors]
            out += [(bytearray(x), k, w.index(x), len(rarest), number, len(w)) for k, x in enumerate(rarest)]
    return out


ANCHOR_SCHEMA = "word binary, anchor int, offset int, anchors int, phrase int, n_phrase int"


def positional_index(docs: DataFrame, vocabulary: set[bytes]) -> DataFrame:
    """Postings (doc_id, text_key, n_words, word, positions) of the vocabulary, written to the checkpoint folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            lengths: list[int] = []
            found: list[bytes] = []
            places: list[list[int]] = []
            for row, text in enumerate(batch.column(2).to_pylist()):
                w = words(text)
                own: dict[bytes, list[int]] = {}
                for at, x in enumerate(w):
                    if x in vocabulary:
                        own.setdefault(x, []).append(at)
                found += own
                places += own.values()
                rows += [row] * len(own)
                lengths += [len(w)] * len(own)
            take = pa.array(rows, pa.int32())
            yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), pa.array(lengths, pa.int32()),
                                   pa.array(found, pa.binary()), pa.array(places, pa.list_(pa.int32()))],
                                  ["doc_id", "text_key", "n_words", "word", "positions"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = _keyed(docs).mapInArrow(
        run, f"doc_id {kind}, text_key long, n_words int, word binary, positions array<int>")
    return materialize(rows.sortWithinPartitions("word"), "positional-index")


def _slices(phrases: DataFrame, max_windows: int) -> Iterator[list[str]]:
    """The distinct phrases in bounded lists."""
    distinct = phrases.select("phrase").distinct()
    n = -(-distinct.count() // max_windows)
    for k in range(n):
        part = distinct if n == 1 else distinct.where(F.pmod(F.xxhash64("phrase"), F.lit(n)) == k)
        yield [r.phrase for r in part.collect()]


def _moved(docs: DataFrame, phrases: list[str], anchors: int) -> DataFrame:
    """(doc_id, text_key, n_words, phrase, n_phrase, anchor, anchors, start): postings moved back by their offsets.

    `phrase` is the number of a phrase in the list.
    """
    vocabulary = {w for p in phrases for w in p.encode().split(b" ")}
    chosen = anchors_of(phrases, document_frequencies(docs, vocabulary), anchors)
    index = positional_index(docs, {bytes(a[0]) for a in chosen})
    wanted = docs.sparkSession.createDataFrame(chosen, ANCHOR_SCHEMA)
    return (index.join(F.broadcast(wanted), "word")     # at most MAX_WINDOWS * ANCHORS rows
            .select("doc_id", "text_key", "n_words", "phrase", "n_phrase", "anchor", "anchors",
                    F.explode("positions").alias("at"), "offset")
            .withColumn("start", F.col("at") - F.col("offset")).drop("at", "offset"))


def _candidates(docs: DataFrame, phrases: list[str], anchors: int) -> DataFrame:
    """Documents with the places where all anchors of a phrase stand at their offsets."""
    moved = _moved(docs, phrases, anchors).where(
        (F.col("start") >= 0) & (F.col("start") + F.col("n_phrase") <= F.col("n_words")))
    met = moved.groupBy("doc_id", "text_key", "phrase", "start").agg(
        F.bit_or(F.expr("shiftleft(1, anchor)")).alias("met"), F.first("anchors").alias("anchors"))
    return (met.where("met = shiftleft(1, anchors) - 1")
            .groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("phrase", "start")).alias("places")))


def phrase_places(docs: DataFrame, phrases: list[str], anchors: int = ANCHORS) -> DataFrame:
    """(doc_id, text_key, phrase, start, n): exact occurrences of a bounded list of phrases."""
    # the filter holds for every row. Beyond the size that is broadcast Spark makes a bounded Bloom filter of the
    # filtered side's keys for the scan of the texts, so that about the documents with candidates alone are shuffled
    found = checked_broadcast(materialize(_candidates(docs, phrases, anchors), "phrase-candidates").where(F.size("places") > 0),
                              max_bytes=MAX_SENT_BYTES)
    joined = _keyed(docs).alias("d").join(found.alias("c"), F.col("d.doc_id").eqNullSafe(F.col("c.doc_id"))
                                  & (F.col("d.text_key") == F.col("c.text_key"))) \
                 .select("d.doc_id", "d.text_key", "d.text", "c.places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = [p.encode().split(b" ") for p in phrases]
        for batch in batches:
            rows, starts, lengths, found = [], [], [], []
            for row, (text, places) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                w = words(text)
                for place in places:
                    phrase = wanted[place["phrase"]]
                    start = place["start"]
                    if w[start:start + len(phrase)] == phrase:
                        rows.append(row)
                        starts.append(start)
                        lengths.append(len(phrase))
                        found.append(phrases[place["phrase"]])
            take = pa.array(rows, pa.int32())
            yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), pa.array(found, pa.string()),
                                   pa.array(starts, pa.int32()), pa.array(lengths, pa.int32())],
                                  ["doc_id", "text_key", "phrase", "start", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, text_key long, phrase string, start int, n int")


def phrase_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, anchors: int = ANCHORS,
                   max_windows: int = MAX_WINDOWS) -> DataFrame:
    """(doc_id, text_key, item, phrase, start, n): every occurrence of every window of every item.

    `start` counts words from 0 and `n` is the window's length.
    """
    phrases = materialize(item_windows(items, window), "item-windows")
    found = None
    for part in _slices(phrases, max_windows):
        places = phrase_places(docs, part, anchors)
        found = places if found is None else found.union(places)
    if found is None:
        kind = docs.schema["doc_id"].dataType.simpleString()
        found = docs.sparkSession.createDataFrame(
            [], f"doc_id {kind}, text_key long, phrase string, start int, n int")
    return materialize(found, "phrase-places").distinct().join(phrases, "phrase")


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = 5, window: int = WINDOW,
                      max_windows: int = MAX_WINDOWS) -> DataFrame:
    """(doc_id, item, phrase, start, gap): the two rarest words of a window, out of place by at most `slop` words.

    `gap` is how far the two are from their distance in the window (0: exact).
    """
    phrases = materialize(item_windows(items, window), "item-windows")
    found = None
    for part in _slices(phrases, max_windows):
        moved = _moved(docs, part, 2).withColumn("bin", F.floor(F.col("start") / (slop + 1)))
        a = moved.where(F.col("anchor") == 0).select("doc_id", "text_key", "phrase", "anchors", "start", "bin")
        b = moved.where(F.col("anchor") == 1).select(
            "text_key", F.col("doc_id").alias("other_doc"), "phrase", F.col("start").alias("other"),
            F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
        near = a.join(b, (a["text_key"] == b["text_key"]) & (a["phrase"] == b["phrase"]) & (a["bin"] == b["bin"])
                      & a["doc_id"].eqNullSafe(b["other_doc"]) & (F.abs(a["start"] - b["other"]) <= slop))
        near = near.select(a["doc_id"], a["phrase"], a["start"], F.abs(a["start"] - b["other"]).alias("gap"))
        alone = a.where(F.col("anchors") == 1).select("doc_id", "phrase", "start", F.lit(0).alias("gap"))
        names = docs.sparkSession.createDataFrame(list(enumerate(part)), "number int, text string")
        near = near.union(alone).join(F.broadcast(names), F.col("phrase") == F.col("number")) \
                   .select("doc_id", F.col("text").alias("phrase"), "start", "gap")
        found = near if found is None else found.union(near)
    if found is None:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, item string, phrase string, start int, gap int")
    return (found.groupBy("doc_id", "phrase", "start").agg(F.min("gap").alias("gap"))
            .join(phrases, "phrase").select("doc_id", "item", "phrase", "start", "gap"))


def covered(spans: Column) -> Column:
    """How many words an array of (start, n) structs covers."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(state: Column, span: Column) -> Column:
        end = span["start"] + span["n"]
        own = F.greatest(F.lit(0), end - F.greatest(state["end"], span["start"])).cast("long")
        return F.struct(F.greatest(state["end"], end).alias("end"), (state["n"] + own).alias("n"))

    return F.aggregate(F.array_sort(spans), zero, step, lambda s: s["n"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, n_hit, items): the documents in which windows occur, one row each."""
    matches = phrase_matches(docs, items, window)
    return matches.groupBy("doc_id", "text_key").agg(
        covered(F.collect_set(F.struct("start", "n"))).alias("n_hit"),
        F.array_sort(F.collect_set("item")).alias("items"))


def _word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_words of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(1),
                                   pa.array([len(words(t)) for t in batch.column(2).to_pylist()], pa.int64())],
                                  ["doc_id", "text_key", "n_words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _keyed(docs).mapInArrow(run, f"doc_id {kind}, text_key long, n_words long")


def judge(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    hit = contamination(docs, items)
    d, c = _word_counts(docs).alias("d"), hit.alias("c")
    joined = d.join(c, F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.text_key") == F.col("c.text_key")), "left")
    names = F.coalesce(F.col("c.items"), F.array().cast("array<string>"))
    n_hit = F.coalesce(F.col("c.n_hit"), F.lit(0)).cast("long")
    return joined.select("d.doc_id", "d.n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
                         F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents in which no window occurs, with their columns."""
    own_id, own_key = fresh("__id", docs.columns), fresh("__key", docs.columns)
    hit = materialize(contamination(docs, items).select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key)), "hit")
    hit = checked_broadcast(hit, max_bytes=MAX_SENT_BYTES)
    return docs.join(hit, docs["doc_id"].eqNullSafe(F.col(own_id)) & (F.xxhash64(docs["text"]) == F.col(own_key)),
                     "left_anti")
