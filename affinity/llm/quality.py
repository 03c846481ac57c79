"""Operator 9: quality classifier, a factorisation machine.

A text becomes a sparse vector: hashed words (with their share of the words),
hashed character shapes, and statistics of its structure, as they are and cut
into bands (one feature a band). The score is w0 + sum w_i x_i + sum over pairs <v_i, v_j>
x_i x_j through the logistic function. The pairs cost linear time by
1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

The model is fitted with Adagrad on at most `FIT_ROWS` labelled rows, taken by
hash; it has a fixed size, so it is sent to every task. Every row is scored,
over its whole text.

Labels, language, source and document id are never inputs of a score. The id
only decides who is held out: crc32 of its decimal text mod 5 is 0.

Defined results: null text counts as empty text, which has the features of an
empty text and a score like any other; rows without a label are only scored;
with no labels at all, or of one class only, the score is the base rate
(0.5 without labels); repeated rows get the same score; extra columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.llm.common import fresh, release, text_or_empty

BITS = 14                 # hashed features: 2^BITS
FACTORS = 8
FIT_ROWS = 12_000
FIT_TEXT_BYTES = 200_000  # longer texts are scored but not fitted on
EPOCHS = 6
THRESHOLD = 0.3
MAX_WORDS = 300_000       # hashed words kept by a worker



def held_out(column: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(5)) == 0


class WordTable(dict):
    """Words to the indices of the word (low 32 bits) and of its shape (high 32 bits)."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def index(self, name: str) -> int:
        return zlib.crc32(name.encode()) & (self.size - 1)

    def __missing__(self, word: str) -> int:
        shape = "".join(dict.fromkeys("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
                                      for c in word[-4:]))
        out = self.index("w " + word.lower()) | self.index("s " + shape) << 32
        if len(self) > MAX_WORDS:
            self.clear()
        if len(word) <= 40:
            self[word] = out
        return out


class Features:
    """Texts to (index, value) arrays."""

    def __init__(self, bits: int = BITS):
        self.known = WordTable(1 << bits)

    def statistics(self, text: str, words: list[str]) -> dict[str, float]:
        """Shares and rates that describe the structure of a text, all between 0 and 1 but the lengths."""
        n, m = max(len(text), 1), max(len(words), 1)
        lines = text.split("\n")
        letters = sum(map(len, re.findall(r"[^\W\d_]+", text))) if not text.isascii() else \
            sum(map(len, re.findall(r"[A-Za-z]+", text)))
        upper = sum(map(len, re.findall(r"[A-ZÀ-Þ]+", text)))
        repeats = sum(map(eq, words, words[1:]))
        return {
            "chars": np.log2(n), "words": np.log2(m), "word length": min(n / m / 20, 1.0),
            "letters": letters / n, "upper": upper / max(letters, 1),
            "digits": sum(map(len, re.findall(r"[0-9]+", text))) / n,
            "symbols": len(re.findall(r"[#$%&*|<>{}\[\]\\^~_=+@]", text)) / n,
            "bangs": text.count("!") / m, "bars": text.count("|") / m,
            "stops": min((text.count(".") + text.count(",")) / m, 1.0),
            "distinct": len(set(words)) / m, "repeats": repeats / m,
            "distinct lines": len(set(lines)) / len(lines), "line words": min(m / len(lines) / 100, 1.0),
            "trigrams": len(set(zip(words, words[1:], words[2:]))) / max(m - 2, 1) if m > 2 else 1.0,
        }

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        index, value = [], []
        if words:
            pairs = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            for column, weight in ((pairs & 0xFFFFFFFF, 1.0), (pairs >> 32, 2.0)):
                found, counts = np.unique(column, return_counts=True)
                index.append(found)
                value.append(weight * np.sqrt(counts / len(words)))
        found = self.statistics(text, words)
        index.append(np.array([self.known.index(f"b {name} {int(v if v > 1 else v * 20)} {v > 1}")
                               for name, v in found.items()]))
        value.append(np.full(len(found), 0.5))
        index.append(np.array([self.known.index(f"v {name}") for name in found]))
        value.append(np.array([v / 20 if v > 1 else v for v in found.values()]))
        return np.concatenate(index).astype(np.int64), np.concatenate(value)


@dataclass
class Machine:
    """Weights of a factorisation machine."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, index: np.ndarray, value: np.ndarray) -> float:
        v = self.factors[index] * value[:, None]
        total = v.sum(axis=0)
        return float(self.bias + self.linear[index] @ value + 0.5 * (total @ total - (v * v).sum()))

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(index, value), -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], bits: int = BITS, factors: int = FACTORS,
        epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-5) -> Machine:
    """Adagrad on the logistic loss, one row at a time in a fixed shuffled order."""
    random = np.random.default_rng(7)
    share = float(np.mean(labels)) if labels else 0.5
    share = min(max(share, 1e-3), 1 - 1e-3) if labels else 0.5
    model = Machine(float(np.log(share / (1 - share))), np.zeros(1 << bits),
                    random.normal(0, 0.02, (1 << bits, factors)))
    if len(set(labels)) < 2:
        model.factors[:] = 0
        return model
    gl, gf = np.full(1 << bits, 1e-2), np.full((1 << bits, factors), 1e-2)
    for _ in range(epochs):
        for k in random.permutation(len(rows)):
            index, value = rows[k]
            v = model.factors[index] * value[:, None]
            total = v.sum(axis=0)
            margin = model.bias + model.linear[index] @ value + 0.5 * (total @ total - (v * v).sum())
            slope = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[k]
            step = slope * value + decay * model.linear[index]
            gl[index] += step * step
            model.linear[index] -= rate * step / np.sqrt(gl[index])
            step = slope * value[:, None] * (total - v) + decay * model.factors[index]
            gf[index] += step * step
            model.factors[index] -= 0.3 * rate * step / np.sqrt(gf[index])
            model.bias -= 0.01 * rate * slope
    return model


def train(docs: DataFrame, labels: DataFrame, max_rows: int = FIT_ROWS, bits: int = BITS) -> Machine:
    """Fit on at most `max_rows` labelled rows that are not held out; features are made on the executors."""
    chosen = (labels.where(~held_out()).where(F.col("quality").isin(0, 1))
              .select("doc_id", F.col("quality").alias("__label")).dropDuplicates(["doc_id"])
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        features = Features(bits)
        for batch in batches:
            made = [features(t) for t in batch.column(0).to_pylist()]
            yield pa.record_batch([batch.column(1), pa.array([i.astype(np.int32) for i, _ in made], pa.list_(pa.int32())),
                                   pa.array([v.astype(np.float32) for _, v in made], pa.list_(pa.float32()))],
                                  ["label", "index", "value"])

    text = text_or_empty()
    rows = (docs.select("doc_id", text.alias("text")).where(F.octet_length("text") <= FIT_TEXT_BYTES)
            .join(chosen, "doc_id").select("text", F.col("__label").cast("int").alias("label"), "doc_id")
            .orderBy("doc_id", "text").select("text", "label")
            .mapInArrow(run, "label int, index array<int>, value array<float>").toArrow())
    made = [(np.asarray(i, np.int64), np.asarray(v, np.float64))
            for i, v in zip((x.values.to_numpy() for x in rows["index"]), (x.values.to_numpy() for x in rows["value"]))]
    return fit(made, rows["label"].to_pylist(), bits)


def score_documents(docs: DataFrame, model: Machine, keep: list[str] | None = None, bits: int = BITS) -> DataFrame:
    """Columns `keep` (doc_id by default) and the score of every document's whole text."""
    keep = keep or ["doc_id"]
    names = [f"c{i}" for i in range(len(keep))]      # any column may be called like ours
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], text_or_empty().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        features = Features(bits)
        for batch in batches:
            scores = [model.score(*features(t)) for t in batch.column(len(names)).to_pylist()]
            yield pa.record_batch([*(batch.column(i) for i in range(len(names))), pa.array(scores, pa.float64())],
                                  [*names, "score"])

    kinds = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(keep, names))
    return rows.mapInArrow(run, f"{kinds}, score double").toDF(*keep, "score")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = train(docs, labels)
    return score_documents(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, with their columns."""
    columns = docs.columns
    score = fresh("score", columns)
    scored = score_documents(docs, train(docs, labels), columns).toDF(*columns, score)
    return scored.where(F.col(score) >= threshold).select(*[F.col(f"`{c}`") for c in columns])
