"""Periodic runs of words: maximal stretches that repeat a block of words four times or more.

The texts of an Arrow batch are joined into one array of word numbers, each
closed by a number of its own, so no match crosses a text.

1. Harmonic grid: a run of period p and length 4p or more holds three equal
   steps between multiples of p. For each p the words at multiples of p are
   compared with their successors, n/p words for each p, n log n in all; only
   texts where three steps in a row are equal go on.
2. Longest common extension (LCE) by a difference cover: of these texts only the
   suffixes at places whose remainder by V is in the cover are sorted, by
   doubling from blocks of V words. For any two places there is one shift below V that
   takes both to sorted ones, so a query compares fewer than V words and then
   asks a sparse table for the least common prefix between two ranks.
3. Each grid place is extended forwards, and backwards by the same structure
   over the reversed texts. Equal stretches found with several periods have the
   smallest one.

Odd rows: null and empty texts have no words, no runs and the digests of the
empty string; a null id has no number, so `periodise` leaves its text as it is.
Repeated rows are judged one by one, other columns are ignored. One text is
held in one task: about 100 bytes a word, plus, for a text with candidates,
about 16 bytes for each of its words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words joined for one pass, except that one text is never cut.
BATCH_WORDS = 250_000
LEAST_LENGTH, LEAST_COPIES = 6, 4

# Difference cover of the remainders by 31: fixed values, each remainder is a difference of two of them.
V = 31
COVER = (1, 5, 11, 24, 25, 27)


def _shifts() -> np.ndarray:
    """shift[a, b]: the least s for which a + s and b + s are both in the cover, by V."""
    table = np.zeros((V, V), np.int64)
    for a in range(V):
        for b in range(V):
            table[a, b] = next(s for s in range(V) if (a + s) % V in COVER and (b + s) % V in COVER)
    return table


SHIFT = _shifts()


class CommonExtensions:
    """LCE queries over an array of word numbers, from the sorted suffixes at cover places only."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.n = n
        # closed by numbers that occur nowhere else, so that no comparison runs over the end
        self.words = np.concatenate([words, -1 - np.arange(V, dtype=np.int64)])
        places = np.flatnonzero(np.isin(np.arange(n) % V, COVER))
        self.number = np.full(n, -1, np.int32)                 # place → its number among the cover places
        self.number[places] = np.arange(len(places), dtype=np.int32)
        self.after = np.searchsorted(places, places + V).astype(np.int64)   # number of the place V words later
        self.after[places + V >= n] = len(places)
        self._sort(places)

    def _sort(self, places: np.ndarray) -> None:
        """Ranks by blocks of V, 2V, 4V … words until all differ; then common prefixes of neighbours in that order."""
        m = len(places)
        block = np.lib.stride_tricks.sliding_window_view(self.words, V)[places] if m else np.empty((0, V), np.int64)
        order = np.lexsort(block.T[::-1]) if m else np.empty(0, np.int64)
        levels, step = [], self.after
        new = np.ones(m, bool)
        if m > 1:
            new[1:] = (block[order[1:]] != block[order[:-1]]).any(axis=1)
        steps = []
        while True:
            rank = np.empty(m + 1, np.int64)
            rank[order] = np.cumsum(new) - 1 if m else 0
            rank[m] = -1
            levels.append(rank)
            steps.append(step)
            if m == 0 or new.all():
                break
            key = rank[:m] * (m + 1) + rank[step] + 1
            order = np.argsort(key, kind="stable")
            new = np.ones(m, bool)
            new[1:] = key[order[1:]] != key[order[:-1]]
            step = np.append(step, m)[step]
        self.rank = levels[-1][:m]
        # common prefixes of neighbours: whole blocks by the levels, the rest word by word
        a, b = order[:-1].copy(), order[1:].copy()
        length = np.zeros(max(m - 1, 0), np.int64)
        for k in range(len(levels) - 2, -1, -1):
            same = (levels[k][a] == levels[k][b]) & (a < m) & (b < m)
            length[same] += V << k
            jump = np.append(steps[k], m)
            a[same], b[same] = jump[a[same]], jump[b[same]]
        at = np.append(places, self.n)
        length += self._compare(at[a], at[b], np.full(len(a), V))
        self.table = [length]
        while len(self.table[-1]) > (w := 1 << (len(self.table) - 1)):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-w], last[w:]))

    def _compare(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from i and j on, `most` (at most V) or fewer."""
        out = np.zeros(len(i), np.int64)
        live = np.flatnonzero(most > 0)
        for k in range(V):
            live = live[(k < most[live])]
            live = live[self.words[i[live] + k] == self.words[j[live] + k]]
            if not len(live):
                break
            out[live] += 1
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The number of equal words from places i and j on; i and j differ."""
        shift = SHIFT[i % V, j % V]
        out = self._compare(i, j, shift)
        go = np.flatnonzero((out == shift) & (np.maximum(i, j) + shift < self.n))
        if len(go):
            a = self.rank[self.number[i[go] + shift[go]]]
            b = self.rank[self.number[j[go] + shift[go]]]
            lo, hi = np.minimum(a, b), np.maximum(a, b)          # the least of lo … hi - 1
            level = np.frexp(hi - lo)[1] - 1
            least = np.empty(len(go), np.int64)
            for k in np.unique(level):
                of = level == k
                least[of] = np.minimum(self.table[k][lo[of]], self.table[k][hi[of] - (1 << k)])
            out[go] += least
        return out


def _grid(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, periods) where three steps of p from a multiple of p on are equal.

    Texts stand in falling order of length, so those long enough for p are a prefix of the array.
    """
    lengths = np.diff(ends, prepend=0) - 1
    places, periods = [], []
    most = int(lengths.max(initial=0)) // LEAST_COPIES
    # words of the texts that are long enough for each period
    held = np.searchsorted(-lengths, -np.maximum(LEAST_LENGTH, LEAST_COPIES * np.arange(most + 1)), side="right")
    for p in range(1, most + 1):
        if not held[p]:
            break
        on = words[:ends[held[p] - 1]:p]
        equal = on[1:] == on[:-1]
        found = np.flatnonzero(equal[:-2] & equal[1:-1] & equal[2:])
        if len(found):
            places.append(found * p)
            periods.append(np.full(len(found), p))
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(places), np.concatenate(periods)


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One array of all texts, each closed by a negative number of its own, and the ends (closings included)."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    for k, (t, end) in enumerate(zip(texts, ends)):
        out[end - 1 - len(t):end - 1] = t
        out[end - 1] = -V - 1 - k
    return out, ends


def find_runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text of word numbers (not negative), by start, then period."""
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    words, ends = _joined([texts[k] for k in order])
    places, periods = _grid(words, ends)
    if not len(places):
        return runs
    # the texts with candidates alone are sorted
    of = np.searchsorted(ends, places, side="right")
    kept, where = np.unique(of, return_inverse=True)
    starts = np.concatenate([[0], ends[:-1]])
    inside = places - starts[of]
    chosen = [texts[order[k]] for k in kept]
    words, ends = _joined(chosen)
    starts = np.concatenate([[0], ends[:-1]])
    lengths = ends - starts - 1
    i = starts[where] + inside
    fore = CommonExtensions(words)(i, i + periods)
    # three grid places of a run lie in it: from the first one the rest is this long at least
    ahead = fore >= np.maximum(LEAST_LENGTH, LEAST_COPIES * periods) - 2 * periods + 1
    where, inside, periods, fore = where[ahead], inside[ahead], periods[ahead], fore[ahead]
    if not len(where):
        return runs
    # the same backwards: place x of a text is place length - 1 - x of the reversed one
    j = starts[where] + lengths[where] - inside               # the reversed place just before `inside`
    back = np.zeros(len(where), np.int64)
    some = np.flatnonzero(inside > 0)
    turned = CommonExtensions(_joined([t[::-1] for t in chosen])[0])
    back[some] = turned(j[some], j[some] - periods[some])
    begin, length = inside - back, fore + back + periods
    good = length >= np.maximum(LEAST_LENGTH, LEAST_COPIES * periods)
    where, begin, length, periods = where[good], begin[good], length[good], periods[good]
    by = np.lexsort((periods, length, begin, where))
    where, begin, length, periods = where[by], begin[by], length[by], periods[by]
    first = np.ones(len(by), bool)
    first[1:] = (where[1:] != where[:-1]) | (begin[1:] != begin[:-1]) | (length[1:] != length[:-1])
    for k, s, n, p in zip(where[first].tolist(), begin[first].tolist(), length[first].tolist(), periods[first].tolist()):
        runs[order[kept[k]]].append((s, n, p))
    for found in runs:
        found.sort(key=lambda r: (r[0], r[2]))
    return runs


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def periodise(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words as the query takes them: every tenth text, by the crc32 of its id, repeats a block to its end."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a:a + p]
    return words[:a] + (block * ((n - a) // p + 1))[:n - a]


RESULT = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")


def _judged(group: list[tuple[int | None, list[bytes]]]) -> Iterator[tuple]:
    """A result row for each (doc_id, words)."""
    numbers: dict[bytes, int] = {}
    texts = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
             for _, words in group]
    for (doc_id, words), runs in zip(group, find_runs(texts)):
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
        start, length, period = best or (None, None, None)
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        yield (doc_id, len(runs), start, length, period, 1000 * length // period if best else None,
               hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapse(words, runs))).hexdigest())


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in RESULT.split(", ")])

    def out(group):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*_judged(group)), schema.types)], schema=schema)

    group, held = [], 0
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        for k, doc_id in enumerate(ids):
            words = periodise(doc_id, (texts[k].as_py() or b"").split())
            if group and held + len(words) > BATCH_WORDS:
                yield out(group)
                group, held = [], 0
            group.append((doc_id, words))
            held += len(words)
    if group:
        yield out(group)


def detect(docs: DataFrame) -> DataFrame:
    """The runs of each document (doc_id, text) and digests of them and of the text without repeated periods."""
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("text"))
            .mapInArrow(_batches, RESULT))
