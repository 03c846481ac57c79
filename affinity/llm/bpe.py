"""Operator 2: byte-level BPE encoding and decoding.

Encoding. The merge ranks are compiled, on demand, into a deterministic
finite-state transducer that reads a piece byte by byte. It rests on two facts
about greedy lowest-rank merging: every prefix of a piece has one encoding,
whose last token is the only vocabulary suffix compatible with the token
before it, and a sequence is an encoding exactly when its adjacent pairs are.
The underlying non-deterministic items are "a token that began here is being
read" (a vocabulary trie node and the tokens before it that are not emitted
yet). A state is a set of such items and the token emitted last; it is made
the first time it is reached. A token is emitted as soon as all items agree on it, so the lookahead
is bounded by the longest vocabulary entry. States and finished pieces are
kept in tables of bounded size, which start again when full; a piece is kept
from its second occurrence on. A piece's first bytes are read in one step once
they have been met, and whether two tokens fit is kept past a restart.

Decoding is streaming: Arrow puts the tokens' bytes together, and an incremental UTF-8 state machine holds back the bytes
of an unfinished character until the ids that complete it arrive.

Defined results: null text counts as empty text; empty text has no tokens;
repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import marshal
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from affinity.llm.common import kept, text_or_empty
from affinity.llm.pieces import Splitter

MAX_STATES = 250_000
MAX_PIECES = 60_000
MET_FLAGS = 1 << 21
DECODE_CHUNK = 8_192
STATE_BITS = 32
STATE_MASK = (1 << STATE_BITS) - 1
TOKEN_BITS = 21
TOKEN_MASK = (1 << TOKEN_BITS) - 1
LONG = (1 << 64) - 1
MANY = STATE_MASK                  # of a step: more than one token is emitted
NO_BYTE = 256
PREFIX = 5                         # bytes of a piece that are read in one step once they have been met
FITS = 1 << 18                     # answers of `_fit` kept, each in the place of its pair's hash
UNKNOWN, NEVER = -1, -2         # of a token: its last merge hasn't been looked for, or isn't there


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """Lazily determinised transducer from the bytes of a piece to token ids."""

    ROOT = 0

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks = ranks
        self.max_states = max_states
        self.token = {rank: token for token, rank in ranks.items()}
        self.child: list[dict[int, int]] = [{}]        # of each node: byte -> node
        self.accepts: list[int | None] = [None]        # of each node: token id
        leaf: dict[int, int] = {}                      # shared by the nodes without children
        for token, rank in ranks.items():
            node = self.ROOT
            for byte in token:
                following = self.child[node].get(byte)
                if following is None:
                    if self.child[node] is leaf:
                        self.child[node] = {}
                    following = self.child[node][byte] = len(self.child)
                    self.child.append(leaf)
                    self.accepts.append(None)
                node = following
            self.accepts[node] = rank
        self.left = array("q", [UNKNOWN]) * (max(ranks.values(), default=0) + 1)      # of each token: its last merge
        self.right = array("q", self.left)
        self.in_order = True                           # as far as seen: no merge has a part of a higher rank
        self.fits = array("Q", [0]) * FITS             # a pair of tokens, and in the last bit whether they fit; 0: none
        self._restart()

    def _restart(self) -> None:
        # states are kept as bytes, a fifth of the size of the nested tuples; version 2 gives equal states equal bytes
        packed = marshal.dumps((None, ((self.ROOT, ()),)), 2)
        self.number = {packed: 0}
        self.items = [packed]
        # a step is one number, the next state and above STATE_BITS what is emitted: nothing (0), a token id + 1,
        # or MANY, where `emitted` has the tokens; a state's first step stands in two arrays, others in `delta`
        self.first = array("H", [NO_BYTE])
        self.first_step = array("Q", [0])
        self.last = array("Q", [0])                    # of each state: the tokens read and not emitted, TOKEN_BITS each; LONG: see `items`
        self.delta: dict[int, int] = {}                # state * 256 + byte -> step
        self.emitted: dict[int, tuple[int, ...]] = {}
        self.prefix: dict[bytes, tuple[int, ...]] = {} # the first PREFIX bytes of a piece -> the state, and the tokens emitted
        self.newest = 0, (None, ((self.ROOT, ()),))    # the state made last, and what it holds

    def _merges(self, text: bytes) -> Iterator[list[bytes]]:
        """The definition: merge the adjacent pair of lowest rank, leftmost first, while one exists; the parts after each step."""
        ranks, none = self.ranks, len(self.ranks) + 1
        parts = [text[i:i + 1] for i in range(len(text))]
        costs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        yield parts
        while costs:
            best = min(costs)
            if best == none:
                break
            at = costs.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del costs[at]
            if at:
                costs[at - 1] = ranks.get(parts[at - 1] + parts[at], none)
            if at < len(costs):
                costs[at] = ranks.get(parts[at] + parts[at + 1], none)
            yield parts

    def _merged(self, text: bytes) -> list[int]:
        return [self.ranks[p] for p in [*self._merges(text)][-1]]

    def _made(self, token: int) -> bool:
        """Does merging the bytes of a token give it? If so, `left` and `right` have its last merge (a byte: itself)."""
        if self.left[token] == UNKNOWN:
            ranks, parts, last = self.ranks, [], (token, token)
            for parts in self._merges(self.token[token]):
                if len(parts) == 2:
                    last = ranks[parts[0]], ranks[parts[1]]
            self.left[token], self.right[token] = last if len(parts) == 1 else (NEVER, NEVER)
            self.in_order &= len(self.token[token]) == 1 or max(last) < token
        return self.left[token] != NEVER

    def _fit(self, before: int | None, token: int) -> bool:
        """Can `token` follow `before` in an encoding?

        It can if both can be made and no merge across their border comes
        before theirs: the later of their last merges is undone, and the two
        parts at the border compared again, until only bytes are left. On the
        same rank the left one was merged first. That takes ranks that rise
        with the merges; for other tables the pair is merged as defined.
        """
        if not self._made(token):
            return False
        if before is None:
            return True
        ranks, text, left, right = self.ranks, self.token, self.left, self.right
        pair, limit = [before, token], None
        while self.in_order:
            across = ranks.get(text[before] + text[token])
            if across is not None and (limit is None or across < limit):
                return False
            if right[before] == before and left[token] == token:
                return True
            if left[token] == token or (right[before] != before and before > token):
                limit = before
                before = right[before]
                self._made(before)
            else:
                limit = token + 1
                token = left[token]
                self._made(token)
        return self._merged(b"".join(map(text.__getitem__, pair))) == pair

    def _fits(self, before: int | None, token: int) -> bool:
        """`_fit`, which most pairs are asked more than once."""
        if before is None:
            return self._made(token)
        key = (before << STATE_BITS | token) + 1 << 1
        at = (before * 40_503 + token) % len(self.fits)
        held = self.fits[at]
        if held & ~1 != key:
            held = self.fits[at] = key | self._fit(before, token)
        return held & 1 == 1

    def _follow(self, anchor: int | None, items: tuple, byte: int) -> tuple[int | None, tuple, tuple[int, ...]]:
        """What a state becomes by a byte, and the tokens emitted."""
        child, accepts = self.child, self.accepts
        alive, newest = [], None
        for node, pending in items:
            following = child[node].get(byte)
            if following is None:
                continue
            if newest is None:
                token = accepts[following]
                if token is not None and self._fits(pending[-1] if pending else anchor, token):
                    newest = (self.ROOT, (*pending, token))
            if child[following]:
                alive.append((following, pending))
        alive.append(newest)
        first = alive[0][1]
        agreed = len(first)
        if first:
            for _, pending in alive:
                agreed = min(agreed, len(pending))
                while first[:agreed] != pending[:agreed]:
                    agreed -= 1
            if agreed:
                anchor = first[agreed - 1]
                alive = [(node, pending[agreed:]) for node, pending in alive]
            elif all([pending for _, pending in alive]):
                anchor = None                  # no item looks at it any more
        return anchor, tuple(alive), first[:agreed]

    def _make(self, state: int, byte: int) -> int:
        last, held = self.newest                       # a new state is mostly asked for its step at once
        anchor, items, tokens = self._follow(*(held if last == state else marshal.loads(self.items[state])), byte)
        key = marshal.dumps((anchor, items), 2)
        step = self.number.get(key)
        if step is None:
            step = self.number[key] = len(self.items)
            self.items.append(key)
            self.first.append(NO_BYTE)
            self.first_step.append(0)
            held = items[-1][1]                        # the newest item holds them
            last = 0
            for token in reversed(held):
                last = last << TOKEN_BITS | token + 1
            self.last.append(last if len(held) <= 64 // TOKEN_BITS and max(held, default=0) < TOKEN_MASK else LONG)
            self.newest = step, (anchor, items)
        at = state << 8 | byte
        if len(tokens) == 1:
            step |= tokens[0] + 1 << STATE_BITS
        elif tokens:
            step |= MANY << STATE_BITS
            self.emitted[at] = tokens
        if self.first[state] == NO_BYTE:
            self.first[state], self.first_step[state] = byte, step
        else:
            self.delta[at] = step
        return step

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.items) > self.max_states:
            self._restart()
        if len(piece) <= PREFIX:
            state, out = self._read(0, piece)
        else:
            start = piece[:PREFIX]
            met = self.prefix.get(start)
            if met is None:
                state, out = self._read(0, start)
                met = self.prefix[start] = (state, *out)
            state, out = self._read(met[0], piece[PREFIX:])
            if len(met) > 1:
                out[:0] = met[1:]
        last = self.last[state]
        if last == LONG:
            return [*out, *marshal.loads(self.items[state])[1][-1][1]]
        while last:
            out.append((last & TOKEN_MASK) - 1)
            last >>= TOKEN_BITS
        return out

    def _read(self, state: int, text: bytes) -> tuple[int, list[int]]:
        """The state after `text` is read from a state, and the tokens emitted."""
        out: list[int] = []
        first, first_step, delta = self.first, self.first_step, self.delta
        for byte in text:
            if first[state] == byte:
                step = first_step[state]
            else:
                step = delta.get(state << 8 | byte)
                if step is None:
                    step = self._make(state, byte)
            if step > STATE_MASK:
                token = step >> STATE_BITS
                if token == MANY:
                    out += self.emitted[state << 8 | byte]
                else:
                    out.append(token - 1)
            state = step & STATE_MASK
        return state, out


class PieceTable(dict):
    """Pieces met more than once, each with its decimal ids joined by spaces.

    Two generations of at most `most` pieces: when the newer is full it
    becomes the older, and a piece found there moves up. So frequent pieces
    stay and memory is bounded. A piece enters when it is met again, which one
    bit of its hash remembers; most pieces of a corpus are met once.
    """

    def __init__(self, transducer: Transducer, most: int):
        super().__init__()
        self.transducer = transducer
        self.most = most
        self.older: dict[str, str] = {}
        self.met = bytearray(MET_FLAGS)
        self.first_met = 0

    def _again(self, piece: str) -> bool:
        """Has the piece, or one of the same hash, been met since the flags were last cleared?"""
        flag = hash(piece) % MET_FLAGS
        if self.met[flag]:
            return True
        if self.first_met >= MET_FLAGS // 2:
            self.met, self.first_met = bytearray(MET_FLAGS), 0
        self.met[flag] = 1
        self.first_met += 1
        return False

    def __missing__(self, piece: str) -> str:
        hit = self.older.get(piece)
        if hit is None:
            hit = " ".join(map(str, self.transducer.encode(piece.encode())))
            if not self._again(piece):
                return hit
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[piece] = hit
        return hit


def parse_ids(decimal: str) -> np.ndarray:
    """The ids of a text from their decimal form."""
    return np.fromstring(decimal, np.int32, sep=" ") if decimal else np.empty(0, np.int32)


class Encoder:
    """Whole texts to token ids: split by the pattern, then each piece through the transducer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_pieces: int = MAX_PIECES):
        self.transducer = Transducer(ranks)
        self.decoder = Decoder(ranks)
        self.split = Splitter(pattern)
        self.known = PieceTable(self.transducer, max_pieces)

    def decimal(self, text: str) -> str:
        """The ids of a text, decimal and joined by spaces."""
        return " ".join(map(self.known.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return parse_ids(self.decimal(text)).tolist()


class Utf8Machine:
    """Incremental UTF-8: bytes in, complete characters out; `pending` holds the start of one."""

    def __init__(self):
        self.pending = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that may still be completed."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 == 0x80:
                continue                       # continuation: look further left
            need = 2 if 0xC2 <= byte <= 0xDF else 3 if 0xE0 <= byte <= 0xEF else 4 if 0xF0 <= byte <= 0xF4 else 1
            if need <= back:
                return 0
            if back > 1:                       # the second byte has a narrower range after these leads
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
                if not low <= data[-back + 1] <= high:
                    return 0
            return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.pending + data
        keep = self._unfinished(data)
        self.pending = data[len(data) - keep:]
        return data[:len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        data, self.pending = self.pending, b""
        return data.decode("utf-8", "replace")


class Decoder:
    """Ids to text: the tokens are one Arrow column, and taking its rows puts their bytes one after another."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.tokens = pa.array(tokens, pa.binary())

    def _bytes(self, ids: np.ndarray) -> bytes:
        taken = self.tokens.take(pa.array(ids, pa.int32()))
        if taken.null_count:
            raise KeyError("an id without a token")
        _, ends, data = taken.buffers()
        return data.slice(0, int(np.frombuffer(ends, np.int32)[len(ids)])).to_pybytes() if len(ids) else b""

    def stream(self, ids: np.ndarray, chunk: int = DECODE_CHUNK) -> Iterator[str]:
        """Text of ids, read in chunks, in parts that never cut a character."""
        machine = Utf8Machine()
        for at in range(0, len(ids), chunk):
            yield machine.feed(self._bytes(ids[at:at + chunk]))
        yield machine.finish()


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder a Python worker, kept between the tasks of a stage."""

    def make() -> Encoder:
        gc.set_threshold(100_000, 50, 100)     # the tables are large and hold no cycles
        return Encoder(load_ranks(path), pattern)

    return kept(("bpe", path, pattern), make)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id",
                     text_column: str = "text") -> DataFrame:
    """(id, ids array<int>) of every text. The rank file's path must hold on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            yield pa.record_batch([batch.column(0),
                                   pa.array([enc.encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))],
                                  [id_column, "ids"])

    rows = docs.select(id_column, text_or_empty(text_column).alias("text"))
    return rows.mapInArrow(run, f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """(id, text) from (id, ids array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(load_ranks(path))
        for batch in batches:
            texts = ["".join(decoder.stream(np.array(ids or [], np.int32))) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], [id_column, "text"])

    return encoded.select(id_column, "ids").mapInArrow(
        run, f"`{id_column}` {encoded.schema[id_column].dataType.simpleString()}, text string")


def round_trip_digest(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids): encode every text and decode its ids again.

    Encoding and decoding run in one pass so that the ids
    leave the task only where they are asked for.
    """

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            counts, ids_digests, text_digests, all_ids = [], [], [], []
            for text in batch.column(1).to_pylist():
                decimal = enc.decimal(text)
                ids = parse_ids(decimal)
                counts.append(len(ids))
                if with_ids:
                    all_ids.append(ids)
                ids_digests.append(hashlib.sha256(decimal.encode()).hexdigest())
                digest = hashlib.sha256()
                for part in enc.decoder.stream(ids):
                    digest.update(part.encode())
                text_digests.append(digest.hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()),
                       pa.array(text_digests, pa.string())]
            if with_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
            yield pa.record_batch(columns, names)

    rows = docs.select("doc_id", text_or_empty().alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, "
                                "ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
