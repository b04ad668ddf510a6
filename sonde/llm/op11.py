"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

Any two neighbours of an encoding encode, by themselves, to just these two: no merge ever crosses the border
between them, so their own merges run as they do in the whole.  So merges compile into a transducer: having
read a prefix, it holds the cuts into such neighbours that can still be continued, each with the ids it has
not given out, its last id, and the bytes of its open token.  The true cut is always one of them; a prefix
with two finished cuts would leave it open which, and raises an error (vocabularies from BPE training have
none).  Ids that all cuts share are given out: the lookahead is a few tokens.  Sets of cuts are the states of
the deterministic machine; states and transitions are built when a text needs them and kept in a hash table
of arrays, which a worker walks for all pieces of a batch in step.

Null and empty texts have no ids.  A text longer than a chunk is encoded by itself; its arrays take some 60
bytes a byte of text.  Rows are independent: repeated rows, null ids and extra columns change nothing.
"""

from __future__ import annotations

import base64
import hashlib
import marshal
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sonde.llm.pretoken import Kinds, pieces, tiktoken_kinds
from sonde.llm.textvec import chunks, utf8

CHUNK = 1 << 19          # bytes encoded at once; a longer text goes by itself
KNOWN = 1_500_000        # transitions a worker keeps; it builds anew beyond
FEW = 24                 # pieces walked byte by byte instead of in step
FEED = 1 << 16           # ids decoded at once
_cached: dict[bytes, Transducer] = {}


def read_ranks(lines: bytes) -> list[bytes]:
    """Token bytes by rank, from the content of a rank file."""
    found = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines.splitlines()))
    if [rank for rank, _ in found] != list(range(len(found))):
        raise ValueError("ranks are not 0 to n - 1")
    return [token for _, token in found]


class Merges(NamedTuple):
    """A vocabulary (b"": no token of texts), the rank of each token's merge, and the two tokens that its last merge joins (-1: none)."""
    tokens: list[bytes]
    rank: list[float]
    left: list[int]
    right: list[int]
    characters: bool = False    # merges start from characters, not from bytes
    strict: bool = False        # only those two join to the token, not any two tokens with its bytes


def atoms(data: bytes, characters: bool) -> list[bytes]:
    return [c.encode() for c in data.decode()] if characters else [data[i:i + 1] for i in range(len(data))]


def merged(parts: list[bytes], rank: dict[bytes, float], least: int = 1) -> list[bytes]:
    """The parts after all merges, lowest rank first and leftmost of equals, or when only `least` are left."""
    none = float("inf")
    cost = [rank.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while len(parts) > least and (best := min(cost)) < none:
        i = cost.index(best)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del cost[i]
        for j in (i - 1, i):
            if 0 <= j < len(cost):
                cost[j] = rank.get(parts[j] + parts[j + 1], none)
    return parts


def compile_merges(tokens: list[bytes], rank: list[float] | None = None, characters: bool = False) -> Merges:
    """Runs each token's own merges up to its last one; ranks are ids unless given.

    Merges start from bytes, which must all be tokens; or from `characters`, and then tokens that merges do not make are left out.
    """
    rank = list(range(len(tokens))) if rank is None else rank
    known = {t: i for i, t in enumerate(tokens) if t}
    cost = {t: rank[i] for t, i in known.items()}
    if not characters and any(bytes([b]) not in known for b in range(256)):
        raise ValueError("a byte has no token")
    kept, left, right = list(tokens), [-1] * len(tokens), [-1] * len(tokens)
    for t, token in enumerate(tokens):
        parts = merged(atoms(token, characters), cost, 2)
        if len(parts) == 2 and all(part in known for part in parts):
            left[t], right[t] = (known[part] for part in parts)
        elif len(parts) > 1:
            if not characters:
                raise ValueError(f"the merges never join token {t}")
            kept[t] = b""
    return Merges(kept, rank, left, right, characters)


class Transducer:
    """The machine of one vocabulary."""

    def __init__(self, merges: Merges, kinds: Kinds):
        self.tokens, self.rank, self.kinds, self.characters = merges.tokens, merges.rank, kinds, merges.characters
        self.left, self.right = merges.left, merges.right
        self.known = {t: i for i, t in enumerate(self.tokens) if t}
        self.cost = {t: self.rank[i] for t, i in self.known.items()}
        times = Counter(self.cost.values())
        self.tied = [times[self.rank[i]] > 1 for i in range(len(self.tokens))]
        self.open = {t[:k] for t in self.tokens for k in range(1, len(t))}   # what longer tokens start with
        self.joint: dict[tuple[int, int], int] = {}                          # what two tokens make
        for i, t in enumerate(self.tokens):
            for k in range(1, len(t)):
                a, b = self.known.get(t[:k]), self.known.get(t[k:])
                if a is not None and b is not None and (not merges.strict or (a, b) == (self.left[i], self.right[i])):
                    self.joint[a, b] = i
        self._forget()

    def _forget(self) -> None:
        start = marshal.dumps((((), -1, b""),), 2)
        self.states, self.numbers = [start], {start: 0}      # serialised: a fifth of the memory of tuples
        self.bits = 12
        self.key, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        self.at, self.many = np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.int32)
        self.out, self.filled, self.used = np.zeros(1 << 12, np.int32), 0, 0

    def follows(self, a: int, b: int) -> bool:
        """Whether token b can stand after a (-1: the start).

        While a and b are being merged, the part of a next to the border and the part of b next to it are nodes
        of their merge trees.  Two such nodes join if that ranks before the merges that swallow either of them.
        Tokens of one rank are left to the merges themselves.
        """
        if a < 0:
            return True
        if self.tied[a] or self.tied[b]:
            pair = [self.tokens[a], self.tokens[b]]
            return merged(atoms(b"".join(pair), self.characters), self.cost) == pair
        joint, rank, until_a = self.joint, self.rank, float("inf")
        while a >= 0:
            until_b, y = float("inf"), b
            while y >= 0:
                made = joint.get((a, y))
                if made is not None and rank[made] < until_a and rank[made] <= until_b:
                    return False
                until_b, y = rank[y], self.left[y]
            until_a, a = rank[a], self.right[a]
        return True

    def _step(self, state: int, byte: int, last: bool) -> tuple[int, tuple[int, ...]]:
        """Next state and the ids given out; after a piece's last byte, all that are left, and the start state."""
        cuts, whole, byte = [], None, bytes([byte])
        for given, a, head in marshal.loads(self.states[state]):
            head += byte
            t = self.known.get(head)
            if t is not None and self.follows(a, t):
                if whole is not None:
                    raise ValueError(f"the merges allow two cuts before token {t}")
                whole = (*given, t)
                cuts.append((whole, t, b""))
            if not last and head in self.open:
                cuts.append((given, a, head))
        if last:
            return 0, whole
        cuts.sort(key=lambda cut: len(cut[2]))
        shared = min(len(cut[0]) for cut in cuts)
        while any(cut[0][:shared] != cuts[0][0][:shared] for cut in cuts):
            shared -= 1
        after = marshal.dumps(tuple((given[shared:], a, head) for given, a, head in cuts), 2)
        if after not in self.numbers:
            self.numbers[after] = len(self.states)
            self.states.append(after)
        return self.numbers[after], cuts[0][0][:shared]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        """Where each transition stands, or the free place where it would."""
        mask = (1 << self.bits) - 1
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.key[slot]
        miss = np.flatnonzero((found != key) & (found >= 0))
        while len(miss):
            slot[miss] = (slot[miss] + 1) & mask
            found = self.key[slot[miss]]
            miss = miss[(found != key[miss]) & (found >= 0)]
        return slot

    def _put(self, columns: list[np.ndarray]) -> None:
        """Enters transitions (key, next state, first id, ids); when two want one place, one waits for the next turn."""
        while len(columns[0]):
            slot = self._slot(columns[0])
            _, one = np.unique(slot, return_index=True)
            for table, column in zip((self.key, self.to, self.at, self.many), columns):
                table[slot[one]] = column[one]
            columns = [np.delete(column, one) for column in columns]

    def _learn(self, keys: np.ndarray) -> None:
        if 2 * (self.used + len(keys)) > 1 << self.bits:
            old, keep = (self.key, self.to, self.at, self.many), np.flatnonzero(self.key >= 0)
            self.bits = (2 * (self.used + len(keys))).bit_length()
            self.key = np.full(1 << self.bits, -1, np.int64)
            self.to, self.at, self.many = (np.zeros(1 << self.bits, np.int32) for _ in range(3))
            self._put([column[keep] for column in old])
        made = [self._step(key >> 9, key & 255, bool(key & 256)) for key in keys.tolist()]
        many = np.fromiter((len(given) for _, given in made), np.int32, len(made))
        given = np.fromiter((t for _, given in made for t in given), np.int32, int(many.sum()))
        at, self.filled = self.filled + np.cumsum(many) - many, self.filled + len(given)
        if self.filled > len(self.out):
            self.out = np.append(self.out, np.zeros(self.filled, np.int32))
        self.out[self.filled - len(given):self.filled] = given
        self._put([keys, np.array([to for to, _ in made], np.int32), at, many])
        self.used += len(keys)

    def _find(self, key: np.ndarray) -> np.ndarray:
        slot = self._slot(key)
        new = self.key[slot] < 0
        if new.any():
            self._learn(np.unique(key[new]))
            slot = self._slot(key)
        return slot

    def walk(self, data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces of `data` that start at `start`, and how many each byte gave out."""
        if self.used > KNOWN:
            self._forget()
        last = np.zeros(len(data), np.int64)
        last[np.append(start[1:], len(data)) - 1] = 256
        inputs = data.astype(np.int64) | last
        given = np.empty(len(data), np.int64)      # a transition's key
        size = np.diff(np.append(start, len(data)))
        order = np.argsort(-size, kind="stable")
        lanes, left = start[order], size[order]
        state, j = np.zeros(len(order), np.int64), 0
        alive = len(left)
        while alive > FEW:
            at = lanes[:alive] + j
            key = (state[:alive] << 9) | inputs[at]
            given[at] = key
            slot = self._find(key)      # may replace the arrays
            state[:alive] = self.to[slot]
            j += 1
            alive = int(np.searchsorted(-left[:alive], -j, "left"))
        for i in range(alive):
            now, a = int(state[i]), int(lanes[i])
            for at in range(a + j, a + int(left[i])):
                key = (now << 9) | int(inputs[at])
                given[at] = key
                slot = int(self._find(np.array([key]))[0])
                now = int(self.to[slot])
        slot = self._slot(given)
        many = self.many[slot].astype(np.int64)
        ends = np.cumsum(many)
        ids = self.out[np.repeat(self.at[slot] - ends + many, many) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, many

    def encode(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the UTF-8 texts data[ends[i]:ends[i + 1]] on end, and where each text's ids start (the total last)."""
        part = np.ascontiguousarray(data[ends[0]:ends[-1]])
        if not len(part):
            return np.empty(0, np.int32), np.zeros(len(ends), np.int64)
        heads = np.flatnonzero((part & 0xC0) != 0x80)
        codes = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        local = ends - ends[0]
        first = np.searchsorted(heads, local[:-1][np.diff(local) > 0])
        ids, many = self.walk(part, heads[pieces(codes, first, self.kinds)])
        return ids, np.append(0, np.cumsum(many))[local]


# The UTF-8 machine: state 0 stands between characters; 1 to 3 miss that many continuation bytes; 4 to 7 follow
# the leads E0, ED, F0 and F4, whose next byte has a narrower range.
_CLASSES = [(0x80, 0xBF, {1: 0, 2: 1, 3: 2}), (0xA0, 0xBF, {4: 1}), (0x80, 0x9F, {5: 1}), (0x90, 0xBF, {6: 2}), (0x80, 0x8F, {7: 2})]
_LEADS = [(0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)]


def utf8_machine() -> np.ndarray:
    """Next state by (state, byte).  A byte that does not fit ends the open character and is read from state 0."""
    step = np.zeros((8, 256), np.uint8)
    for low, high, to in _LEADS:
        step[:, low:high + 1] = to
    for low, high, moves in _CLASSES:
        for state, to in moves.items():
            step[state, low:high + 1] = to
    return step


class Decoder:
    """Text of ids that arrive in parts; a character is given out when its last byte is there.

    Bytes that are no UTF-8 become U+FFFD, as Python's decoding does with errors="replace".
    """

    def __init__(self, tokens: list[bytes]):
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        step = utf8_machine()
        self.after = np.repeat(np.arange(8, dtype=np.uint8)[:, None], len(tokens), 1)   # state after a token, by the state before
        for j in range(int(self.size.max(initial=0))):
            left = np.flatnonzero(self.size > j)
            self.after[:, left] = step[self.after[:, left], self.flat[self.start[left] + j]]
        self.settles = (self.after == self.after[0]).all(0)                             # whatever stood before
        self.reset()

    def reset(self) -> None:
        self.state, self.tail = 0, b""

    def feed(self, ids: np.ndarray) -> str:
        size = self.size[ids]
        ends = np.cumsum(size)
        data = self.tail + self.flat[np.repeat(self.start[ids] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        known = np.flatnonzero(self.settles[ids])
        for token in ids[known[-1] if len(known) else 0:].tolist():
            self.state = int(self.after[self.state, token])
        whole = len(data)
        if self.state:      # back to the open character's lead
            whole -= 1 + next(i for i, b in enumerate(reversed(data)) if b >= 0xC0)
        self.tail = data[whole:]
        return data[:whole].decode("utf-8", "replace")

    def finish(self) -> str:
        rest = self.tail.decode("utf-8", "replace")
        self.reset()
        return rest


def machine(merges: Merges) -> Transducer:
    """The worker's machine of a vocabulary; one is kept."""
    name = hashlib.sha256(b"\0".join(merges.tokens)).digest()
    if name not in _cached:
        _cached.clear()
        _cached[name] = Transducer(merges, tiktoken_kinds())
    return _cached[name]


def encoded(batches: Iterator[pa.RecordBatch], merges: Merges) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids) of batches of (doc_id, text)."""
    own = machine(merges)
    for batch in batches:
        data, ends = utf8(batch.column(1))
        for i, j in chunks(ends, CHUNK):
            ids, at = own.encode(data, ends[i:j + 1])
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], lists], ["doc_id", "ids"])


def decoded(batches: Iterator[pa.RecordBatch], tokens: list[bytes]) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids, text) of batches of (doc_id, ids)."""
    own = Decoder(tokens)
    for batch in batches:
        column, texts = batch.column(1), []
        for i in range(batch.num_rows):
            ids = column[i].values
            ids = np.empty(0, np.int32) if ids is None else ids.to_numpy(zero_copy_only=False)
            if len(ids) and not 0 <= ids.min() <= ids.max() < len(own.size):
                raise ValueError("an id is not in the vocabulary")
            texts.append("".join([*(own.feed(ids[k:k + FEED]) for k in range(0, len(ids), FEED)), own.finish()]))
        yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])


def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of batches of (doc_id, ids, text)."""
    for batch in batches:
        ids = [" ".join(map(str, found)) for found in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(batch.column(1).value_lengths(), pa.int64()),
             *(pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()) for texts in (ids, batch.column(2).to_pylist()))],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode(docs: DataFrame, merges: Merges) -> DataFrame:
    """doc_id and ids (ARRAY<INT>) of each row's text, without special tokens."""
    return docs.select("doc_id", "text").mapInArrow(lambda batches: encoded(batches, merges), "doc_id bigint, ids array<int>")


def decode(rows: DataFrame, tokens: list[bytes]) -> DataFrame:
    """doc_id, ids and text of rows of ids; null ids read as none, an id outside the vocabulary raises an error."""
    return rows.select("doc_id", "ids").mapInArrow(lambda batches: decoded(batches, tokens), "doc_id bigint, ids array<int>, text string")


def round_trip(docs: DataFrame, merges: Merges) -> DataFrame:
    """Digests of `decode(encode(docs))`, in one worker: ids of all documents do not pass through the JVM."""
    return docs.select("doc_id", "text").mapInArrow(lambda batches: digested(decoded(encoded(batches, merges), merges.tokens)),
                                                    "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
