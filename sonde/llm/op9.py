"""Token ids in binary blocks under Re-Pair grammars."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonde.llm.common import stored
from sonde.llm.pretoken import pieces, tokenizers_kinds
from sonde.llm.table import Column, Table
from sonde.llm.textvec import names

END = 2
BLOCK = 1_000_000       # ids of a block, about; a block holds whole documents
RULES, LEAST = 4_000, 8   # pairs replaced in a pass, at most; a pair seen less often stays
KNOWN = 1_500_000       # pieces a worker remembers; it starts anew beyond
CHUNK = 1_000_000       # characters split at once
SPECIAL = "<|endoftext|>"

_cached: dict[str, Encoder] = {}


class Encoder:
    """Ids of texts by a tokenizer file; each distinct piece is given to the tokenizer once.

    Known pieces are found by a 63-bit name and then compared, character by character, with what the name stands for.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")    # a task has one core; the library's threads only contend
        self.tokenizer, self.kinds = Tokenizer.from_file(path), tokenizers_kinds()
        self.whole = Tokenizer.from_file(path)      # for pieces: they are not looked through for splits again
        self.whole.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._forget()

    def _forget(self) -> None:
        self.known = Table()
        self.start, self.size, self.ids = Column(np.int64), Column(np.int64), Column(np.uint16)
        self.text_start, self.text_size, self.text = Column(np.int64), Column(np.int64), Column(np.uint32)

    def _tokenize(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces on end, and how many each has."""
        many = getattr(self.whole, "encode_batch_fast", self.whole.encode_batch)
        found = [e.ids for i in range(0, len(names), 20_000) for e in many(names[i:i + 20_000], add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint16, int(size.sum())), size

    def _learn(self, keys: np.ndarray, codes: np.ndarray, start: np.ndarray, stop: np.ndarray, names: list[str]) -> None:
        flat, size = self._tokenize(names)
        self.start.extend(self.ids.extend(flat) + np.cumsum(size) - size)
        self.size.extend(size)
        width = stop - start
        self.text_start.extend(self.text.extend(codes[spread(start, width)]) + np.cumsum(width) - width)
        self.text_size.extend(width)
        self.known.enter(keys)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without an end id; no text may hold a special token's name."""
        first = np.cumsum([0, *map(len, texts)])
        whole = "".join(texts)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        start = pieces(codes, first[:-1][np.diff(first) > 0], self.kinds)
        stop = np.append(start[1:], len(codes))
        key = (names(codes.view(np.uint8), 4 * start, 4 * stop) >> np.uint64(1)).astype(np.int64)
        slot = self.known.find(key)
        if (slot < 0).any():
            if self.known.used + len(key) > KNOWN:
                self._forget()
                slot[:] = -1
            new, at = np.unique(np.where(slot < 0, key, -1), return_index=True)
            new, at = new[new >= 0], at[new >= 0]
            self._learn(new, codes, start[at], stop[at], [whole[i:j] for i, j in zip(start[at].tolist(), stop[at].tolist())])
            slot = self.known.find(key)
        width = stop - start
        same = self.text_size.data[slot] == width
        flat = np.repeat(same, width)
        equal = codes[flat] == self.text.data[spread(self.text_start.data[slot[same]], width[same])]
        same[np.repeat(np.flatnonzero(same), width[same])[~equal]] = False
        size, at, source = self.size.data[slot], self.start.data[slot], self.ids.data
        if not same.all():      # two pieces of one name: the unknown one goes to the tokenizer by itself
            odd = np.flatnonzero(~same)
            more, many = self._tokenize([whole[i:j] for i, j in zip(start[odd].tolist(), stop[odd].tolist())])
            size[odd], at[odd] = many, len(source) + np.cumsum(many) - many
            source = np.append(source, more)
        ids = source[spread(at, size)]
        cut = np.append(0, np.cumsum(size))[np.searchsorted(start, first)]
        return [ids[i:j] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions start[i] .. start[i] + size[i] - 1 of all i on end."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)


def encoder(path: str) -> Encoder:
    if path not in _cached:
        _cached[path] = Encoder(path)
    return _cached[path]


def encode(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of each text; texts with a special token's own name go to the tokenizer whole."""
    own = encoder(path)
    odd = {i: np.array(own.tokenizer.encode(t, add_special_tokens=False).ids, np.uint16) for i, t in enumerate(texts) if SPECIAL in t}
    out = own.encode(["" if i in odd else t for i, t in enumerate(texts)])
    for i, ids in odd.items():
        out[i] = ids
    return out


def _narrow(symbols: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each symbol."""
    return symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def _slots(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One of 2^20 places for each pair of symbols."""
    slot = (first * np.uint32(2654435761)) ^ (second * np.uint32(2246822519) + np.uint32(374761393))
    return (((slot ^ (slot >> np.uint32(15))) * np.uint32(3266489917)) >> np.uint32(12)).astype(np.intp)


def compress(ids: np.ndarray, ends: np.ndarray) -> bytes:
    """A block: Re-Pair rules, their expansion lengths, the grammar's sequence, and where each document ends in it.

    Each pass counts neighbouring pairs inside documents and replaces those seen LEAST times or more, the RULES
    most frequent ones of them, by new symbols, from left to right; passes go on until no pair reaches LEAST.
    Symbols are written in as many bytes, 2 or more, as the largest one takes.
    """
    sequence, last = ids.astype(np.uint32), np.zeros(len(ids), bool)
    last[ends - 1] = True
    symbol = int(sequence.max(initial=0)) + 1
    base, left, right, levels = symbol, [], [], []
    while True:
        first, second = sequence[:-1], sequence[1:]
        slot = _slots(first, second)
        crowded = np.bincount(slot, minlength=1 << 20) >= LEAST      # a pair is no more frequent than its slot
        at = np.flatnonzero(crowded[slot] & ~last[:-1])
        slot = slot[at]
        pair = (first[at].astype(np.uint64) << np.uint64(32)) | second[at]
        ranked = np.sort(pair)
        cut = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        count = np.diff(np.append(cut, len(ranked)))
        often = np.flatnonzero(count >= LEAST)
        if not len(often):
            break
        if len(often) > RULES:
            often = np.sort(often[np.lexsort((often, -count[often]))[:RULES]])
        rules = ranked[cut[often]]
        home, own = np.full(1 << 20, -1, np.int16), _slots((rules >> np.uint64(32)).astype(np.uint32), rules.astype(np.uint32))
        home[own] = np.arange(len(rules))
        which = home[slot]
        for r in np.flatnonzero(home[own] != np.arange(len(rules))).tolist():   # another rule has its slot
            which[pair == rules[r]] = r
        found = np.flatnonzero(which >= 0)
        which = which[found]
        ok = rules[which] == pair[found]
        at, which = at[found[ok]], which[ok].astype(np.int64)
        head = np.append(True, np.diff(at) > 1)
        run = np.arange(len(at)) - np.flatnonzero(head)[np.cumsum(head) - 1]
        at, which = at[run % 2 == 0], which[run % 2 == 0]
        sequence[at] = (symbol + which).astype(np.uint32)
        keep = np.ones(len(sequence), bool)
        keep[at + 1] = False
        last[at] = last[at + 1]
        sequence, last = sequence[keep], last[keep]
        left.append((rules >> np.uint64(32)).astype(np.uint32))
        right.append(rules.astype(np.uint32))
        levels.append(len(rules))
        symbol += len(rules)
    none = np.empty(0, np.uint32)
    left, right = (np.concatenate(x) if x else none for x in (left, right))
    size = np.ones(symbol, np.uint32)
    at = base
    for n in levels:
        rows = slice(at - base, at - base + n)
        size[at:at + n] = size[left[rows]] + size[right[rows]]
        at += n
    doc_ends = np.flatnonzero(last).astype(np.uint32) + np.uint32(1)
    width = max(2, ((symbol - 1).bit_length() + 7) // 8)
    head = struct.pack("<6I", base, len(left), len(sequence), len(doc_ends), len(levels), width)
    return b"".join([head, np.array(levels, np.uint32).tobytes(), _narrow(left, width), _narrow(right, width), size[base:].tobytes(),
                     _narrow(sequence, width), doc_ends.tobytes()])


class Block:
    """A block read back; `document` expands one document only."""

    def __init__(self, data: bytes):
        self.base, rules, n, docs, levels, width = struct.unpack_from("<6I", data)
        at = 24

        def take(kind, many):
            nonlocal at
            out = np.frombuffer(data, kind, many, at)
            at += out.nbytes
            return out

        def symbols(many):
            out = np.zeros((many, 4), np.uint8)
            out[:, :width] = take(np.uint8, many * width).reshape(many, width)
            return out.view("<u4").ravel()

        levels = take(np.uint32, levels)
        left, right, sizes = symbols(rules), symbols(rules), take(np.uint32, rules)
        self.sequence, self.ends = symbols(n), take(np.uint32, docs)
        self.size = np.append(np.ones(self.base, np.int64), sizes)
        self.start = np.arange(self.base + rules)
        flat, filled, first = [np.arange(self.base, dtype=np.uint16)], self.base, 0
        for many in levels.tolist():
            pair = np.column_stack([left[first:first + many], right[first:first + many]]).ravel()
            so_far = np.concatenate(flat)
            flat = [so_far, self._expand(pair, so_far)]
            size = self.size[self.base + first:self.base + first + many]
            self.start[self.base + first:self.base + first + many] = filled + np.cumsum(size) - size
            filled += int(size.sum())
            first += many
        self.flat = np.concatenate(flat)

    def _expand(self, symbols: np.ndarray, flat: np.ndarray) -> np.ndarray:
        size = self.size[symbols]
        ends = np.cumsum(size)
        return flat[np.repeat(self.start[symbols] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def document(self, i: int) -> np.ndarray:
        return self._expand(self.sequence[self.ends[i - 1] if i else 0:self.ends[i]], self.flat)

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each document ends."""
        ends = np.cumsum(self.size[self.sequence])
        return self._expand(self.sequence, self.flat), ends[self.ends.astype(np.int64) - 1]


def write_blocks(docs: DataFrame, path: str, tokenizer: str, block: int = BLOCK) -> None:
    """Writes (part, block, before, n_ids, doc_ids, payload) rows, documents in the order of (doc_id, text hash), null ids first.

    Ranges of documents are sorted by Spark; a task streams its range and emits a block whenever `block` ids are full.
    `before` counts the ids of the part's earlier blocks.  Spark's committer keeps one attempt of each task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before = TaskContext.get().partitionId(), 0, 0
        names, held, total = [], [], 0

        def flush():
            nonlocal names, held, total, number, before
            size = np.array([len(x) for x in held])
            payload = compress(np.concatenate(held), np.cumsum(size))
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([total], pa.int64()),
                 pa.array([names], pa.list_(pa.int64())), pa.array([payload], pa.binary())], ["part", "block", "before", "n_ids", "doc_ids", "payload"])
            number, before, names, held, total = number + 1, before + total, [], [], 0
            return out

        end = np.array([END], np.uint16)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(ids):
                to, chars = at, 0
                while to < len(ids) and (to == at or chars + len(texts[to]) <= CHUNK):
                    chars += len(texts[to])
                    to += 1
                for name, found in zip(ids[at:to], encode(texts[at:to], tokenizer)):
                    names.append(name)
                    held.append(np.append(found, end))
                    total += len(found) + 1
                    if total >= block:
                        yield flush()
                at = to
        if held:
            yield flush()

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    rows.mapInArrow(run, "part int, block int, before bigint, n_ids bigint, doc_ids array<bigint>, payload binary").write.parquet(path)


def read_blocks(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the blocks, from their decoded ids.

    Only the totals of parts, one row for each writing task, are summed in order and broadcast.
    """
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored(parts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first")), "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, ends = Block(batch.column(2)[i].as_py()).documents()
                wide = ids.astype("<u4")
                first = np.append(0, ends[:-1])
                start = batch.column(0)[i].as_py() + first
                crc = [zlib.crc32(wide[a:b].tobytes()) for a, b in zip(first.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1)[i].values.cast(pa.int64()), pa.array(start, pa.int64()), pa.array(ends - first, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = blocks.join(F.broadcast(parts), "part").select((F.col("first") + F.col("before")).alias("first"), "doc_ids", "payload")
    return placed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
