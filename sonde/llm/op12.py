"""Alignment of two tokenizers: shared cuts, links of overlapping tokens, and corpus-wide counts of linked id pairs.

Both tokenizers read a space and the text.  Byte offsets where tokens of both end cut them into groups; each stretch
between neighbouring ends of either side belongs to one token of each, and these are the links.

Counts of id pairs are dense vectors.  The distinct pairs are dealt into hash buckets, each bucket becomes a minimal
perfect hash (levels of bits: a key stands on the first level where it is alone on its bit, and its number is the
count of bits before it), and each task adds up its links in a vector by these numbers, after comparing the key kept
under the number.  Vectors are summed as a tree, 16 at a time, in parts of 65,536 counts.  A second pass aligns the
documents again, from their stored ids, and looks counts up.  Hashes and vectors are broadcast in slices of at most
PAIRS pairs; more pairs take more passes, never a larger broadcast.  A vector is not written for every split: splits
are joined until a task's ids outweigh its vector 16 times, or one task a core is left.

Null and empty texts, and texts whose tokens do not spell a space and the text (those with U+2581, which the second
tokenizer writes for a space), have no tokens: zeros and ''.  Repeated rows count as often as they stand.  Ids may be
null.  One text is aligned by itself, in some 150 bytes a byte of text.
"""

from __future__ import annotations

import gc
import hashlib
import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonde.llm.common import stored
from sonde.llm.op11 import Merges, Transducer, compile_merges
from sonde.llm.pretoken import tokenizers_kinds
from sonde.llm.textvec import chunks, mix, utf8

CHUNK = 1 << 18               # bytes aligned at once; a longer text goes by itself
PAIRS = 8_000_000             # pairs of a slice: at most so many keys, and counts, are broadcast at once
BUCKET = 50_000               # pairs of a hash bucket, about
CELLS = 1 << 16               # hash cells that buckets are made of
HELD = 2_000_000              # distinct pairs a task holds before it gives them out
PART, FAN = 1 << 16, 16       # counts of a vector's part; vectors summed at once
GAMMA = 2                     # bits of a level for each of its keys
OUTWEIGH = 16
BLANK = "▁"
_cached: dict[bytes, tuple[Sizes, Sizes, Transducer, Transducer]] = {}


class Pieces(NamedTuple):
    """A tokenizer's vocabulary as bytes, its merges, and the ids that single bytes fall back to (none: -1)."""
    merges: Merges
    bytes_of: list[bytes]
    fallback: np.ndarray

    def single(self) -> np.ndarray:
        """By code point: whether it is a token."""
        out = np.zeros(0x110000, bool)
        out[[ord(t.decode()) for t, a in zip(self.merges.tokens, self.merges.left) if t and a < 0]] = True
        return out


def byte_level(file: bytes) -> Pieces:
    """Of a tokenizer file whose entries spell bytes by printable characters.  Special tokens are left out."""
    model = json.loads(file)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]      # bytes that stand for themselves
    spelled = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    special = {token["content"] for token in model["added_tokens"]}
    vocabulary, merges = model["model"]["vocab"], model["model"]["merges"]
    tokens = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        if token not in special:
            tokens[i] = bytes(spelled[c] for c in token)
    left, right, before = [-1] * len(tokens), [-1] * len(tokens), -1
    for merge in merges:
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        made = vocabulary[a + b]
        if made <= before:
            raise ValueError("ids are not in the order of the merges")
        left[made], right[made], before = vocabulary[a], vocabulary[b], made
    return Pieces(Merges(tokens, list(range(len(tokens))), left, right, strict=True), tokens, np.full(256, -1, np.int32))


def sentence_pieces(file: bytes) -> Pieces:
    """Of a BPE model that escapes spaces, adds one in front, changes nothing else, and falls back to bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=file)
    tokens, bytes_of, rank, fallback = [], [], [], np.full(256, -1, np.int32)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        plain = not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        if model.is_byte(i):
            fallback[int(piece[1:-1], 16)] = i
        tokens.append(piece.replace(BLANK, " ").encode() if plain else b"")
        bytes_of.append(bytes([int(piece[1:-1], 16)]) if model.is_byte(i) else tokens[-1])
        rank.append(-model.get_score(i))
        if " " in tokens[-1].lstrip(b" ").decode():
            raise ValueError("a piece goes on after a space")
    if (fallback < 0).any() or model.encode("a  b", out_type=str)[:1] != [f"{BLANK}a"]:
        raise ValueError("the model has no byte fallback, or adds no space in front")
    return Pieces(compile_merges(tokens, rank, characters=True), bytes_of, fallback)


class Sizes(NamedTuple):
    """What alignment needs of a vocabulary: bytes of each id, and its decimal digits."""
    size: np.ndarray
    digits: np.ndarray
    width: np.ndarray


def _sizes(pieces: Pieces) -> Sizes:
    names = [str(i).encode() for i in range(len(pieces.bytes_of))]
    width = np.fromiter(map(len, names), np.int64, len(names))
    digits = np.frombuffer(b"".join(name.ljust(7) for name in names), np.uint8).reshape(-1, 7)
    return Sizes(np.fromiter(map(len, pieces.bytes_of), np.int64, len(names)), digits, width)


def machines(first: Pieces, second: Pieces) -> tuple[Sizes, Sizes, Transducer, Transducer]:
    """Built once in a worker."""
    name = hashlib.sha256(b"\0".join([*first.bytes_of, *second.bytes_of])).digest()
    if name not in _cached:
        _cached.clear()
        _cached[name] = (_sizes(first), _sizes(second), Transducer(first.merges, tokenizers_kinds()), Transducer(second.merges, tokenizers_kinds()))
    return _cached[name]


def encode_pieces(own: Transducer, single: np.ndarray, fallback: np.ndarray, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts data[ends[i]:ends[i + 1]], ends[0] = 0, and where each text's ids start.

    No piece goes on over a space after another character, so texts are cut there; characters that are no `single`
    pieces become their bytes and cut too.
    """
    if not len(data):
        return np.empty(0, np.int32), np.zeros(len(ends), np.int64)
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    known = single[codes]
    cut = np.zeros(len(codes), bool)
    cut[np.searchsorted(heads, ends[:-1][np.diff(ends) > 0])] = True
    cut[1:] |= (codes[1:] == 32) & (codes[:-1] != 32) | ~known[:-1]
    keep = np.repeat(known, np.diff(np.append(heads, len(data))))
    place = np.cumsum(keep) - keep
    ids, given = own.walk(data[keep], place[heads[cut & known]]) if keep.any() else (np.empty(0, np.int32), np.empty(0, np.int64))
    many = np.ones(len(data), np.int64)
    many[keep] = given
    out = np.empty(int(many.sum()), np.int32)
    merged = np.repeat(keep, many)
    out[merged], out[~merged] = ids, fallback[data[~keep]]
    return out, np.append(0, np.cumsum(many))[ends]


def spaced(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that get tokens, each after a space; the others have no bytes."""
    data, ends = data[ends[0]:ends[-1]], ends - ends[0]
    blank = np.frombuffer(BLANK.encode(), np.uint8)
    at = np.flatnonzero((data[:-2] == blank[0]) & (data[1:-1] == blank[1]) & (data[2:] == blank[2])) if len(data) > 2 else np.empty(0, np.int64)
    bad = np.zeros(len(ends) - 1, bool)
    bad[np.searchsorted(ends, at, "right") - 1] = True
    size = np.where(bad, 0, np.diff(ends))
    out = np.insert(data[np.repeat(~bad, np.diff(ends))], (np.cumsum(size) - size)[size > 0], 32)
    return out, np.append(0, np.cumsum(size + (size > 0)))


class Aligned(NamedTuple):
    """Links of documents on end: ids of both sides, and each document's first link, token and group (totals last)."""
    a: np.ndarray
    b: np.ndarray
    links: np.ndarray
    groups: np.ndarray
    shared: np.ndarray     # byte ends that both sides have


def align(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, first_a: np.ndarray) -> Aligned:
    """Both sides of documents whose tokens of the first side start at `first_a`, and spell the same bytes as the second's."""
    end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    total = int(end_a[-1]) if len(end_a) else 0
    on_a, on_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
    on_a[end_a], on_b[end_b] = True, True
    ends = np.flatnonzero(on_a | on_b)
    both = on_a & on_b
    of_a = np.cumsum(on_a)[ends] - on_a[ends]
    of_b = np.cumsum(on_b)[ends] - on_b[ends]
    border = np.append(0, end_a)[first_a]      # bytes before each document
    shared = np.flatnonzero(both)
    return Aligned(a[of_a], b[of_b], np.searchsorted(ends, border, "right"), np.searchsorted(shared, border, "right"), shared)


def spelled(a: np.ndarray, b: np.ndarray, left: Sizes, right: Sizes, found: Aligned) -> tuple[np.ndarray, np.ndarray]:
    """`a1,a2|b1;a3|b2,b3;` of all documents on end, and where each document's part starts."""
    last_a = np.searchsorted(np.cumsum(left.size[a]), found.shared)        # a group's last token
    last_b = np.searchsorted(np.cumsum(right.size[b]), found.shared)
    group_a, group_b = np.searchsorted(last_a, np.arange(len(a))), np.searchsorted(last_b, np.arange(len(b)))
    at_a = np.arange(len(a)) + np.append(0, last_b + 1)[group_a]
    at_b = np.arange(len(b)) + (last_a + 1)[group_b]
    n = len(a) + len(b)
    digits, width, mark = np.empty((n, 7), np.uint8), np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    digits[at_a], digits[at_b], width[at_a], width[at_b] = left.digits[a], right.digits[b], left.width[a], right.width[b]
    mark[at_a[last_a]], mark[at_b[last_b]] = ord("|"), ord(";")
    digits[np.arange(n), width] = mark
    flat = digits[np.arange(7) <= width[:, None]]
    ends = np.append(0, np.cumsum(width + 1))
    return flat, ends[np.append(0, last_a + last_b + 2)[found.groups]]


_ENCODED = "doc_id bigint, a binary, b binary, n_groups bigint, n_links bigint, groups_sha256 string"


def encode(docs: DataFrame, first: Broadcast, second: Broadcast) -> DataFrame:
    """doc_id, the ids of both sides (binary, 2 bytes each, or 4 in large vocabularies), n_groups, n_links and groups_sha256 of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, own_a, own_b = machines(first.value, second.value)
        fallback, single = second.value.fallback, second.value.single()
        for batch in batches:
            whole, bounds = utf8(batch.column(1))
            for i, j in chunks(bounds, CHUNK):
                data, ends = spaced(whole, bounds[i:j + 1])
                a, at_a = own_a.encode(data, ends)
                b, at_b = encode_pieces(own_b, single, fallback, data, ends)
                found = align(a, b, left.size, right.size, at_a)
                text, at = spelled(a, b, left, right, found)
                text = text.tobytes()
                digest = [hashlib.sha256(text[x:y - 1]).hexdigest() if y > x else "" for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                raw = [pa.array([ids[x:y].tobytes() for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())], pa.binary())
                       for ids, cut in ((a.astype(_kind(left.size)), at_a), (b.astype(_kind(right.size)), at_b))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], *raw, pa.array(np.diff(found.groups), pa.int64()), pa.array(np.diff(found.links), pa.int64()),
                     pa.array(digest, pa.string())], ["doc_id", "a", "b", "n_groups", "n_links", "groups_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, _ENCODED)


def _kind(size: np.ndarray) -> str:
    """How ids of a vocabulary of so many are stored."""
    return "<u2" if len(size) <= 1 << 16 else "<u4"


def forget() -> None:
    """A worker that goes on to count needs no machines."""
    if _cached:
        _cached.clear()
        gc.collect()


def _realigned(batch: pa.RecordBatch, size_a: np.ndarray, size_b: np.ndarray) -> Iterator[tuple[int, int, Aligned]]:
    """Rows i to j of stored ids (columns a and b), aligned anew."""
    (raw_a, at_a), (raw_b, at_b) = utf8(batch.column("a")), utf8(batch.column("b"))
    for i, j in chunks(at_a, CHUNK):
        a, b = (np.ascontiguousarray(raw[at[i]:at[j]]).view(_kind(size)) for raw, at, size in ((raw_a, at_a, size_a), (raw_b, at_b, size_b)))
        yield i, j, align(a, b, size_a, size_b, (at_a[i:j + 1] - at_a[i]) // a.itemsize)


def _cell(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) >> np.uint64(48)).astype(np.int32)


def _level(keys: np.ndarray, level: int, bits: np.ndarray) -> np.ndarray:
    """Bit of each key on a level of so many bits."""
    return (mix(keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)) % bits.astype(np.uint64)).astype(np.int64)


def distinct_pairs(encoded: DataFrame, size_a: np.ndarray, size_b: np.ndarray) -> DataFrame:
    """(key, cell) of each pair of linked ids; key is a * ids of the second side + b."""
    many = len(size_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held, fresh, size = np.empty(0, np.int64), [], 0

        def give() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(_cell(held), pa.int32())], ["key", "cell"])

        for batch in batches:
            for _, _, found in _realigned(batch, size_a, size_b):
                fresh.append(np.unique(found.a.astype(np.int64) * many + found.b))
                size += len(fresh[-1])
                if size >= HELD:
                    held, fresh, size = np.unique(np.concatenate([held, *fresh])), [], 0
                    if len(held) >= HELD:
                        yield give()
                        held = held[:0]
        held = np.unique(np.concatenate([held, *fresh]))
        yield give()

    return encoded.select("a", "b").mapInArrow(run, "key bigint, cell int").distinct()


_BUCKETS = "bucket int, n int, sizes array<int>, bits binary, keys binary"


def build_hashes(pairs: DataFrame, buckets: int) -> DataFrame:
    """A bucket's minimal perfect hash: bits of its levels, set bits on end, and the key of each set bit in order."""
    def build(table: pa.Table) -> pa.Table:
        left, sizes, words, keys = table["key"].to_numpy(), [], [], []
        while len(left):
            bits = -(-GAMMA * len(left) // 64) * 64
            at = _level(left, len(sizes), np.array([bits]))
            alone = np.bincount(at, minlength=bits) == 1
            stays = alone[at]
            words.append(np.packbits(alone, bitorder="little"))
            keys.append(left[stays][np.argsort(at[stays])])
            sizes.append(bits)
            left = left[~stays]
        n = table.num_rows
        return pa.table({"bucket": pa.array([table["bucket"][0].as_py()], pa.int32()), "n": pa.array([n], pa.int32()), "sizes": pa.array([sizes], pa.list_(pa.int32())),
                         "bits": pa.array([np.concatenate(words).tobytes()], pa.binary()), "keys": pa.array([np.concatenate(keys).tobytes()], pa.binary())})

    dealt = pairs.withColumn("bucket", F.shiftright(F.col("cell").cast("long") * buckets, 16).cast("int"))
    return dealt.groupBy("bucket").applyInArrow(build, _BUCKETS)


class PairHash:
    """The hashes of a slice of buckets; `find` gives a key's number, or -1 where the key kept there is another."""

    def __init__(self, rows: pa.Table, buckets: int):
        rows = rows.sort_by("bucket")
        names, sizes = rows["bucket"].to_numpy(), rows["sizes"].to_pylist()
        self.buckets, self.levels = buckets, max(map(len, sizes), default=0)
        self.row = np.full(buckets, -1, np.int64)
        self.row[names] = np.arange(len(names))
        self.size = np.zeros((len(names), self.levels), np.int64)
        for i, some in enumerate(sizes):
            self.size[i, :len(some)] = some
        ends = np.cumsum(self.size.ravel())
        self.first = (ends - self.size.ravel()).reshape(self.size.shape)
        self.words = np.frombuffer(b"".join(rows["bits"].to_pylist()), "<u8")
        self.keys = np.frombuffer(b"".join(rows["keys"].to_pylist()), np.int64)
        self.upto = np.append(0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        row = self.row[(_cell(keys).astype(np.int64) * self.buckets) >> 16]
        left = np.flatnonzero(row >= 0)
        for level in range(self.levels):
            left = left[self.size[row[left], level] > 0]
            if not len(left):
                break
            at = self.first[row[left], level] + _level(keys[left], level, self.size[row[left], level])
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = ((word >> bit) & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            slot = self.upto[at >> 6] + below.astype(np.int64)
            right = hit.copy()
            right[hit] = self.keys[slot[hit]] == keys[left[hit]]
            out[left[right]] = slot[right]
            left = left[~hit]
        return out


def _narrow(counts: np.ndarray) -> bytes:
    """A byte that names the width, and the counts in it."""
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if int(counts.max(initial=0)) <= np.iinfo(k).max)
    return bytes([int(kind[-1])]) + counts.astype(kind).tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def count_vectors(encoded: DataFrame, size_a: np.ndarray, size_b: np.ndarray, hashes: Broadcast) -> DataFrame:
    """(part, task, counts): each task's links by the numbers of their pairs."""
    many = len(size_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        own = hashes.value
        total = np.zeros(len(own.keys), np.int64)
        for batch in batches:
            for _, _, found in _realigned(batch, size_a, size_b):
                keys, seen = np.unique(found.a.astype(np.int64) * many + found.b, return_counts=True)
                slot = own.find(keys)
                total[slot[slot >= 0]] += seen[slot >= 0]
        task = TaskContext.get().partitionId()
        for part in range(-(-len(total) // PART)):
            counts = total[part * PART:(part + 1) * PART]
            if counts.any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([task], pa.int32()), pa.array([_narrow(counts)], pa.binary())],
                                                 ["part", "task", "counts"])

    return encoded.select("a", "b").mapInArrow(run, "part int, task int, counts binary")


def tree_sum(vectors: DataFrame, tasks: int) -> DataFrame:
    """(part, counts): vectors of the same part added up, FAN at a time."""
    def add(table: pa.Table) -> pa.Table:
        total = 0
        for raw in table["counts"]:
            total = total + _wide(raw.as_py())
        return pa.table({"part": table["part"][:1], "task": pa.array([table["task"][0].as_py() // FAN], pa.int32()), "counts": pa.array([_narrow(total)], pa.binary())})

    while tasks > 1:
        vectors = vectors.groupBy("part", F.floor(F.col("task") / FAN)).applyInArrow(lambda _, table: add(table), "part int, task int, counts binary")
        tasks = -(-tasks // FAN)
    return vectors.select("part", "counts")


def look_up(rows: DataFrame, size_a: np.ndarray, size_b: np.ndarray, hashes: Broadcast, counts: Broadcast, best: np.ndarray) -> DataFrame:
    """`rows` with the slice's pairs added to n_best and count_sum."""
    many = len(size_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        own, count = hashes.value, counts.value
        for batch in batches:
            for i, j, found in _realigned(batch, size_a, size_b):
                keys, back = np.unique(found.a.astype(np.int64) * many + found.b, return_inverse=True)
                slot = own.find(keys)
                mine = slot >= 0
                value = np.zeros(len(keys), np.int64)
                value[mine] = count[slot[mine]]
                top = mine & (value == best[keys % many])
                sums = [np.append(0, np.cumsum(x[back], dtype=np.int64)) for x in (top, value)]
                part = batch.slice(i, j - i)
                gained = [pa.array(part.column(name).to_numpy() + np.diff(x[found.links])) for name, x in zip(("n_best", "count_sum"), sums)]
                yield pa.RecordBatch.from_arrays([*(part.column(name) for name in _KEPT), *gained], [*_KEPT, "n_best", "count_sum"])

    return rows.mapInArrow(run, _ENCODED + ", n_best bigint, count_sum bigint")


_KEPT = ["doc_id", "a", "b", "n_groups", "n_links", "groups_sha256"]


def align_documents(docs: DataFrame, first: Pieces, second: Pieces) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and the ids a and b, of each row."""
    spark = docs.sparkSession
    context = spark.sparkContext
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")      # rows hold whole documents' ids
    size_a, size_b = (np.fromiter(map(len, p.bytes_of), np.int64, len(p.bytes_of)) for p in (first, second))
    encoded = stored(encode(docs, context.broadcast(first), context.broadcast(second)), "aligned")
    pairs = stored(distinct_pairs(encoded, size_a, size_b), "pairs")
    n = pairs.count()
    buckets = min(CELLS, max(1, -(-n // BUCKET)))
    built = stored(build_hashes(pairs, buckets), "hashes")
    slices = max(1, -(-n // PAIRS))
    bytes_held = encoded.agg(F.sum(F.length("a") + F.length("b"))).first()[0] or 0
    fewer = encoded.coalesce(max(context.defaultParallelism, int(bytes_held // (OUTWEIGH * 8 * min(n, PAIRS) + 1))))
    tasks = fewer.rdd.getNumPartitions()

    def hashes(k: int) -> PairHash:
        low, high = k * buckets // slices, (k + 1) * buckets // slices
        return PairHash(built.where((F.col("bucket") >= low) & (F.col("bucket") < high)).toArrow(), buckets)

    best, summed = np.zeros(len(size_b), np.int64), []

    def totals(k: int, keys: int) -> np.ndarray:
        out = np.zeros(keys, np.int64)
        for row in summed[k].toArrow().to_pylist():
            counts = _wide(row["counts"])
            out[row["part"] * PART:row["part"] * PART + len(counts)] = counts
        return out

    for k in range(slices):
        own = hashes(k)
        shared = context.broadcast(own)
        summed.append(stored(tree_sum(count_vectors(fewer, size_a, size_b, shared), tasks), "counts"))
        np.maximum.at(best, own.keys % len(size_b), totals(k, len(own.keys)))
        shared.unpersist()
    rows = encoded.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for k in range(slices):
        own = hashes(k)
        rows = look_up(rows, size_a, size_b, context.broadcast(own), context.broadcast(totals(k, len(own.keys))), best)
        rows = stored(rows, "counted") if k + 1 < slices else rows
    ids = {f"n_{side}": (F.length(side) / np.dtype(_kind(size)).itemsize).cast("long") for side, size in (("a", size_a), ("b", size_b))}
    return rows.withColumns(ids).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "a", "b")
