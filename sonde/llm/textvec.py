"""Vectorised text helpers: whole Arrow batches as bytes, word names, k-word shingles.

Names of words are 64 bits: eight bytes at a time go through a mixing step that is no sum or product of the
bytes, and long words through BLAKE2.  (A polynomial modulo 2^64 gives some different words one name, whatever
its base.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
LONG = 256               # bytes of a long word
_BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)

ALNUM = np.array([48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b > 127 for b in range(256)])
UNSPACED = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b < 91 else b for b in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse, up to the n-th."""
    global _powers, _inverse
    if len(_powers) <= n:
        size = max(n + 1, CHUNK + 1)
        step, back = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 2**64), np.uint64)
        step[0] = back[0] = 1
        _powers, _inverse = np.cumprod(step), np.cumprod(back)
    return _powers[:n + 1], _inverse[:n + 1]


def sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial: entry i covers the first i bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * powers(len(data))[0][:len(data)], out=out[1:])
    return out


def names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit names of the strings data[start:end]."""
    size = end - start
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    name = mix(size.astype(np.uint64) * np.uint64(_BASE) + np.uint64(1))
    left, at = np.flatnonzero(size <= LONG), 0
    while len(left):
        rest = size[left] - at
        part = eight[start[left] + at]
        short = np.flatnonzero(rest < 8)
        part[short] &= (np.uint64(1) << (8 * rest[short]).astype(np.uint64)) - np.uint64(1)
        name[left] = mix(name[left] ^ part) * np.uint64(_BASE)
        left, at = left[rest > 8], at + 8
    for i in np.flatnonzero(size > LONG).tolist():
        name[i] = int.from_bytes(hashlib.blake2b(data[start[i]:end[i]].tobytes(), digest_size=8).digest(), "little")
    return name


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, wide)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8), ends


def chunks(ends: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `most` bytes; a longer document stands alone."""
    at, n = 0, len(ends) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = to


class Words(NamedTuple):
    marks: np.ndarray  # fingerprint of each word
    start: np.ndarray  # its first byte
    end: np.ndarray
    first: np.ndarray  # index of each document's first word, and the number of words


def words(data: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> Words:
    """Words of documents data[ends[i]:ends[i + 1]], A-Z read as a-z; offsets count from ends[0]."""
    data, ends = LOWER[data[ends[0]:ends[-1]]], ends - ends[0]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[ends] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return Words(names(data, start, end), start, end, np.searchsorted(start, ends))


def grams(marks: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of every k consecutive words, over document borders too."""
    n = len(marks) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(_BASE) + marks[j:j + n]
    return mix(out + np.uint64(k))


def owners(first: np.ndarray) -> np.ndarray:
    """Document index of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingle_sets(data: np.ndarray, ends: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles: (document index, fingerprint), sorted; a shorter text is one shingle."""
    found = words(data, ends, UNSPACED)
    count = np.diff(found.first)
    doc = owners(found.first)
    marks = grams(found.marks, k)
    whole = doc[:len(marks)] == doc[k - 1:] if len(marks) else np.empty(0, bool)
    doc_ids, values = doc[:len(marks)][whole], marks[whole]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        one = np.array([int(grams(found.marks[found.first[i]:found.first[i + 1]], int(count[i]))[0]) for i in short], np.uint64)
        doc_ids, values = np.concatenate([doc_ids, short]), np.concatenate([values, one])
    order = np.lexsort((values, doc_ids))
    doc_ids, values = doc_ids[order], values[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (doc_ids[1:] != doc_ids[:-1])
    return doc_ids[keep], values[keep]
