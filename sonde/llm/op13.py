"""Fill-in-middle: texts cut at two random units and reordered around sentinels.

A unit is a run of ASCII letters or any other code point.  The bytes that end a unit are found eight at a time:
UTF-8 is viewed as 64-bit words, letters and continuation bytes are marked in each byte's high bit by carry-free
sums, and a byte ends a unit where the next byte's mark says so.  Bit counts of the words, summed up, lead from a
unit's number to its word; the bit inside the word is found by clearing lower ones.

Cuts and form follow from the id alone (`1:` and its decimal digits; a null id has none, so its digits are empty),
so repeated rows come out alike and rows of one id draw the same numbers.  Null reads as the empty text, which stays
plain.  Texts are whole; the arrays of a batch take some five bytes a byte of text.  Other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonde.llm.textvec import chunks, utf8

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_OF, SPM_OF = 90, 20        # h3 % 100 from 90 on: plain; h4 % 100 under 20: suffix first
SEED = "1:"
FEED = 4 << 20                   # bytes marked at once; a longer text goes by itself

_HIGH, _LOW = np.uint64(0x8080808080808080), np.uint64(0x7F7F7F7F7F7F7F7F)
_CASE, _FROM_A, _PAST_Z = np.uint64(0x2020202020202020), np.uint64(0x1F1F1F1F1F1F1F1F), np.uint64(0x0505050505050505)
_one, _byte, _top = np.uint64(1), np.uint64(8), np.uint64(56)


def words_of(data: np.ndarray) -> np.ndarray:
    """Bytes as little-endian 64-bit words, filled up with zeros, and one word more."""
    out = np.zeros(len(data) // 8 * 8 + 16, np.uint8)
    out[:len(data)] = data
    return out.view("<u8")


def letters(words: np.ndarray) -> np.ndarray:
    """High bits of the bytes that are A-Z or a-z: seven-bit sums that pass 128 from `a` on, and after `z`."""
    folded = (words | _CASE) & _LOW
    return (folded + _FROM_A) & ~(folded + _PAST_Z) & ~words & _HIGH


def inner(words: np.ndarray) -> np.ndarray:
    """High bits of continuation bytes: bit 7 set, bit 6 clear."""
    return words & ~(words << _one) & _HIGH


class Marks:
    """Marked bytes of a buffer, with counts up to each word."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.upto = np.append(0, np.cumsum(np.bitwise_count(bits), dtype=np.int64))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many marked bytes stand before byte `at`."""
        word, bit = at >> 3, ((at & 7) * 8).astype(np.uint64)
        return self.upto[word] + np.bitwise_count(self.bits[word] & ((_one << bit) - _one)).astype(np.int64)

    def select(self, number: np.ndarray) -> np.ndarray:
        """The byte that is marked as the number-th, from 0."""
        word = np.searchsorted(self.upto, number, "right") - 1
        left, bits = number - self.upto[word], self.bits[word]
        for _ in range(7):
            more = left > 0
            if not more.any():
                break
            bits = np.where(more, bits & (bits - _one), bits)
            left = left - more
        return word * 8 + (np.bitwise_count((bits & (~bits + _one)) - _one) >> 3)


def units(data: np.ndarray, ends: np.ndarray) -> tuple[Marks, Marks]:
    """Unit-ending bytes and first bytes of code points, of the texts data[ends[i]:ends[i + 1]] with ends[0] = 0."""
    words = words_of(data)
    letter, tail = letters(words), inner(words)

    def following(mark: np.ndarray) -> np.ndarray:
        return (mark >> _byte) | (np.append(mark[1:], np.uint64(0)) << _top)

    ending = ((letter & ~following(letter)) | (~letter & ~following(tail))) & _HIGH
    last = ends[1:][np.diff(ends) > 0] - 1
    np.bitwise_or.at(ending, last >> 3, np.uint64(0x80) << ((last & 7) * 8).astype(np.uint64))
    first = ~tail & _HIGH
    if len(data) % 8:        # the filling is no text
        keep = (_one << np.uint64(len(data) % 8 * 8)) - _one
        ending[len(data) // 8] &= keep
        first[len(data) // 8] &= keep
    ending[len(data) // 8 + (len(data) % 8 > 0):] = first[len(data) // 8 + (len(data) % 8 > 0):] = 0
    return Marks(ending), Marks(first)


def draws(ids: list[int | None]) -> np.ndarray:
    """h1 to h4 of each id."""
    raw = b"".join(hashlib.sha256(f"{SEED}{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(raw, ">u4").reshape(-1, 4).astype(np.int64)


def cut(data: np.ndarray, ends: np.ndarray, ids: list[int | None]) -> tuple[list, ...]:
    """n, form, prefix_chars, middle_chars and output of each text."""
    end, first = units(data, ends)
    h = draws(ids)
    base, top = end.rank(ends[:-1]), end.rank(ends[1:])
    n = top - base
    few, many = np.sort(h[:, :2] % (n + 1)[:, None], axis=1).T
    at = []
    for k in (few, many):
        border = ends[:-1].copy()
        some = np.flatnonzero(k)
        border[some] = end.select(base[some] + k[some] - 1) + 1
        at.append(border)
    prefix_chars = first.rank(at[0]) - first.rank(ends[:-1])
    middle_chars = first.rank(at[1]) - first.rank(at[0])
    raw, form, output = data.tobytes(), [], []
    for i, (a, x, y, b) in enumerate(zip(ends[:-1].tolist(), at[0].tolist(), at[1].tolist(), ends[1:].tolist())):
        whole = raw[a:b]
        if not whole or h[i, 2] % 100 >= PLAIN_OF or any(s.encode() in whole for s in (PREFIX, SUFFIX, MIDDLE)):
            form.append("plain")
            output.append(whole.decode())
            continue
        prefix, middle, suffix = (raw[p:q].decode() for p, q in ((a, x), (x, y), (y, b)))
        form.append("spm" if h[i, 3] % 100 < SPM_OF else "psm")
        output.append(f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}" if form[-1] == "psm" else f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}")
    drop = np.array([f == "plain" for f in form], bool)
    return n.tolist(), form, pa.array(prefix_chars, pa.int64(), mask=drop), pa.array(middle_chars, pa.int64(), mask=drop), output


def transform(docs: DataFrame) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = utf8(batch.column(1))
            ids = batch.column(0).to_pylist()
            for i, j in chunks(ends, FEED):
                n, form, prefix, middle, output = cut(data[ends[i]:ends[j]], ends[i:j + 1] - ends[i], ids[i:j])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], pa.array(n, pa.int64()), pa.array(form, pa.string()), prefix, middle, pa.array(output, pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(made: DataFrame) -> DataFrame:
    """The rows of `transform` with `restored`, the text rebuilt from output and form alone."""
    at = {s: F.instr("output", s) for s in (PREFIX, SUFFIX, MIDDLE)}

    def between(a: str, b: str | None):
        start = at[a] + 3
        return F.substring("output", start, at[b] - start if b else F.char_length("output"))

    return made.withColumn("restored", F.when(F.col("form") == "plain", F.col("output"))
                           .when(F.col("form") == "psm", F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE)))
                           .otherwise(F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))))


def digest(made: DataFrame) -> DataFrame:
    return restored(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                                 F.sha2("restored", 256).alias("restored_sha256"))
