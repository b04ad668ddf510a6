"""Benchmark decontamination: prefix-filtered containment join of item windows with documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonde.llm.common import stored
from sonde.llm.textvec import ALNUM, chunks, grams, owners, utf8, words

WINDOW = 10           # words of a window
TOKEN = 3             # words of a shingle, the tokens of the join
SLICE_WINDOWS = 500_000   # windows in one broadcast; a larger benchmark takes several passes
_BITS = 1 << 22


class Windows:
    """Windows of some items: word fingerprints, lengths and items; tokens of each as (window, offset, fingerprint)."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        data, ends = utf8(pa.array(texts, pa.string()))
        found = words(data, ends, ALNUM)
        count = np.diff(found.first)
        size = np.minimum(count, WINDOW)
        many = np.where(count > 0, count - size + 1, 0)
        item = np.repeat(np.arange(len(ids)), many)
        start = found.first[item] + np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
        self.size = size[item]
        self.item = np.array(ids, np.int64)[item]
        self.marks = np.zeros((len(item), WINDOW), np.uint64)
        for j in range(WINDOW):
            has = j < self.size
            self.marks[has, j] = found.marks[start[has] + j]
        _, keep = np.unique(np.column_stack([self.marks, self.size.astype(np.uint64), self.item.astype(np.uint64)]), axis=0, return_index=True)
        self.size, self.item, self.marks = self.size[keep], self.item[keep], self.marks[keep]
        window, offset, token = [], [], []
        for k in range(1, TOKEN + 1):  # windows shorter than a shingle are one shorter shingle
            rows = np.flatnonzero(self.size == k if k < TOKEN else self.size >= TOKEN)
            for at in range(WINDOW - k + 1):
                has = rows[self.size[rows] >= at + k]
                if len(has):
                    window.append(has)
                    offset.append(np.full(len(has), at))
                    token.append(np.array([grams(m, k)[0] for m in self.marks[has, at:at + k]], np.uint64))
        self.window, self.offset = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (window, offset))
        self.token = np.concatenate(token) if token else np.empty(0, np.uint64)

    def prefix(self, counts: dict[int, int]) -> None:
        """Keep each window's rarest token: a text that holds the window must hold that one too."""
        freq = np.array([counts.get(t, 0) for t in self.token.tolist()], np.int64)
        order = np.lexsort((self.token, freq, self.window))
        first = np.ones(len(order), bool)
        first[1:] = self.window[order][1:] != self.window[order][:-1]
        keep = order[first]
        keep = keep[np.argsort(self.token[keep], kind="stable")]
        self.window, self.offset, self.token = self.window[keep], self.offset[keep], self.token[keep]


def _filter(tokens: np.ndarray) -> np.ndarray:
    bits = np.zeros(_BITS, bool)
    bits[tokens & np.uint64(_BITS - 1)] = True
    return bits


def _tokens(found) -> Iterator[tuple[int, np.ndarray]]:
    for k in range(1, TOKEN + 1):
        yield k, grams(found.marks, k)


def _counts(docs: DataFrame, tokens: np.ndarray) -> dict[int, int]:
    """How often each of these tokens stands in the documents, shingles over a document's end included."""
    shared = docs.sparkSession.sparkContext.broadcast(np.unique(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = shared.value
        bits, total = _filter(want), np.zeros(len(want), np.int64)
        for batch in batches:
            data, ends = utf8(batch.column(0))
            for a, b in chunks(ends):
                for _, marks in _tokens(words(data, ends[a:b + 1], ALNUM)):
                    marks = marks[bits[marks & np.uint64(_BITS - 1)]]
                    at = np.minimum(np.searchsorted(want, marks), len(want) - 1)
                    total += np.bincount(at[want[at] == marks], minlength=len(want))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(want[some].view(np.int64)), pa.array(total[some])], ["token", "n"])

    got = docs.select("text").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(got.column(0).to_numpy().view(np.uint64).tolist(), got.column(1).to_pylist()))


def _matches(found, model: Windows, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence of a window in these documents."""
    starts, kept = [], []
    doc_of = owners(found.first)
    for k, marks in _tokens(found):
        at = np.flatnonzero(bits[marks & np.uint64(_BITS - 1)]) if len(marks) else np.empty(0, np.int64)
        low = np.searchsorted(model.token, marks[at], "left")
        many = np.searchsorted(model.token, marks[at], "right") - low
        pos = np.repeat(at, many)
        row = np.repeat(low, many) + np.arange(len(pos)) - np.repeat(np.cumsum(many) - many, many)
        win, start = model.window[row], pos - model.offset[row]
        size = model.size[win]
        # Length and positional bounds: the whole window lies inside the document of its token.
        ok = (np.minimum(size, TOKEN) == k) & (start >= 0) & (start + size <= len(doc_of))
        win, start, size, pos = win[ok], start[ok], size[ok], pos[ok]
        ok = (doc_of[start] == doc_of[pos]) & (doc_of[start + size - 1] == doc_of[pos])
        win, start, size = win[ok], start[ok], size[ok]
        for j in range(WINDOW):
            ok = (j >= size) | (found.marks[np.minimum(start + j, len(doc_of) - 1)] == model.marks[win, j])
            win, start, size = win[ok], start[ok], size[ok]
        starts.append(start)
        kept.append(win)
    return np.concatenate(starts), np.concatenate(kept)


def _pass(docs: DataFrame, model: Windows) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        bits = _filter(own.token)
        for batch in batches:
            data, ends = utf8(batch.column(2))
            n = batch.num_rows
            count, hits, items = np.zeros(n, np.int64), [[]] * n, [[]] * n
            for a, b in chunks(ends):
                found = words(data, ends[a:b + 1], ALNUM)
                count[a:b] = np.diff(found.first)
                start, win = _matches(found, own, bits)
                cover = np.zeros(len(found.marks) + 1, np.int64)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + own.size[win], -1)
                hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
                doc_of = owners(found.first)
                for d in np.unique(doc_of[hit]).tolist():
                    hits[a + d] = hit[doc_of[hit] == d] - found.first[d]
                    items[a + d] = np.unique(own.item[win[doc_of[start] == d]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(count), pa.array(hits, pa.list_(pa.int64())),
                 pa.array(items, pa.list_(pa.int64()))], ["doc_id", "row", "n_words", "hits", "items"])

    return docs.mapInArrow(run, "doc_id bigint, row bigint, n_words bigint, hits array<bigint>, items array<bigint>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, slice_windows: int = SLICE_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the hit word positions of every row.

    Words are maximal runs of 0-9, a-z (A-Z folded) and non-ASCII characters.  A window is WINDOW
    consecutive words of an item, or the whole of a shorter one; items without id or words have none,
    rows of one item_id add up.  Tokens (shingles of TOKEN words) are ordered by how often all documents
    hold them; since a window must be held whole, its rarest token is a sufficient prefix.  Documents are
    probed with those tokens, candidates must fit the document by position and length, and each is
    verified word by word.  Item windows are broadcast in slices of at most about `slice_windows`; several
    slices are several passes whose hits are united.  Null texts have no words and are clean.
    """
    base = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    bound = base.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0   # a word and its separator take two characters
    slices = max(1, int(bound // (slice_windows * 4)) + 1)
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    parts = []
    for i in range(slices):
        items = base.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == i).toArrow()
        model = Windows(items.column(0).to_pylist(), items.column(1).to_pylist())
        model.prefix(_counts(docs, model.token) if len(model.token) else {})
        parts.append(_pass(rows, model))
    found = parts[0]
    if slices > 1:
        united = parts[0].select("*", F.lit(0).alias("part"))
        for i, part in enumerate(parts[1:], 1):
            united = united.unionAll(part.select("*", F.lit(i).alias("part")))
        united = stored(united, "hits")
        merged = united.groupBy("doc_id", "row", "n_words", "part").agg(
            F.count(F.lit(1)).alias("copies"), F.first("hits").alias("hits"), F.first("items").alias("items"))
        merged = merged.groupBy("doc_id", "row", "n_words").agg(
            F.max("copies").alias("copies"), F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        found = merged.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies").cast("array<int>")))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    n_hit = F.size("hits").cast("bigint")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "hits")
