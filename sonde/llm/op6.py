"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonde.llm.textvec import UNSPACED, chunks, owners, shingle_sets, utf8, words

FIT_ROWS = 20_000     # labelled rows that are read to fit, at most
ROUNDS, DEPTH, BINS, RATE, RIDGE = 60, 4, 64, 0.2, 1.0

# Byte classes: lower, upper, digit, space, newline, other white space, non-ASCII, end marks, commas, and each odd mark by itself.
_ODD = b"#$%&*!|<>{}[]()=/\\@_:;\"'-+"
_CLASS = np.full(256, 9, np.int64)
for _i, _set in enumerate((range(97, 123), range(65, 91), range(48, 58), (32,), (10,), (9, 11, 12, 13), range(128, 256), b".?", b",")):
    _CLASS[list(_set)] = _i
for _i, _b in enumerate(_ODD):
    _CLASS[_b] = 10 + _i
_CLASSES = 10 + len(_ODD)
_LINE = np.arange(256) != 10
FEATURES = _CLASSES + 10


def _distinct(doc: np.ndarray, marks: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct marks, largest count of one mark) of each document."""
    order = np.lexsort((marks, doc))
    d, m = doc[order], marks[order]
    head = np.ones(len(d), bool)
    head[1:] = (d[1:] != d[:-1]) | (m[1:] != m[:-1])
    many = np.diff(np.append(np.flatnonzero(head), len(d)))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, d[head], many)
    return np.bincount(d[head], minlength=n), top


def statistics(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row of FEATURES numbers for each document data[ends[i]:ends[i + 1]]; zeros if it is empty."""
    n = len(ends) - 1
    body, local = data[ends[0]:ends[-1]], ends - ends[0]
    size = np.diff(local)
    doc = np.repeat(np.arange(n), size)
    classes = np.bincount(doc * _CLASSES + _CLASS[body], minlength=n * _CLASSES).reshape(n, _CLASSES)
    out = np.zeros((n, FEATURES))
    full = np.maximum(size, 1)
    out[:, :_CLASSES] = classes / full[:, None]
    found = words(data, ends, UNSPACED)
    count, own = np.diff(found.first), owners(found.first)
    some = np.maximum(count, 1)
    length = found.end - found.start
    distinct, top = _distinct(own, found.marks, n)
    lines = words(data, ends, _LINE)
    n_lines = np.maximum(np.diff(lines.first), 1)
    line_kinds, _ = _distinct(owners(lines.first), lines.marks, n)
    shingles = np.bincount(shingle_sets(data, ends)[0], minlength=n)
    last = body[np.maximum(found.end - 1, 0)] if len(body) else np.empty(0, np.uint8)
    extra = (np.log1p(size), np.bincount(own, length, n) / some, np.bincount(own, length > 12, n) / some, distinct / some, top / some,
             np.bincount(own, length == 1, n) / some, shingles / some, line_kinds / n_lines, count / n_lines,
             np.bincount(own, ~((last >= 97) & (last < 123) | (last > 127)), n) / some)
    out[:, _CLASSES:] = np.column_stack(extra)
    return out


class Forest(NamedTuple):
    """Complete trees as arrays: node i of a tree has children 2 i + 1 and 2 i + 2; a row goes right above the cut."""

    start: float
    feature: np.ndarray   # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray      # trees x leaves

    def scores(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.start)
        at = np.arange(len(rows))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (rows[at, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def boost(rows: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> Forest:
    """Logistic boosting on binned columns; trees grow level by level from histograms of gradients."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    share = np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    if len(np.unique(labels)) < 2:
        return Forest(start, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in rows.T]
    binned = np.column_stack([np.searchsorted(q, c, "left") for q, c in zip(cuts, rows.T)])
    width = BINS
    total, keep = np.full(len(rows), start), ([], [], [])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        grad, curve = labels - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(rows), np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for depth in range(DEPTH):
            first, many = 2**depth - 1, 2**depth
            slot = node - first
            best, which = np.full(many, 1e-9), np.full(many, -1)
            bins = np.zeros(many, np.int64)
            for f in range(rows.shape[1]):
                key = slot * width + binned[:, f]
                g = np.cumsum(np.bincount(key, grad, many * width).reshape(many, width), axis=1)
                h = np.cumsum(np.bincount(key, curve, many * width).reshape(many, width), axis=1)
                gain = g**2 / (h + RIDGE) + (g[:, -1:] - g)**2 / (h[:, -1:] - h + RIDGE) - g[:, -1:]**2 / (h[:, -1:] + RIDGE)
                gain[:, len(cuts[f]):] = 0
                at = gain.argmax(axis=1)
                value = gain[np.arange(many), at]
                better = value > best
                best[better], which[better], bins[better] = value[better], f, at[better]
            for s in np.flatnonzero(which >= 0):
                feature[first + s], cut[first + s] = which[s], cuts[which[s]][bins[s]]
            node = 2 * node + 1 + (rows[np.arange(len(rows)), feature[node]] > cut[node])
        slot = node - inner
        leaf = RATE * np.bincount(slot, grad, leaves) / (np.bincount(slot, curve, leaves) + RIDGE)
        total += leaf[slot]
        for held, new in zip(keep, (feature, cut, leaf)):
            held.append(new)
    return Forest(start, *(np.array(k) for k in keep))


def _described(docs: DataFrame, kept: str) -> DataFrame:
    """`kept` and the statistics of every row; docs are (kept, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = utf8(batch.column(1))
            rows = [statistics(data, ends[a:b + 1]) for a, b in chunks(ends)]
            flat = np.concatenate(rows) if rows else np.zeros((0, FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(flat), pa.list_(pa.float64()))], [kept, "rows"])

    return docs.mapInArrow(run, f"{kept} int, rows array<double>")


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Forest:
    """Trees learnt from documents with a non-null quality: the `fit_rows` labels of the smallest id hashes, at most."""
    some = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(fit_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("quality", "text")
    got = _described(rows, "quality").toArrow()
    flat = np.array(got.column("rows").to_pylist()).reshape(-1, FEATURES)
    order = np.lexsort((*flat.T, got.column("quality").to_numpy()))  # no matter how the rows arrive
    return boost(flat[order], got.column("quality").to_numpy()[order].astype(float))


def classify(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id and score (0 to 1) of every row, from its whole text; null and empty texts have zero statistics."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(forest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Forest(*shared.value)
        for batch in batches:
            data, ends = utf8(batch.column(1))
            score = np.zeros(batch.num_rows)
            for a, b in chunks(ends):
                score[a:b] = own.scores(statistics(data, ends[a:b + 1]))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(score)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")
