"""Removal of long repeated byte strings: prefix doubling over ranked text positions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonde.llm.common import attach, stored
from sonde.llm.textvec import mix, powers, sums, utf8

LENGTH = 400
HALF = LENGTH // 2
FIRST = LENGTH // 16     # length of the first ranks
REACH = 96               # every run of so many positions holds an anchor
FLUSH = 1_000_000        # positions a task gathers before it sends them on
BUCKET = 1_500_000       # positions of one shuffled bucket, about


def ranks(data: np.ndarray, length: int) -> list[np.ndarray]:
    """Ranks of all positions at lengths FIRST, 2 FIRST, ..., `length`: a pair of ranks at growing offsets names the next one.

    A rank is a 64-bit name, equal for equal strings and otherwise different up to chance.
    """
    total = sums(data)
    out = [mix((total[FIRST:] - total[:-FIRST]) * powers(len(data))[1][:max(len(data) - FIRST + 1, 0)])] if len(data) >= FIRST else [np.empty(0, np.uint64)]
    step = FIRST
    while step < length:
        last = out[-1]
        n = max(len(last) - step, 0)
        out.append(mix(last[:n] * np.uint64(0x9E3779B97F4A7C15) + last[step:step + n]))
        step *= 2
    return out


def anchors(first: np.ndarray) -> np.ndarray:
    """Positions whose first rank is the smallest, the leftmost of equal ones, of some run of REACH positions."""
    n = len(first) - REACH + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least, width = first, 1
    best = np.arange(len(first), dtype=np.int64)
    while width < REACH:
        step = min(width, REACH - width)
        a, b = least[:len(least) - step], least[step:]
        pick = b < a
        best = np.where(pick, best[step:step + len(a)], best[:len(a)])
        least = np.where(pick, b, a)
        width += step
    keep = np.zeros(len(first), bool)
    keep[best[:n]] = True
    return np.flatnonzero(keep)


def _docs(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray]]:
    data, ends = utf8(batch.column(column))
    for i in range(len(ends) - 1):
        yield i, data[ends[i]:ends[i + 1]]


def _blobs(name: np.ndarray, unit: np.ndarray, pos: np.ndarray, route: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Positions by bucket.  Names met twice here are answered here; one position of each goes on, marked."""
    order = np.argsort(name, kind="stable")
    ranked = name[order]
    head = np.ones(len(order), bool)
    head[1:] = ranked[1:] != ranked[:-1]
    many = np.diff(np.append(np.flatnonzero(head), len(order))) > 1
    repeated = np.zeros(len(order), bool)
    repeated[order] = many[np.cumsum(head) - 1]
    leads = np.zeros(len(order), bool)
    leads[order] = head
    go = np.flatnonzero(leads)
    bucket = (route[go] % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    go, bucket = go[by], bucket[by]
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(go)]):
        rows = go[i:j]
        yield int(bucket[i]), name[rows].tobytes(), unit[rows].tobytes(), pos[rows].astype(np.int32).tobytes(), repeated[rows].tobytes(), b"", b""
    if repeated.any():
        yield int(route[0] % np.uint64(buckets)), b"", b"", b"", b"", unit[repeated].tobytes(), pos[repeated].astype(np.int32).tobytes()


_SENT = "bucket bigint, name binary, unit binary, pos binary, twice binary, done_unit binary, done_pos binary"
_FOUND = "unit bigint, pos binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in _SENT.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 7))], names)


def _column(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _runs(pos: np.ndarray) -> np.ndarray:
    """Sorted distinct positions as (start, end) pairs."""
    cut = np.flatnonzero(np.diff(pos) > 1)
    return np.column_stack([pos[np.append(0, cut + 1)], pos[np.append(cut, len(pos) - 1)] + 1]).astype(np.int32)


def _answer(table: pa.Table) -> pa.Table:
    """Repeated positions of a bucket as runs, one row for each unit."""
    name, unit = _column(table, "name", np.uint64), _column(table, "unit", np.int64)
    pos, twice = _column(table, "pos", np.int32), _column(table, "twice", bool)
    order = np.argsort(name)
    ranked = name[order]
    hit = np.zeros(len(order), bool)
    if len(order):
        head = np.ones(len(order), bool)
        head[1:] = ranked[1:] != ranked[:-1]
        hit[order] = (np.diff(np.append(np.flatnonzero(head), len(order))) > 1)[np.cumsum(head) - 1]
    hit |= twice
    unit = np.concatenate([unit[hit], _column(table, "done_unit", np.int64)])
    pos = np.concatenate([pos[hit], _column(table, "done_pos", np.int32)])
    order = np.lexsort((pos, unit))
    unit, pos = unit[order], pos[order]
    cut = np.flatnonzero(np.diff(unit, prepend=unit[0] - 1 if len(unit) else 0))
    ends = [*cut[1:].tolist(), len(unit)]
    return pa.table({"unit": pa.array(unit[cut], pa.int64()),
                     "pos": pa.array([_runs(np.unique(pos[i:j])).tobytes() for i, j in zip(cut.tolist(), ends)], pa.binary())})


def _gather(found: DataFrame) -> DataFrame:
    """One row per unit: its runs from all buckets, as one blob in no order."""
    return found.groupBy("unit").agg(F.expr("array_join(collect_list(hex(pos)), '')").alias("h")).select(
        "unit", F.unhex("h").alias("runs"))


class _Sender:
    def __init__(self, buckets: int):
        self.buckets, self.parts, self.held = buckets, [], 0

    def add(self, name: np.ndarray, unit: int, pos: np.ndarray, route: np.ndarray) -> None:
        self.parts.append((name, np.full(len(name), unit, np.int64), pos, route))
        self.held += len(name)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            rows = list(_blobs(*(np.concatenate(x) for x in zip(*self.parts)), self.buckets))
            self.parts, self.held = [], 0
            yield _batch(rows)


def _anchor_ranks(docs: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Sender(buckets)
        for batch in batches:
            units = batch.column(0).to_pylist()
            for i, data in _docs(batch, 1):
                if len(data) < LENGTH:
                    continue
                level = ranks(data, HALF)
                at = anchors(level[0])
                at = at[at < len(level[-1])]
                out.add(level[-1][at], units[i], at, level[-1][at])
                if out.held >= FLUSH:
                    yield from out.flush()
        yield from out.flush()

    return docs.select("unit", "text").mapInArrow(run, _SENT)


def _window_ranks(docs: DataFrame, buckets: int) -> DataFrame:
    """Ranks at full length of the positions whose first settled anchor is repeated at half length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Sender(buckets)
        for batch in batches:
            units, runs = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, data in _docs(batch, 1):
                level = ranks(data, LENGTH)
                at = anchors(level[0])
                at = at[at < len(level[-2])]
                good = np.zeros(len(data) + 1, np.int64)
                spans = np.frombuffer(runs[i], np.int32).reshape(-1, 2)
                np.add.at(good, spans[:, 0], 1)
                np.add.at(good, spans[:, 1], -1)
                good = np.cumsum(good) > 0
                # The first anchor at or after p + REACH - 1 is settled by bytes inside the string at p.
                p = np.arange(len(level[-1]))
                nth = np.searchsorted(at, p + REACH - 1)
                ok = nth < len(at)
                p, own = p[ok], at[nth[ok]]
                ok = good[own]
                p, own = p[ok], own[ok]
                out.add(level[-1][p], units[i], p, level[-2][own])
                if out.held >= FLUSH:
                    yield from out.flush()
        yield from out.flush()

    return docs.select("unit", "text", "runs").mapInArrow(run, _SENT)


def _results(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies, runs = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            size, gone, spans, sha = [], [], [], []
            for i, data in _docs(batch, 1):
                cover = np.zeros(len(data) + 1, np.int64)
                if (copies[i] or 0) > 1 and len(data) >= LENGTH:
                    cover[0], cover[-1] = 1, -1
                elif runs[i]:
                    span = np.frombuffer(runs[i], np.int32).reshape(-1, 2)
                    np.add.at(cover, span[:, 0], 1)
                    np.add.at(cover, span[:, 1] - 1 + LENGTH, -1)
                hit = np.cumsum(cover[:-1]) > 0
                size.append(len(data))
                gone.append(int(hit.sum()))
                spans.append(int(np.count_nonzero(np.diff(hit.astype(np.int8), prepend=0) == 1)))
                sha.append(hashlib.sha256(data[~hit].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return docs.select("doc_id", "text", "copies", "runs").mapInArrow(
        run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of `docs`.

    A byte goes if a LENGTH-byte string that also starts elsewhere (in any row, the same one
    included) covers it; strings are judged on the input.  Null texts are empty.  Rows with equal texts
    of LENGTH bytes or more repeat each other whole; one of them stands for all below.

    Prefix doubling, in two rounds of sorting and reranking.  Ranks at FIRST bytes are doubled by pairs at growing
    offsets.  At half length they are sorted for a sparse set of positions, anchors chosen by content so that
    equal strings have equal anchors; a position whose anchor is unique is dropped, since its string is unique.
    The others are ranked by pairs at full length and sorted again.  A rank met twice in a sending task is
    answered there and sent on once, so a frequent string sends one row from each flush.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("unit", F.xxhash64("text"))
    units = stored(rows.select("doc_id", "unit", F.octet_length("text").alias("n")).where(f"n >= {LENGTH}").groupBy("unit").agg(
        F.min(F.coalesce("doc_id", F.lit(-(1 << 62)))).alias("lead"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n")), "units")
    total = units.agg(F.sum("n")).first()[0] or 0
    again = stored(units.where("copies > 1").select("unit", "copies"), "copied")
    # Copies answer for themselves; the smallest doc_id stands for them, and rows of equal id and text stand together.
    spare = units.where("copies > 1").select("unit", "lead")
    lone = attach(rows.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 62)))), stored(spare, "leads"), "unit", "left")
    lone = lone.where("lead is null or id = lead").select("unit", "text")
    buckets = max(1, total * 2 // (REACH + 1) // BUCKET + 1)
    repeated = stored(_gather(_anchor_ranks(lone, buckets).groupBy("bucket").applyInArrow(_answer, _FOUND)), "anchors")
    left = repeated.agg(F.sum(F.length("runs"))).first()[0] or 0
    near = attach(lone, repeated, "unit", "inner", "runs")
    buckets = max(1, left // 8 * (REACH + 1) // 2 // BUCKET + 1)
    found = stored(_gather(_window_ranks(near, buckets).groupBy("bucket").applyInArrow(_answer, _FOUND)), "repeats")
    out = attach(attach(rows, again, "unit", "left"), found, "unit", "left", "runs")
    return _results(out)
