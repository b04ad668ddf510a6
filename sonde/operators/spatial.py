"""Pairs of points within a gate, by a grid of cells instead of all pairs of a frame."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonde.functions.folds import length

EDGE = float(1 << 52)     # cells beyond are one: doubles no longer tell neighbours apart there
SLACK = 1e-9              # cells are wider than the gate by so much, against rounding
GRID_PAIRS = 10_000       # frames with more pairs are matched by the grid, others inside their row


def cell(value: Column, gate: float) -> Column:
    """Cell of a coordinate: two coordinates within the gate stand in the same or in neighbouring cells."""
    return F.floor(F.greatest(F.least(value / F.lit(gate * (1 + SLACK)), F.lit(EDGE)), F.lit(-EDGE))).cast("bigint")


def gated_join(tracks: DataFrame, targets: DataFrame, keys: Sequence[str], gate: float) -> DataFrame:
    """(keys, distance, truth_id, track_id) of the pairs of a frame whose distance is at most `gate`.

    tracks: keys, track_id, x, y; targets: keys, truth_id, x, y.  A cell is as wide as the gate; each target goes to
    its own cell and the eight around it, each track to its own, so a pair meets exactly once, on an equality join of
    frame and cell that shuffles points, not pairs.  Points with coordinates that are null or not finite pair with nothing.
    """
    sound = [F.abs(F.col(c)) < F.lit(float("inf")) for c in ("x", "y")]     # false for NaN too
    a = tracks.filter(sound[0] & sound[1]).select(
        *keys, "track_id", F.col("x").alias("tx"), F.col("y").alias("ty"), cell(F.col("x"), gate).alias("cx"), cell(F.col("y"), gate).alias("cy"))
    around = F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    b = targets.filter(sound[0] & sound[1]).select(*keys, "truth_id", "x", "y", F.inline(around)).select(
        *keys, "truth_id", "x", "y", (cell(F.col("x"), gate) + F.col("dx")).alias("cx"), (cell(F.col("y"), gate) + F.col("dy")).alias("cy"))
    distance = length(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"))
    near = a.join(b, [*keys, "cx", "cy"]).withColumn("distance", distance).filter(F.col("distance") <= gate)
    return near.select(*keys, "distance", "truth_id", "track_id")


def greedy_matches(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, matches): pairs in (distance, truth_id, track_id) order, each truth and track once, in the memory of one frame's pairs."""
    kinds = {f.name: f.dataType for f in pairs.schema.fields}
    fields = ", ".join(f"{k} {kinds[k].simpleString()}" for k in keys)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by([("distance", "ascending"), ("truth_id", "ascending"), ("track_id", "ascending")])
        truths, tracks, kept = set(), set(), []
        for row in table.select(["distance", "truth_id", "track_id"]).to_pylist():
            if row["truth_id"] not in truths and row["track_id"] not in tracks:
                truths.add(row["truth_id"])
                tracks.add(row["track_id"])
                kept.append(row)
        matches = pa.array([kept], pa.list_(pa.struct([("distance", pa.float64()), ("truth_id", pa.string()), ("track_id", pa.int64())])))
        yield pa.RecordBatch.from_arrays([*(table[k][:1].combine_chunks() for k in keys), matches], [*keys, "matches"])

    return pairs.groupBy(*keys).applyInArrow(take, f"{fields}, matches array<struct<distance:double,truth_id:string,track_id:bigint>>")
