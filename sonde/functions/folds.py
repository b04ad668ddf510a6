"""Higher-order folds that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def length(dx: Column, dy: Column) -> Column:
    """Length of (dx, dy): the root of the sum of squares, each step rounded once, so that any engine gets the same
    last bit and pairs at equal distance keep their order; hypot where squares leave the range of doubles."""
    squares = dx * dx + dy * dy
    return F.when((squares >= 1e-280) & (squares <= 1e300), F.sqrt(squares)).otherwise(F.hypot(dx, dy))


def gated_pairs(tracks: Column, targets: Column, gate: float) -> Column:
    """(distance, truth_id, track_id) of the track/target pairs of one frame within the gate.

    Both arrays belong to one row (a frame), so no rows are multiplied; pairs beyond the gate
    are dropped while they are built.
    """
    def near(target: Column) -> Column:
        pair = F.transform(tracks, lambda t: F.struct(
            length(target["x"] - t["x"], target["y"] - t["y"]).alias("distance"),
            target["truth_id"].alias("truth_id"), t["track_id"].alias("track_id")))
        return F.filter(pair, lambda p: p["distance"] <= gate)

    return F.flatten(F.transform(targets, near))


def greedy_one_to_one(pairs: Column) -> Column:
    """Pairs taken in (distance, truth_id, track_id) order, each truth and track at most once."""
    kind = "array<struct<distance:double,truth_id:string,track_id:bigint>>"
    start = F.array().cast(kind)

    def take(taken: Column, pair: Column) -> Column:
        clash = F.exists(taken, lambda m: (m["truth_id"] == pair["truth_id"]) | (m["track_id"] == pair["track_id"]))
        return F.when(clash, taken).otherwise(F.array_append(taken, pair))

    return F.aggregate(F.array_sort(pairs).cast(kind), start, take)
