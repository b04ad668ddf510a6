"""Truth-based scoring of track frames.  The only place where truth meets tracks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonde import schemas
from sonde.functions.folds import gated_pairs, greedy_one_to_one
from sonde.operators import spatial
from sonde.operators.rules import _violations, repeated_keys, union_all
from sonde.plans.ordered import carry, row_blocks, settle

FRAME = ("run_id", "run_generation", "source_sequence")


def check_gate(gate: float) -> None:
    if not math.isfinite(gate) or gate <= 0:
        raise ValueError("evaluation gate must be finite and positive")


def match_frames(frames: DataFrame, truth: DataFrame, gate: float = 5.0, grid_pairs: int = spatial.GRID_PAIRS) -> DataFrame:
    """One row per evaluated frame with its matches, unmatched targets and false tracks.

    The join is on the frame key, one row per side; matching is a fold inside the row.  Frames with more than
    `grid_pairs` track and target pairs get their candidates from the grid join instead.
    """
    check_gate(gate)
    f = frames.select(*FRAME, "tracks")
    t = truth.select(*FRAME, "entities")
    steady = F.filter("tracks", lambda k: k["state"] != "tentative")
    joined = t.join(f, list(FRAME)).select(
        *FRAME, "entities", steady.alias("steady"), (F.size("tracks") - F.size(steady)).alias("tentative"))
    large = F.size("steady").cast("bigint") * F.size("entities") > grid_pairs
    inside = settle(joined.filter(~large), matches=greedy_one_to_one(gated_pairs(F.col("steady"), F.col("entities"), gate)))
    crowded = joined.filter(large)
    pairs = spatial.gated_join(crowded.select(*FRAME, F.inline("steady")).select(*FRAME, "track_id", "x", "y"),
                               crowded.select(*FRAME, F.inline("entities")).select(*FRAME, "truth_id", "x", "y"), FRAME, gate)
    found = crowded.join(spatial.greedy_matches(pairs, FRAME), list(FRAME), "left").withColumn(
        "matches", F.coalesce("matches", F.array().cast(inside.schema["matches"].dataType)))
    matched = inside.unionByName(found)
    return matched.select(
        *FRAME, "matches", "tentative", F.size("entities").alias("targets"), F.size("steady").alias("tracks"),
        _others("entities", "truth_id").alias("missed"), _others("steady", "track_id").alias("false_tracks"))


def _others(rows: str, name: str) -> Column:
    """Ids of a frame's rows that no match holds, as often as they stand there."""
    ids, taken = F.col(rows)[name], F.col("matches")[name]
    left = F.array_except(ids, taken)
    repeated = F.filter(ids, lambda i: i.isNull() | F.coalesce(F.array_contains(left, i), F.lit(False)))
    return F.when(F.size(F.array_distinct(ids)) == F.size(ids), left).otherwise(repeated)


def match_truth(matched: DataFrame) -> DataFrame:
    """(frame key, distance, truth_id, track_id) of every accepted match."""
    return matched.select(*FRAME, F.inline("matches"))


def missed_targets(matched: DataFrame) -> DataFrame:
    return matched.select(*FRAME, F.explode("missed").alias("truth_id"))


def false_tracks(matched: DataFrame) -> DataFrame:
    return matched.select(*FRAME, F.explode("false_tracks").alias("track_id"))


def unique_false_tracks(matched: DataFrame) -> DataFrame:
    """Distinct false tracks per run, counted in two steps so no set grows with a run."""
    return (matched.select("run_id", F.explode("false_tracks").alias("track_id"))
            .groupBy("run_id", "track_id").agg(F.lit(1).alias("one"))
            .groupBy("run_id").agg(F.count(F.lit(1)).alias("unique_false_tracks")))


def id_switches(matches: DataFrame, block: Column | None = None) -> DataFrame:
    """Matches whose track differs from the same target's previous match in its generation.

    Frames without a match of that target are skipped, so switches survive gaps; the first
    match of a target, and the first in a generation, is no switch.
    """
    block = row_blocks("source_sequence") if block is None else block
    with_previous = carry(
        matches, ["run_id", "run_generation", "truth_id"], ["source_sequence"], block,
        lags={"previous_track_id": F.col("track_id")})
    return with_previous.filter(F.col("track_id") != F.col("previous_track_id"))


def run_metrics(frames: DataFrame, truth: DataFrame, gate: float = 5.0, config: DataFrame | None = None,
                block: Column | None = None) -> DataFrame:
    """The eleven metrics per run; errors are null, not 0, for a run without matches.

    `config` is (run_id, fusion_config); without it the configuration column is null.
    """
    matched = match_frames(frames, truth, gate)
    distances = F.transform("matches", lambda m: m["distance"])
    add = lambda array: F.aggregate(array, F.lit(0.0), lambda a, d: a + d)
    per_frame = matched.select(
        "run_id", "targets", "tentative", F.size("matches").alias("n"), F.size("missed").alias("missed"),
        F.size("false_tracks").alias("spurious"),
        add(distances).alias("error"), add(F.transform(distances, lambda d: d * d)).alias("squared"))
    n = F.sum("n")
    totals = per_frame.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("evaluated_frames"), F.sum("targets").alias("target_samples"),
        n.alias("matched_samples"),
        F.when(n > 0, F.sqrt(F.sum("squared") / n)).alias("position_rmse"),
        F.when(n > 0, F.sum("error") / n).alias("mean_position_error"),
        F.sum(F.col("targets") - F.col("n")).alias("missed_target_samples"), F.sum("spurious").alias("false_track_samples"),
        F.sum("tentative").alias("tentative_track_samples"))
    switches = id_switches(match_truth(matched), block).groupBy("run_id").agg(F.count(F.lit(1)).alias("id_switches"))
    out = totals.join(unique_false_tracks(matched), "run_id", "left").join(switches, "run_id", "left")
    out = out.na.fill(0, ["unique_false_tracks", "id_switches"])
    if config is not None:
        out = out.join(config, "run_id", "left")
    else:
        out = out.withColumn("fusion_config", F.lit(None).cast("string"))
    out = out.withColumn("evaluator_version", F.lit(schemas.EVALUATOR_VERSION)).withColumn(
        "evaluation_gate", F.lit(float(gate)))
    return out.select(*(f.name for f in schemas.RUN_METRICS.fields))


def evaluation_guards(frames: DataFrame, truth: DataFrame) -> DataFrame:
    """Repeated truth frames and targets, truth without a frame, and differing frame times."""
    as_event = lambda df: df.withColumnRenamed("source_sequence", "stream_sequence")
    repeated_target = truth.filter(
        F.size(F.array_distinct(F.transform("entities", lambda e: e["truth_id"]))) != F.size("entities"))
    both = truth.select(*FRAME, F.col("acquisition_time").alias("truth_time")).join(
        frames.select(*FRAME, "acquisition_time"), list(FRAME), "left")
    return union_all([
        repeated_keys(as_event(truth), ["run_id", "run_generation", "stream_sequence"], "duplicate_truth_frame"),
        _violations(as_event(repeated_target), "duplicate_truth_target"),
        _violations(as_event(both.filter(F.col("acquisition_time").isNull())), "missing_frame"),
        _violations(as_event(both.filter(F.col("acquisition_time") != F.col("truth_time"))), "truth_time_mismatch")])


def last_scan_frames(frames: DataFrame) -> DataFrame:
    """(run, generation, time, source_sequence) of the last MEASUREMENTS frame at each time."""
    return frames.filter(F.col("source_type") == "MEASUREMENTS").groupBy(
        "run_id", "run_generation", "acquisition_time").agg(F.max("source_sequence").alias("source_sequence"))


def truth_at_scans(frames: DataFrame, ground_truth: DataFrame) -> DataFrame:
    """Truth frames at the last scan of each acquisition time; ticks without a scan stay unevaluated."""
    entity = F.struct(F.col("target_id").cast("string").alias("truth_id"), "x", "y")
    per_tick = ground_truth.groupBy("run_id", F.col("timestamp").alias("acquisition_time")).agg(
        F.array_sort(F.collect_list(entity)).alias("entities"))  # one tick's targets, at most a dozen
    return last_scan_frames(frames).join(per_tick, ["run_id", "acquisition_time"]).select(
        *FRAME, "acquisition_time", "entities")
