"""Per-run and per-sensor summaries of the clean tables.

All are partial-aggregation friendly: a sensor or run holding a third of the rows is combined
on the map side.  Sides are aggregated before they are joined, so scans are never multiplied
by detections.  None of them sorts; `ordered` adds a report's ORDER BY for presentation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonde.plans.ordered import carry, depth_blocks

GENERATION = ("run_id", "run_generation")
SENSOR = (*GENERATION, "sensor_id")
SENSOR_GENERATION = (*SENSOR, "sensor_generation")


def count_rows() -> Column:
    return F.count(F.lit(1))


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom as DOUBLE; null (not 0, not an error) when the bottom is 0 or null."""
    return top.cast("double") / F.when(bottom != 0, bottom)


def ordered(df: DataFrame, *columns: str) -> DataFrame:
    """The report's total order: a range exchange over the (small) result."""
    return df.orderBy(*columns)


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(*GENERATION, "event_type").agg(count_rows().alias("event_count"))


def run_summary(events: DataFrame, scans: DataFrame) -> DataFrame:
    """Per generation; timestamps are never subtracted across a reset, zero-scan generations stay."""
    # Two-step distinct: (generation, sensor) partials first, so no set is held for a hot run.
    lifecycle = (
        events.groupBy(*SENSOR)
        .agg(count_rows().alias("events"), F.max("event_time_seconds").alias("last_time"))
        .groupBy(*GENERATION)
        .agg(F.sum("events").alias("events"), F.max("last_time").alias("last_event_time_seconds"),
             F.count("sensor_id").alias("sensors"))
    )
    volume = scans.groupBy(*GENERATION).agg(
        count_rows().alias("scans"), F.sum("measurement_count").alias("detections"))
    return lifecycle.join(volume, list(GENERATION), "left").na.fill(0, ["scans", "detections"])


def scan_totals(scans: DataFrame, *keys: str) -> DataFrame:
    return scans.groupBy(*keys).agg(
        count_rows().alias("scans"), F.sum("measurement_count").alias("detections"),
        F.count_if(F.col("measurement_count") == 0).alias("empty_scans"))


def sensor_summary(events: DataFrame, scans: DataFrame) -> DataFrame:
    """Includes sensors that started but never scanned: counts 0, ratios null."""
    started = events.filter(F.col("event_type") == "SENSOR_STARTED").select(*SENSOR)
    totals = scan_totals(scans, *SENSOR)
    return started.join(totals, list(SENSOR), "left").select(
        *SENSOR,
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("scans", "detections", "empty_scans")),
        ratio(F.lit(100.0) * F.col("empty_scans"), F.col("scans")).alias("empty_scan_pct"),
        ratio(F.col("detections"), F.col("scans")).alias("detections_per_scan"))


def scan_intervals(scans: DataFrame, block: Column | None = None) -> DataFrame:
    """Each scan with the time since the previous scan of the same sensor generation; sequences may be sparse."""
    placed = depth_blocks(scans, SENSOR_GENERATION, "scan_sequence") if block is None else scans.withColumn("depth_block", block)
    time = F.col("acquisition_time_seconds")
    previous = carry(placed, SENSOR_GENERATION, ["scan_sequence"], F.col("depth_block"), lags={"previous_time": time})
    return previous.withColumn("interval_seconds", time - F.col("previous_time")).drop("previous_time", "depth_block")


def scan_cadence(scans: DataFrame, block: Column | None = None) -> DataFrame:
    """Observed intervals per sensor generation; resets are never bridged."""
    interval = F.col("interval_seconds")
    return scan_intervals(scans, block).groupBy(*SENSOR_GENERATION).agg(
        count_rows().alias("scans"), F.min(interval).alias("min_interval_seconds"),
        F.avg(interval).alias("mean_interval_seconds"), F.max(interval).alias("max_interval_seconds"),
    ).withColumn("observed_hz", ratio(F.lit(1.0), F.col("mean_interval_seconds")))


def detections_over_time(scans: DataFrame) -> DataFrame:
    """One-second buckets of acquisition time; empty scans count as scans."""
    second = F.floor("acquisition_time_seconds").cast("bigint").alias("simulation_second")
    return scan_totals(scans.select("*", second), *SENSOR, "simulation_second")


def measurement_distribution(measurements: DataFrame) -> DataFrame:
    """Volume share, confidence, uncertainty and extent per sensor and generation."""
    share = Window.partitionBy(*GENERATION)  # over one row per sensor, after aggregation
    return measurements.groupBy(*SENSOR).agg(
        count_rows().alias("detections"), F.avg("confidence").alias("mean_confidence"),
        F.avg("uncertainty_radius").alias("mean_uncertainty_radius"),
        F.min("x").alias("min_x"), F.max("x").alias("max_x"),
        F.min("y").alias("min_y"), F.max("y").alias("max_y"),
    ).withColumn("volume_pct", ratio(F.lit(100.0) * F.col("detections"), F.sum("detections").over(share)))


def track_summary(samples: DataFrame) -> DataFrame:
    """Life of each track over its samples (the last snapshot at each acquisition time)."""
    return samples.groupBy(*GENERATION, "track_id").agg(
        F.min("acquisition_time").alias("first_sample"), F.max("acquisition_time").alias("last_sample"),
        count_rows().alias("samples"),
        F.count_if(F.col("state") == "tentative").alias("tentative_samples"),
        F.count_if(F.col("state") == "coasting").alias("coasting_samples"),
        F.max("observations").alias("observations"), F.max("sensor_count").alias("contributing_sensors"),
        F.max(F.col("acquisition_time") - F.col("last_seen")).alias("max_observation_age"))


def analysis_summary(runs: DataFrame, run_metrics: DataFrame) -> DataFrame:
    return runs.join(run_metrics, "run_id").select(
        "run_id", "scenario_seed", "layout_seed", "duration_seconds", "target_count", "sensor_count",
        "evaluated_frames", "target_samples", "matched_samples", "position_rmse", "mean_position_error",
        "missed_target_samples", "false_track_samples", "unique_false_tracks", "id_switches")


def sensing_totals(scans: DataFrame) -> DataFrame:
    return scan_totals(scans, "run_id").select(
        "run_id", F.col("scans").alias("scan_count"), F.col("detections").alias("measurement_count"),
        F.col("empty_scans").alias("empty_scan_count"))


def fusion_totals(frames: DataFrame) -> DataFrame:
    """Snapshots, tracks created, final active tracks, associations and retirements per run."""
    per_frame = frames.select(
        "run_id", "source_sequence", F.size("tracks").alias("active"),
        F.size("associations").alias("associated"), F.size("retired").alias("gone"))
    totals = per_frame.groupBy("run_id").agg(
        count_rows().alias("snapshots"), F.sum("associated").alias("associations"), F.sum("gone").alias("retirements"),
        F.max_by("active", "source_sequence").alias("final_active_tracks"))
    created = (
        frames.select("run_id", F.explode("tracks.track_id").alias("track_id"))
        .groupBy("run_id", "track_id").agg(F.lit(1).alias("one"))
        .groupBy("run_id").agg(count_rows().alias("tracks_created")))
    return totals.join(created, "run_id", "left").na.fill(0, ["tracks_created"])


def single_run(report: DataFrame, run_id: int) -> DataFrame:
    """One run's rows of a stored report; on a run-partitioned table this prunes partitions."""
    return report.filter(F.col("run_id") == F.lit(run_id))


def production_span(marks: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Production marks and first-to-last span in file order, plus the dataset's bytes."""
    made = marks.filter(F.col("phase") == "produced")
    span = made.agg(
        count_rows().alias("production_marks"),
        ((F.max_by("wall_ns", "arrival") - F.min_by("wall_ns", "arrival")) / 1e6).alias("production_wall_span_ms"))
    if files is None:
        return span
    return span.join(files.agg(F.sum("length").alias("clean_parquet_bytes")))
