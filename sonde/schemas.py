"""Declared schemas of every stored table, and the fixed catalogs.

Nothing is inferred: an empty table keeps its columns, and a 20-digit run id keeps its digits.
"""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 1

# --- Fixed values: file headers, event kinds, states, limits -------------------------------
RECORDING_HEADER = "SENSOR_EVENTS 1"
LAYOUT_HEADER = "SENSOR_LAYOUT 1"
RUN_KINDS = ("RUN_STARTED", "RUN_RESET", "RUN_FINISHED")
SENSOR_KINDS = ("SENSOR_STARTED", "SENSOR_RESET", "MEASUREMENTS")
EVENT_KINDS = RUN_KINDS + SENSOR_KINDS
TRACK_STATES = ("tentative", "confirmed", "coasting")
UINT64_MAX = 18446744073709551615
UINT32_MAX = 4294967295
EVALUATOR_VERSION = "greedy-distance-v1"
TICK_HZ = 8

RUN_ID = T.DecimalType(20, 0)


def _fields(text: str) -> T.StructType:
    """`name type[!], ...` with `!` for NOT NULL and `id` for the unsigned 64-bit run id."""
    kinds = {"id": RUN_ID, "long": T.LongType(), "int": T.IntegerType(), "float": T.FloatType(),
             "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}
    out = []
    for item in text.split(","):
        name, kind = item.split()
        out.append(T.StructField(name, kinds[kind.rstrip("!")], not kind.endswith("!")))
    return T.StructType(out)


EVENTS = _fields(
    "run_id id!, run_generation long!, stream_sequence long!, event_time_seconds float!, event_type string!,"
    "sensor_id int, sensor_generation long, scan_sequence long, measurement_count long, seed long")
SCANS = _fields(
    "run_id id!, run_generation long!, stream_sequence long!, acquisition_time_seconds float!, sensor_id int!,"
    "sensor_generation long!, scan_sequence long!, measurement_count long!")
MEASUREMENTS = _fields(
    "run_id id!, run_generation long!, stream_sequence long!, acquisition_time_seconds float!, sensor_id int!,"
    "sensor_generation long!, scan_sequence long!, detection_id int!, x float!, y float!, confidence float!,"
    "uncertainty_radius float!")
CLEAN_TABLES = {"events": EVENTS, "scans": SCANS, "measurements": MEASUREMENTS}
# Declared keys of the clean tables: primary keys first, then the unique constraint of scans.
TABLE_KEYS = {
    "events": [("run_id", "stream_sequence")],
    "scans": [("run_id", "stream_sequence"),
              ("run_id", "run_generation", "sensor_id", "sensor_generation", "scan_sequence")],
    "measurements": [("run_id", "run_generation", "sensor_id", "sensor_generation", "detection_id")],
}

DETECTION = _fields("detection_id int, x float, y float, confidence float, uncertainty_radius float")

RUNS = _fields(
    "run_id id, generator_version string, scenario_seed long, layout_seed long, duration_seconds int,"
    "target_count int, sensor_count int, tick_hz int, speed_min double, speed_max double, maneuver double,"
    "convergence double, spawn_spread double, coverage double, layout_spread double, noise double,"
    "reliability double, clutter double")
SENSORS = _fields(
    "run_id id, sensor_id int, seed long, x double, y double, heading_radians double,"
    "field_of_view_radians double, range double, refresh_rate_hz double, range_noise double,"
    "detection_probability double, false_positive_rate_hz double")
GROUND_TRUTH = _fields(
    "run_id id, target_id int, timestamp double, x double, y double, vx double, vy double, motion_type string")
TRACK_SAMPLES = _fields(
    "run_id id, run_generation long, source_sequence long, acquisition_time double, track_id long, state string,"
    "x double, y double, vx double, vy double, last_seen double, observations long, sensor_count int")
RUN_METRICS = _fields(
    "run_id id, evaluator_version string, fusion_config string, evaluated_frames long, target_samples long,"
    "matched_samples long, position_rmse double, mean_position_error double, missed_target_samples long,"
    "false_track_samples long, unique_false_tracks long, id_switches long, tentative_track_samples long,"
    "evaluation_gate double")
ANALYSIS_INPUTS = {"runs": RUNS, "sensors": SENSORS, "ground_truth": GROUND_TRUTH}
ANALYSIS_TABLES = {**ANALYSIS_INPUTS, "tracks": TRACK_SAMPLES, "run_metrics": RUN_METRICS}
ANALYSIS_ORDER = {
    "runs": ("run_id",), "sensors": ("run_id", "sensor_id"),
    "ground_truth": ("run_id", "timestamp", "target_id"),
    "tracks": ("run_id", "run_generation", "acquisition_time", "track_id"), "run_metrics": ("run_id",),
}

MEMBERSHIP = _fields(
    "experiment_id string, experiment_name string, run_id id, seed long, requested_config string,"
    "varying_parameters string")

TRACE = _fields("phase string, sequence long, wall_ns long")
LAYOUT = _fields(
    "generation long, sensor_id int, x double, y double, heading_degrees double, fov_degrees double, range double")

TRACK = T.StructType([
    T.StructField("track_id", T.LongType()), T.StructField("state", T.StringType()),
    T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()),
    T.StructField("vx", T.DoubleType()), T.StructField("vy", T.DoubleType()),
    T.StructField("last_seen", T.DoubleType()), T.StructField("observations", T.LongType()),
    T.StructField("distinct_times", T.LongType()), T.StructField("sensors", T.ArrayType(T.IntegerType())),
])
ASSOCIATION = _fields(
    "sensor_id int, sensor_generation long, scan_sequence long, detection_id int, track_id long")
RETIRED = _fields("track_id long, reason string")
FUSION_CONFIG = _fields(
    "gate double, alpha double, beta double, coast_after double, delete_after double, tentative_timeout double,"
    "confirmation_times long")
FRAMES = T.StructType([
    T.StructField("schema_version", T.IntegerType()), T.StructField("event_type", T.StringType()),
    T.StructField("run_id", RUN_ID), T.StructField("run_generation", T.LongType()),
    T.StructField("source_sequence", T.LongType()), T.StructField("acquisition_time", T.DoubleType()),
    T.StructField("source_type", T.StringType()), T.StructField("config", FUSION_CONFIG),
    T.StructField("tracks", T.ArrayType(TRACK)), T.StructField("associations", T.ArrayType(ASSOCIATION)),
    T.StructField("retired", T.ArrayType(RETIRED)),
])
ENTITY = _fields("truth_id string, x double, y double")
TRUTH_FRAMES = T.StructType([
    T.StructField("run_id", RUN_ID), T.StructField("run_generation", T.LongType()),
    T.StructField("source_sequence", T.LongType()), T.StructField("acquisition_time", T.DoubleType()),
    T.StructField("entities", T.ArrayType(ENTITY)),
])

# One transport experiment's summary document.  Timing fields may be null in every file.
EXPERIMENT_SUMMARY = T.StructType([
    T.StructField("config", _fields("name string")),
    T.StructField("transport", T.StringType()),
    T.StructField("metrics", _fields(
        "total_produced long, total_consumed long, produced_events_per_second double,"
        "consumed_events_per_second double, latency_p50_ms double, latency_p95_ms double, latency_p99_ms double,"
        "max_backlog long, final_backlog long, catchup_seconds double, duplicate_count long,"
        "missing_sequence_count long, integrity_pass boolean")),
])

# Manifests: a run (or analysis) exists for readers only once its manifest row is stored.
MANIFEST = _fields(
    "run_id id, schema_version int, recording_version int, source string, normalized_sha256 string,"
    "events long, scans long, measurements long, duplicates_removed long, batch string")
RAW_ARCHIVE = _fields("recording_sha256 string, bytes long, source_name string")
QUALITY = _fields(
    "recording_sha256 string, source string, run_id id, normalized_sha256 string, status string, stage string,"
    "checks_passed string, source_events long, source_scans long, source_measurements long, clean_events long,"
    "clean_scans long, clean_measurements long, duplicates_removed long, error string")
FILES = _fields("file string, sha256 string, bytes long, batch string")
ANALYSIS_MANIFEST = _fields(
    "run_id id, schema_version int, source_sha256 string, inputs_sha256 string, batch string")
VIOLATIONS = _fields("source string, run_id id, stream_sequence long, rule string, detail string")

# --- Fixed values: experiment parameters ----------------------------------------------------
# name: (lowest, highest, default)
PARAMETERS = {
    "speed_min": (1.0, 30.0, 14.0), "speed_max": (1.0, 30.0, 16.0), "maneuver": (0.0, 3.0, 1.0),
    "convergence": (0.0, 1.0, 1.0), "spawn_spread": (0.4, 1.5, 1.0), "coverage": (0.65, 1.6, 1.0),
    "layout_spread": (0.25, 3.0, 1.0), "noise": (0.0, 5.0, 1.0), "reliability": (0.35, 1.0, 1.0),
    "clutter": (0.0, 12.0, 1.0),
}
INTEGER_PARAMETERS = {
    "scenario_seed": (0, UINT32_MAX, 2026), "sensor_layout_seed": (0, UINT32_MAX, 73),
    "duration": (4, 120, 20), "target_count": (1, 12, 4), "sensor_count": (1, 8, 3),
}
MAX_SWEEP_RUNS = 4096

# Controls that define a condition: everything but the scenario seed.
CONDITION_FIELDS = (
    "generator_version", "layout_seed", "duration_seconds", "target_count", "sensor_count", "tick_hz",
    "speed_min", "speed_max", "maneuver", "convergence", "spawn_spread", "coverage", "layout_spread",
    "noise", "reliability", "clutter", "evaluator_version", "fusion_config", "evaluation_gate")

# --- Fixed values: metric catalog (name, unit, definition) ------------------------------------
METRICS = (
    ("position_rmse", "m",
     "Per-run RMSE of matched confirmed/coasting tracks within the evaluation gate; null if no matches. "
     "Mean is equal-weight across non-null runs, not pooled sample RMSE."),
    ("missed_target_samples", "target-samples/run",
     "Unmatched truth target samples at evaluated scan timestamps, including out-of-coverage targets; "
     "not distinct missed targets."),
    ("missed_target_fraction", "fraction",
     "Missed target samples / target samples within each run; null if denominator is zero."),
    ("id_switches", "switches/run",
     "Changes in matched track identity for a previously matched truth target using the existing evaluator."),
    ("measurement_count", "measurements/run",
     "All recorded measurements, including clutter; not true detections or recall."),
    ("measurements_per_second", "measurements/s",
     "Total measurements divided by simulation duration, including endpoint scans."),
    ("measurements_per_scan", "measurements/scan",
     "Total measurements divided by all sensor scans; includes clutter."),
    ("false_track_samples", "track-samples/run",
     "Unmatched non-tentative tracks at evaluated timestamps; not false sensor returns."),
    ("unique_false_tracks", "tracks/run",
     "Distinct tracks unmatched at least once, as counted by the existing evaluator; not distinct false returns."),
)
# Which metrics each analysis reports.
ANALYSIS_METRICS = {
    "noise": ("position_rmse", "missed_target_samples", "missed_target_fraction", "id_switches"),
    "reliability": ("measurement_count", "measurements_per_second", "measurements_per_scan",
                    "missed_target_samples", "missed_target_fraction", "position_rmse"),
    "clutter": ("false_track_samples", "unique_false_tracks", "position_rmse", "measurement_count"),
    "convergence": ("id_switches", "false_track_samples", "unique_false_tracks", "position_rmse"),
    "sensor_network": ("measurement_count", "measurements_per_second", "measurements_per_scan",
                       "position_rmse"),
}
# Study panels: analysis -> (parameter, charted metrics).
STUDY_PANELS = {
    "noise": ("noise", ("position_rmse", "missed_target_samples", "id_switches")),
    "reliability": ("reliability", ("measurement_count", "position_rmse", "missed_target_samples")),
    "clutter": ("clutter", ("false_track_samples", "position_rmse")),
    "convergence": ("convergence", ("id_switches", "position_rmse", "false_track_samples")),
    "sensor_network": ("sensor_count", ("position_rmse", "measurement_count")),
}
METRIC_LABELS = {
    "position_rmse": "Tracking RMSE", "missed_target_samples": "Missed target samples",
    "id_switches": "ID switches", "measurement_count": "Measurement yield",
    "false_track_samples": "False track samples",
}
SEED_METRICS = ("position_rmse", "missed_target_samples", "false_track_samples", "unique_false_tracks",
                "id_switches")
