"""Registered summary queries and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonde.operators import summaries as S
from sonde.queries.common import integers, rounded, with_ctes
from sonde.sources import adapters as A


def sensor_summary(spark, d):
    out = S.sensor_summary(A.events(spark, d), A.scans(spark, d))
    return integers(rounded(out, 6, "empty_scan_pct", "detections_per_scan"), "sensor_id")


def event_counts(spark, d):
    return S.event_counts(A.events(spark, d))


def run_summary(spark, d):
    out = S.run_summary(A.events(spark, d), A.scans(spark, d))
    return rounded(out, 3, "last_event_time_seconds")


def scan_cadence(spark, d):
    out = S.scan_cadence(A.scans(spark, d), F.expr("cast(acquisition_time_seconds as bigint) div 64"))
    out = rounded(out, 6, "min_interval_seconds", "mean_interval_seconds", "max_interval_seconds", "observed_hz")
    return integers(out, "sensor_id")


def detections_over_time(spark, d):
    return integers(S.detections_over_time(A.scans(spark, d)), "sensor_id")


def measurement_distribution(spark, d):
    out = S.measurement_distribution(A.measurements(spark, d))
    out = rounded(out, 6, "volume_pct", "mean_confidence", "mean_uncertainty_radius")
    return integers(rounded(out, 3, "min_x", "max_x", "min_y", "max_y"), "sensor_id")


def sensing_totals(spark, d):
    return S.sensing_totals(A.scans(spark, d))


QUERIES = {f.__name__: f for f in (
    sensor_summary, event_counts, run_summary, scan_cadence, detections_over_time, measurement_distribution,
    sensing_totals)}

ORACLES = {
    # A row of zeros for every started sensor, then one pass over both kinds of rows.
    "sensor_summary": with_ctes("scans started", """, parts AS (
      SELECT run_id, run_generation, sensor_id, true AS life, 0 AS scan, 0 AS found FROM started
      UNION ALL SELECT run_id, run_generation, sensor_id, false, 1, measurement_count FROM scans)
    SELECT run_id, run_generation, sensor_id, CAST(sum(scan) AS BIGINT) AS scans, CAST(sum(found) AS BIGINT) AS detections,
      CAST(sum(CASE WHEN scan = 1 AND found = 0 THEN 1 ELSE 0 END) AS BIGINT) AS empty_scans,
      round(avg(CASE WHEN scan = 1 THEN CASE WHEN found = 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END END), 6) AS empty_scan_pct,
      round(avg(CASE WHEN scan = 1 THEN found::DOUBLE END), 6) AS detections_per_scan
    FROM parts GROUP BY run_id, run_generation, sensor_id HAVING bool_or(life)"""),
    "event_counts": with_ctes("scans started domain_events", """
    SELECT run_id, run_generation, event_type, count(*) AS event_count FROM domain_events GROUP BY ALL"""),
    "run_summary": with_ctes("scans started domain_events", """, parts AS (
      SELECT run_id, run_generation, event_time_seconds AS t, sensor_id AS who, 1 AS event, 0 AS scan, 0 AS found FROM domain_events
      UNION ALL SELECT run_id, run_generation, NULL, NULL, 0, 1, measurement_count FROM scans)
    SELECT run_id, run_generation, CAST(sum(event) AS BIGINT) AS events, round(CAST(max(t) AS DOUBLE), 3) AS last_event_time_seconds,
      count(DISTINCT who) AS sensors, CAST(sum(scan) AS BIGINT) AS scans, CAST(sum(found) AS BIGINT) AS detections
    FROM parts GROUP BY run_id, run_generation HAVING sum(event) > 0"""),
    # Neighbours by their rank, not by a window's lag.
    "scan_cadence": with_ctes("scans", """, placed AS (
      SELECT run_id, run_generation, sensor_id, sensor_generation, acquisition_time_seconds AS t,
        rank() OVER (PARTITION BY run_id, run_generation, sensor_id, sensor_generation ORDER BY scan_sequence) AS place FROM scans),
    steps AS (
      SELECT b.run_id, b.run_generation, b.sensor_id, b.sensor_generation, b.t - a.t AS step
      FROM placed b LEFT JOIN placed a ON a.run_id = b.run_id AND a.run_generation = b.run_generation AND a.sensor_id = b.sensor_id
        AND a.sensor_generation = b.sensor_generation AND a.place = b.place - 1)
    SELECT run_id, run_generation, sensor_id, sensor_generation, count(*) AS scans,
      round(CAST(min(step) AS DOUBLE), 6) AS min_interval_seconds, round(CAST(avg(step) AS DOUBLE), 6) AS mean_interval_seconds,
      round(CAST(max(step) AS DOUBLE), 6) AS max_interval_seconds,
      round(CASE WHEN avg(step) <> 0 THEN 1.0::DOUBLE / avg(step) END, 6) AS observed_hz
    FROM steps GROUP BY run_id, run_generation, sensor_id, sensor_generation"""),
    "detections_over_time": with_ctes("scans", """, timed AS (
      SELECT run_id, run_generation, sensor_id, CAST(floor(acquisition_time_seconds) AS BIGINT) AS simulation_second, measurement_count AS found FROM scans)
    SELECT run_id, run_generation, sensor_id, simulation_second, count(found) AS scans, CAST(sum(found) AS BIGINT) AS detections,
      count(nullif(found > 0, true)) AS empty_scans FROM timed GROUP BY run_id, run_generation, sensor_id, simulation_second"""),
    "measurement_distribution": with_ctes("measurements", """, volume AS (
      SELECT run_id, run_generation, CAST(count(*) AS DOUBLE) AS everything FROM measurements GROUP BY run_id, run_generation)
    SELECT m.run_id, m.run_generation, m.sensor_id, count(*) AS detections, round(count(*) * 100.0::DOUBLE / any_value(v.everything), 6) AS volume_pct,
      round(avg(m.confidence), 6) AS mean_confidence, round(avg(m.uncertainty_radius), 6) AS mean_uncertainty_radius,
      round(CAST(min(m.x) AS DOUBLE), 3) AS min_x, round(CAST(max(m.x) AS DOUBLE), 3) AS max_x,
      round(CAST(min(m.y) AS DOUBLE), 3) AS min_y, round(CAST(max(m.y) AS DOUBLE), 3) AS max_y
    FROM measurements m JOIN volume v ON v.run_id = m.run_id AND v.run_generation = m.run_generation
    GROUP BY m.run_id, m.run_generation, m.sensor_id"""),
    "sensing_totals": with_ctes("scans", """
    SELECT run_id, count(*) AS scan_count, CAST(sum(measurement_count) AS BIGINT) AS measurement_count,
      count(*) FILTER (WHERE measurement_count = 0) AS empty_scan_count FROM scans GROUP BY run_id"""),
}
