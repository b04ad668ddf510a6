"""Registered validation-rule queries.  The damaged order stream violates each lifecycle rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonde.operators import rules as R
from sonde.queries.common import integers, with_ctes
from sonde.sources import adapters as A

RULES = tuple(r for r in R.LIFECYCLE_RULES)


def _counts(violations):
    return violations.groupBy("source", "rule").agg(F.count(F.lit(1)).alias("violations"))


def validate_events(spark, d):
    return _counts(R.validate_events(A.ragged_events(spark, d), block_rows=2048))


def _one_rule(rule):
    def query(spark, d):
        events = R.dedup_events(A.ragged_events(spark, d))
        found = R.lifecycle_violations(events, block_rows=2048, only=(rule,))
        return found.groupBy("source").agg(
            F.count(F.lit(1)).alias("violations"), F.min("stream_sequence").alias("first_sequence"),
            F.max("stream_sequence").alias("last_sequence"))

    query.__name__ = rule
    return query


def dedup_events(spark, d):
    unique = R.dedup_events(A.ragged_events(spark, d))
    return integers(unique.groupBy("source").agg(
        F.count(F.lit(1)).alias("events"), F.sum(F.col("copies") - 1).alias("duplicates_removed"),
        F.sum("line_no").alias("line_total")), "events", "duplicates_removed", "line_total")


def conflicting_duplicates(spark, d):
    unique = R.dedup_events(A.ragged_events(spark, d))
    return unique.filter(F.col("conflicts") > 0).select(
        "source", F.col("run_id").cast("bigint"), "stream_sequence", "copies", "conflicts")


def reconcile_counts(spark, d):
    tables = {"events": A.events(spark, d), "scans": A.scans(spark, d), "measurements": A.measurements(spark, d)}
    actual = R.table_counts(tables)
    expected = A.events(spark, d).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "MEASUREMENTS").alias("scans"),
        F.sum(F.when(F.col("measurement_count") > 1, F.col("measurement_count"))).alias("measurements"))
    return _run_violations(R.reconcile_counts(expected, actual))


def reconcile_event_scan(spark, d):
    scans = A.scans(spark, d).withColumn(
        "measurement_count", F.when(F.col("sensor_id") == 7, F.col("measurement_count") + 1).otherwise(F.col("measurement_count")))
    return _run_violations(R.reconcile_event_scan(A.events(spark, d), scans))


def reconcile_scan_measurements(spark, d):
    kept = A.measurements(spark, d).filter(F.col("detection_id") != 7)
    scans = A.scans(spark, d).filter(F.col("sensor_id") != 9)
    return _run_violations(R.reconcile_scan_measurements(scans, kept))


def table_keys(spark, d):
    found = R.repeated_keys(
        A.measurements(spark, d), ["run_id", "run_generation", "sensor_id", "sensor_generation", "detection_id"])
    return _run_violations(found)


def not_null(spark, d):
    from sonde import schemas

    return _run_violations(R.null_columns(
        A.ragged_events(spark, d).withColumn("sensor_id", F.col("sensor_id")), _required_scan_schema(schemas)))


def _required_scan_schema(schemas):
    from pyspark.sql import types as T

    return T.StructType([T.StructField("run_id", schemas.RUN_ID, False), T.StructField("sensor_id", T.IntegerType(), False),
                         T.StructField("scan_sequence", T.LongType(), False)])


def _run_violations(found):
    return found.groupBy(F.col("run_id").cast("bigint").alias("run_id")).agg(F.count(F.lit(1)).alias("violations"))


QUERIES = {f.__name__: f for f in (
    validate_events, dedup_events, conflicting_duplicates, reconcile_counts, reconcile_event_scan,
    reconcile_scan_measurements, table_keys, not_null)}
QUERIES.update({rule: _one_rule(rule) for rule in RULES})

RAGGED = """ragged AS (
  SELECT CAST(o_custkey // 100 + 1 AS VARCHAR) AS source, o_orderkey AS line_no,
    CASE WHEN o_orderstatus = 'P' THEN o_custkey % 7 + 1 ELSE o_custkey // 100 + 1 END AS run_id,
    o_orderkey // 500 AS run_generation, o_orderkey // 3 + 1 AS stream_sequence,
    CAST(dayofyear(o_orderdate) - 3 AS FLOAT) AS t,
    CASE WHEN o_orderkey % 50 = 7 THEN 'RUN_RESET' WHEN o_orderkey % 211 = 5 AND o_custkey % 3 = 0 THEN 'RUN_FINISHED' WHEN o_orderpriority = '1-URGENT' THEN 'SENSOR_STARTED'
      WHEN o_orderpriority = '5-LOW' THEN 'SENSOR_RESET' ELSE 'MEASUREMENTS' END AS kind,
    o_custkey % 10 + 1 AS raw_sensor, month(o_orderdate) // 5 AS raw_generation, o_orderkey // 40 % 9 AS raw_scan,
    CAST(trunc(o_totalprice) AS BIGINT) % 4 AS raw_count, CAST(o_totalprice / 1000 - 5 AS FLOAT) AS raw_value
  FROM orders),
typed AS (
  SELECT source, line_no, run_id, run_generation, stream_sequence, t, kind,
    CASE WHEN kind NOT IN ('RUN_RESET', 'RUN_FINISHED') THEN raw_sensor END AS sensor_id,
    CASE WHEN kind NOT IN ('RUN_RESET', 'RUN_FINISHED') THEN raw_generation END AS sensor_generation,
    CASE WHEN kind = 'MEASUREMENTS' THEN raw_scan END AS scan_sequence,
    CASE WHEN kind = 'MEASUREMENTS' THEN raw_count ELSE 0 END AS n,
    CASE WHEN kind = 'MEASUREMENTS' THEN raw_value END AS v,
    CASE WHEN kind = 'SENSOR_STARTED' THEN raw_scan END AS seed FROM ragged),
payloads AS (SELECT *, concat_ws('|', kind, run_generation, t, coalesce(sensor_id, -1), coalesce(sensor_generation, -1),
    coalesce(scan_sequence, -1), n, coalesce(seed, -1), CASE WHEN n > 0 THEN v END) AS payload FROM typed),
ranked AS (SELECT *, row_number() OVER k AS occurrence, count(*) OVER (PARTITION BY source, run_id, stream_sequence) AS copies,
    first_value(payload) OVER k AS first_payload FROM payloads
  WINDOW k AS (PARTITION BY source, run_id, stream_sequence ORDER BY line_no)),
unique_events AS (SELECT * FROM ranked WHERE occurrence = 1),
s1 AS (SELECT *, row_number() OVER w AS position, count(*) FILTER (WHERE kind = 'RUN_RESET') OVER w AS resets,
    lag(run_id) OVER w AS previous_run, lag(t) OVER w AS previous_time,
    coalesce(max(line_no) FILTER (WHERE kind = 'RUN_RESET') OVER p, 0) AS reset_line,
    max(line_no) FILTER (WHERE kind IN ('MEASUREMENTS', 'SENSOR_RESET')) OVER p AS scan_line,
    max(line_no) FILTER (WHERE kind = 'SENSOR_STARTED') OVER p AS start_line,
    max(line_no) FILTER (WHERE kind = 'RUN_FINISHED') OVER p AS finish_line,
    arg_max(sensor_id, line_no) FILTER (WHERE kind = 'SENSOR_STARTED') OVER p AS start_sensor
  FROM unique_events
  WINDOW w AS (PARTITION BY source ORDER BY line_no),
    p AS (PARTITION BY source ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s2 AS (SELECT *, count(*) FILTER (WHERE kind = 'SENSOR_STARTED') OVER s AS starts,
    count(*) FILTER (WHERE kind = 'SENSOR_RESET') OVER s AS sensor_resets,
    count(*) FILTER (WHERE kind = 'MEASUREMENTS') OVER l AS scan_count,
    sum(n) OVER l AS detection_count
  FROM s1
  WINDOW s AS (PARTITION BY source, run_generation, sensor_id ORDER BY line_no),
    l AS (PARTITION BY source, run_generation, sensor_id, sensor_generation ORDER BY line_no)),
checks AS (SELECT source, stream_sequence, unnest([
    CASE WHEN (position = 1) = (kind <> 'RUN_STARTED') THEN 'first_is_start' END,
    CASE WHEN position > 1 AND run_id <> previous_run THEN 'single_run' END,
    CASE WHEN stream_sequence <> position THEN 'sequence_contiguous' END,
    CASE WHEN t < 0 THEN 'finite_nonnegative_time' END,
    CASE WHEN kind = 'RUN_RESET' AND (run_generation <> resets OR t <> 0 OR position = 1) THEN 'run_reset_transition' END,
    CASE WHEN kind <> 'RUN_RESET' AND run_generation <> resets THEN 'generation_stable' END,
    CASE WHEN kind <> 'RUN_RESET' AND t < previous_time THEN 'time_monotone' END,
    CASE WHEN kind = 'SENSOR_STARTED' AND (coalesce(scan_line > reset_line, false) OR t <> 0 OR sensor_generation <> 0)
      THEN 'sensor_start_window' END,
    CASE WHEN kind = 'SENSOR_STARTED' AND start_line > reset_line AND sensor_id <= start_sensor THEN 'sensor_start_order' END,
    CASE WHEN kind IN ('SENSOR_RESET', 'MEASUREMENTS') AND starts = 0 THEN 'known_sensor' END,
    CASE WHEN kind = 'SENSOR_RESET' AND starts > 0 AND sensor_generation <> sensor_resets THEN 'sensor_reset_transition' END,
    CASE WHEN kind = 'MEASUREMENTS' AND starts > 0 AND sensor_generation <> sensor_resets THEN 'scan_generation' END,
    CASE WHEN kind = 'MEASUREMENTS' AND scan_sequence <> scan_count THEN 'scan_sequence_contiguous' END,
    CASE WHEN kind = 'MEASUREMENTS' AND n > 0 AND NOT (n = 1 AND detection_count - n + 1 = n) THEN 'detection_identity' END,
    CASE WHEN n > 0 AND (v < 0 OR v / 400 > 1) THEN 'measurement_values' END,
    CASE WHEN finish_line IS NOT NULL THEN 'nothing_after_finish' END]) AS rule FROM s2),
found AS (SELECT source, stream_sequence, rule FROM checks WHERE rule IS NOT NULL
  UNION ALL SELECT source, CAST(NULL AS BIGINT), 'finished' FROM unique_events GROUP BY source
    HAVING count(*) FILTER (WHERE kind = 'RUN_FINISHED') = 0)"""

ORACLES = {
    "validate_events": f"""WITH {RAGGED}, conflicts AS (SELECT source, run_id, stream_sequence,
      count(*) FILTER (WHERE payload <> first_payload) AS c FROM ranked GROUP BY ALL)
    SELECT source, rule, count(*) AS violations FROM (SELECT source, rule FROM found
      UNION ALL SELECT source, 'conflicting_duplicate' FROM conflicts WHERE c > 0) GROUP BY ALL""",
    "dedup_events": f"""WITH {RAGGED}
    SELECT source, count(*) AS events, CAST(sum(copies - 1) AS BIGINT) AS duplicates_removed,
      CAST(sum(line_no) AS BIGINT) AS line_total FROM unique_events GROUP BY source""",
    "conflicting_duplicates": f"""WITH {RAGGED}
    SELECT source, run_id, stream_sequence, count(*) AS copies, count(*) FILTER (WHERE payload <> first_payload) AS conflicts
    FROM ranked GROUP BY ALL HAVING count(*) FILTER (WHERE payload <> first_payload) > 0""",
    "reconcile_counts": with_ctes("scans measurements started domain_events", """, e AS (
      SELECT run_id, count(*) AS events, count(*) FILTER (WHERE event_type = 'MEASUREMENTS') AS scans,
        sum(measurement_count) FILTER (WHERE measurement_count > 1) AS measurements FROM domain_events GROUP BY run_id),
    m AS (SELECT run_id, count(*) AS n FROM measurements GROUP BY run_id)
    SELECT run_id, count(*) AS violations FROM e FULL JOIN m USING (run_id)
    WHERE measurements IS DISTINCT FROM coalesce(n, 0) GROUP BY run_id"""),
    "reconcile_event_scan": with_ctes("scans", """
    SELECT run_id, count(*) AS violations FROM scans WHERE sensor_id = 7 GROUP BY run_id"""),
    "reconcile_scan_measurements": with_ctes("scans measurements", """, m AS (
      SELECT run_id, stream_sequence, count(*) AS n FROM measurements WHERE detection_id <> 7 GROUP BY ALL),
    s AS (SELECT * FROM scans WHERE sensor_id <> 9)
    SELECT run_id, count(*) AS violations FROM s FULL JOIN m USING (run_id, stream_sequence)
    WHERE measurement_count IS NULL OR measurement_count <> coalesce(n, 0) GROUP BY run_id"""),
    "table_keys": with_ctes("measurements", """
    SELECT run_id, count(*) AS violations FROM (
      SELECT run_id FROM measurements GROUP BY run_id, run_generation, sensor_id, sensor_generation, detection_id
      HAVING count(*) > 1) GROUP BY run_id"""),
    "not_null": f"""WITH {RAGGED}
    SELECT run_id, count(*) AS violations FROM typed WHERE sensor_id IS NULL OR scan_sequence IS NULL GROUP BY run_id""",
}
for _rule in RULES:
    ORACLES[_rule] = f"""WITH {RAGGED}
    SELECT source, count(*) AS violations, min(stream_sequence) AS first_sequence, max(stream_sequence) AS last_sequence
    FROM found WHERE rule = '{_rule}' GROUP BY source"""
