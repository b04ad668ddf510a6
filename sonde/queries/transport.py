"""Registered delivery queries over marks derived from the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonde.operators import transport as O
from sonde.queries.common import integers, rounded, with_ctes
from sonde.sources import adapters as A



def delivery_integrity(spark, d):
    return O.delivery_integrity(*A.delivered_events(spark, d), block_rows=8192)


def latency(spark, d):
    return rounded(O.latency(*A.traces(spark, d)), 6, "latency_ms")


def latency_percentiles(spark, d):
    out = O.latency_percentiles(O.latency(*A.traces(spark, d)))
    return rounded(out, 4, *O.PERCENTILES)


def throughput(spark, d):
    return rounded(O.throughput(*A.traces(spark, d)), 9, "produced_events_per_second", "consumed_events_per_second")


def backlog(spark, d):
    return O.backlog(*A.traces(spark, d), block_rows=2048).select(
        "experiment_id", "wall_ns", F.col("phase_order").cast("bigint"), "sequence", "outstanding_events")


def backlog_peaks(spark, d):
    return O.backlog_peaks(O.backlog(*A.traces(spark, d), block_rows=2048))


def catchup_seconds(spark, d):
    p, c = A.traces(spark, d)
    return rounded(O.catchup_seconds(O.backlog(p, c, block_rows=2048), c), 6, "catchup_seconds")


def clock_errors(spark, d):
    return O.clock_errors(*A.traces(spark, d), block_rows=8192)


def _ids(spark, d):
    expected, actual = A.delivered_events(spark, d)
    return [df.select(F.col("run_id").alias("experiment_id"), "stream_sequence", *extra) for df, extra in (
        (expected, ["payload"]), (actual, ["payload", "arrival"]))]


def trace_integrity(spark, d):
    expected, actual = (df.withColumnRenamed("stream_sequence", "sequence") for df in _ids(spark, d))
    return O.trace_integrity(*A.traces(spark, d), expected, actual)


def transport_comparison(spark, d):
    p, c = A.traces(spark, d)
    metrics = O.transport_metrics(p, c, *_ids(spark, d), block_rows=2048)
    return O.transport_comparison(O.as_summaries(
        metrics, F.concat(F.lit("group "), F.col("experiment_id").cast("string")), F.lit("local")))


def _outages(spark, d):
    """One outage per silent-prone sensor of each run: days 100 to 199.5 for every tenth sensor."""
    return A.table(spark, d, "customer").filter(F.col("c_nationkey") < 5).select(
        F.expr("c_custkey div 100 + 1").alias("run_id"), (F.col("c_custkey") % 100 + 1).cast("int").alias("sensor_id"),
        (F.lit(100.0) + F.col("c_nationkey") / 10).alias("start"), (F.lit(199.1) + F.col("c_nationkey")).alias("end"))


def per_sensor_stats(spark, d):
    return integers(O.per_sensor_stats(A.scans(spark, d), _outages(spark, d)), "sensor_id")


def outage_violations(spark, d):
    out = O.outage_violations(A.scans(spark, d), _outages(spark, d))
    return integers(out.select("run_id", "run_generation", "sensor_id", "stream_sequence"), "sensor_id")


def production_span(spark, d):
    from sonde.operators.summaries import production_span as span

    return span(A.traces(spark, d)[0])


QUERIES = {f.__name__: f for f in (
    delivery_integrity, latency, latency_percentiles, throughput, backlog, backlog_peaks, catchup_seconds, clock_errors,
    trace_integrity, transport_comparison, per_sensor_stats, outage_violations, production_span)}

TRACES = """raw AS (SELECT user_id // 16 + 1 AS experiment_id, event_id + 1 AS sequence, epoch_us(ts) * 1000 AS ns, event_type,
    CAST(trunc(value * 100) AS BIGINT) AS cents FROM events),
copies AS (SELECT *, unnest(CASE WHEN event_type = 'error' THEN [0, 1] ELSE [0] END) AS copy FROM raw),
produced AS (SELECT experiment_id, sequence * 2 + copy AS arrival, 'produced' AS phase, sequence, ns + copy * 1000000 AS wall_ns
  FROM copies),
consumed AS (SELECT experiment_id, (sequence // 8 * 8 + 7 - sequence % 8) * 2 + copy AS arrival,
  CASE WHEN event_type = 'click' AND cents % 25 = 0 THEN 'resume' ELSE 'consumed' END AS phase, sequence,
  ns + (cents - 120) * 1000000 AS wall_ns FROM copies WHERE event_type <> 'signup'),
p AS (SELECT experiment_id, sequence, arg_max(wall_ns, arrival) AS produced_ns FROM produced GROUP BY ALL),
c AS (SELECT experiment_id, sequence, arg_min(wall_ns, arrival) AS consumed_ns FROM consumed WHERE phase = 'consumed' GROUP BY ALL),
latencies AS (SELECT experiment_id, sequence, produced_ns, consumed_ns, (consumed_ns - produced_ns) / 1e6::DOUBLE AS latency_ms
  FROM p JOIN c USING (experiment_id, sequence)),
pc AS (SELECT * FROM p FULL JOIN c USING (experiment_id, sequence)),
marks AS (SELECT experiment_id, sequence, produced_ns AS wall_ns, 0 AS phase_order,
    CASE WHEN consumed_ns < produced_ns THEN 0 ELSE 1 END AS delta FROM pc WHERE produced_ns IS NOT NULL
  UNION ALL SELECT experiment_id, sequence, consumed_ns, 1,
    CASE WHEN produced_ns IS NULL OR consumed_ns < produced_ns THEN 0 ELSE -1 END FROM pc WHERE consumed_ns IS NOT NULL),
timeline AS (SELECT experiment_id, wall_ns, phase_order, sequence, CAST(sum(delta) OVER (PARTITION BY experiment_id
    ORDER BY wall_ns, phase_order, sequence ROWS UNBOUNDED PRECEDING) AS BIGINT) AS outstanding_events FROM marks),
rates AS (SELECT experiment_id, count(produced_ns) AS total_produced,
    CASE WHEN count(produced_ns) > 1 AND max(produced_ns) > min(produced_ns)
      THEN (count(produced_ns) - 1) * 1e9::DOUBLE / (max(produced_ns) - min(produced_ns)) END AS produced_rate,
    CASE WHEN count(consumed_ns) > 1 AND max(consumed_ns) > min(consumed_ns)
      THEN (count(consumed_ns) - 1) * 1e9::DOUBLE / (max(consumed_ns) - min(consumed_ns)) END AS consumed_rate
  FROM pc GROUP BY ALL),
peaks AS (SELECT experiment_id, max(outstanding_events) AS max_backlog,
    arg_max(outstanding_events, row(wall_ns, phase_order, sequence)) AS final_backlog FROM timeline GROUP BY ALL),
resumes AS (SELECT experiment_id, arg_max(wall_ns, arrival) AS resume_ns FROM consumed WHERE phase = 'resume' GROUP BY ALL),
around AS (SELECT experiment_id, resume_ns,
    coalesce(arg_max(outstanding_events, row(wall_ns, phase_order, sequence)) FILTER (WHERE wall_ns <= resume_ns), 0) AS lag,
    min(wall_ns) FILTER (WHERE wall_ns >= resume_ns AND outstanding_events = 0) AS empty_ns
  FROM resumes JOIN timeline USING (experiment_id) GROUP BY ALL),
catchup AS (SELECT experiment_id, (CASE WHEN lag = 0 THEN resume_ns ELSE empty_ns END - resume_ns) / 1e9::DOUBLE AS catchup_seconds
  FROM around),
stepped AS (SELECT experiment_id, wall_ns < lag(wall_ns) OVER (PARTITION BY experiment_id ORDER BY arrival) AS back FROM produced
  UNION ALL SELECT experiment_id, wall_ns < lag(wall_ns) OVER (PARTITION BY experiment_id ORDER BY arrival) FROM consumed
  UNION ALL SELECT experiment_id, latency_ms < 0 FROM latencies)"""

DELIVERED = """raw_events AS (SELECT user_id // 16 + 1 AS run_id, event_id + 1 AS stream_sequence, event_type, value FROM events),
expected AS (SELECT run_id, stream_sequence, value AS payload FROM raw_events WHERE event_type <> 'click'),
actual AS (SELECT run_id, stream_sequence, (stream_sequence // 8 * 8 + 7 - stream_sequence % 8) * 3 + copy AS arrival,
    value + CASE WHEN copy = 2 THEN 1 WHEN event_type = 'view' AND stream_sequence % 11 = 0 THEN 2 ELSE 0 END AS payload
  FROM (SELECT *, unnest(CASE WHEN event_type = 'error' THEN [0, 1, 2] WHEN event_type = 'signup' THEN [] ELSE [0] END) AS copy
    FROM raw_events)),
ranked AS (SELECT *, row_number() OVER k AS occurrence, first_value(payload) OVER k AS first_payload FROM actual
  WINDOW k AS (PARTITION BY run_id, stream_sequence ORDER BY arrival)),
firsts AS (SELECT *, stream_sequence <= coalesce(lag(stream_sequence) OVER (PARTITION BY run_id ORDER BY arrival), 0) AS disorder
  FROM ranked WHERE occurrence = 1),
integrity AS (SELECT run_id,
    (SELECT count(*) FROM ranked r WHERE r.run_id = ids.run_id AND occurrence > 1) AS duplicate_count,
    (SELECT count(*) FROM ranked r WHERE r.run_id = ids.run_id AND payload <> first_payload) AS conflicting_duplicate_count,
    (SELECT count(*) FROM expected e LEFT JOIN firsts f USING (run_id, stream_sequence)
      WHERE e.run_id = ids.run_id AND f.arrival IS NULL) AS missing_sequence_count,
    (SELECT count(*) FROM firsts f WHERE f.run_id = ids.run_id AND disorder) AS ordering_violations,
    (SELECT count(*) FROM firsts f LEFT JOIN expected e USING (run_id, stream_sequence)
      WHERE f.run_id = ids.run_id AND e.payload IS NULL) AS unexpected_event_count,
    (SELECT count(*) FROM firsts f JOIN expected e USING (run_id, stream_sequence)
      WHERE f.run_id = ids.run_id AND e.payload <> f.payload) AS payload_mismatches
  FROM (SELECT DISTINCT run_id FROM raw_events) ids)"""

ORACLES = {
    "delivery_integrity": f"""WITH {DELIVERED}
    SELECT *, duplicate_count + conflicting_duplicate_count + missing_sequence_count + ordering_violations
      + unexpected_event_count + payload_mismatches = 0 AS integrity_pass FROM integrity""",
    "latency": f"""WITH {TRACES}
    SELECT experiment_id, sequence, produced_ns, consumed_ns, round(latency_ms, 6) AS latency_ms FROM latencies""",
    "latency_percentiles": f"""WITH {TRACES}
    SELECT experiment_id, round(quantile_cont(latency_ms, 0.5), 4) AS latency_p50_ms,
      round(quantile_cont(latency_ms, 0.95), 4) AS latency_p95_ms, round(quantile_cont(latency_ms, 0.99), 4) AS latency_p99_ms
    FROM latencies GROUP BY ALL""",
    "throughput": f"""WITH {TRACES}
    SELECT experiment_id, total_produced, round(produced_rate, 9) AS produced_events_per_second,
      round(consumed_rate, 9) AS consumed_events_per_second FROM rates""",
    "backlog": f"""WITH {TRACES}
    SELECT experiment_id, wall_ns, CAST(phase_order AS BIGINT) AS phase_order, sequence, outstanding_events FROM timeline""",
    "backlog_peaks": f"WITH {TRACES} SELECT * FROM peaks",
    "catchup_seconds": f"""WITH {TRACES}
    SELECT experiment_id, round(catchup_seconds, 6) AS catchup_seconds FROM catchup""",
    "clock_errors": f"""WITH {TRACES}
    SELECT experiment_id, count(*) AS clock_errors FROM stepped WHERE back GROUP BY experiment_id""",
    "trace_integrity": f"""WITH {TRACES}, {DELIVERED}, ids AS (
      SELECT experiment_id, sequence, 'p' AS k FROM produced UNION ALL SELECT experiment_id, sequence, 'c' FROM consumed
        WHERE phase = 'consumed'
      UNION ALL SELECT run_id, stream_sequence, 'e' FROM expected UNION ALL SELECT run_id, stream_sequence, 'a' FROM actual),
    per_id AS (SELECT experiment_id, sequence, count(*) FILTER (WHERE k = 'p') AS np, count(*) FILTER (WHERE k = 'c') AS nc,
      count(*) FILTER (WHERE k = 'e') AS ne, count(*) FILTER (WHERE k = 'a') AS na FROM ids GROUP BY ALL)
    SELECT experiment_id, count(*) FILTER (WHERE (np > 0) <> (ne > 0) OR (nc > 0) <> (na > 0) OR np > 1 OR nc > 1) AS wrong_ids,
      count(*) FILTER (WHERE (np > 0) <> (ne > 0) OR (nc > 0) <> (na > 0) OR np > 1 OR nc > 1) = 0 AS trace_integrity_pass
    FROM per_id GROUP BY experiment_id""",
    "transport_comparison": f"""WITH {TRACES}, {DELIVERED}, pct AS (
      SELECT experiment_id, quantile_cont(latency_ms, 0.5) AS p50, quantile_cont(latency_ms, 0.95) AS p95,
        quantile_cont(latency_ms, 0.99) AS p99 FROM latencies GROUP BY ALL),
    used AS (SELECT experiment_id, count(*) AS consumed FROM consumed WHERE phase = 'consumed' GROUP BY ALL)
    SELECT 'group ' || run_id AS scenario, 'local' AS transport, total_produced AS produced, consumed,
      round(produced_rate, 2) AS produced_eps, round(consumed_rate, 2) AS consumed_eps, round(p50, 2) AS p50_ms,
      round(p95, 2) AS p95_ms, round(p99, 2) AS p99_ms, max_backlog, round(catchup_seconds, 3) AS recovery_seconds,
      duplicate_count AS duplicates, missing_sequence_count AS missing, false AS integrity_pass
    FROM integrity JOIN rates r ON r.experiment_id = run_id JOIN used u ON u.experiment_id = run_id
      JOIN pct q ON q.experiment_id = run_id JOIN peaks k ON k.experiment_id = run_id
      LEFT JOIN catchup c ON c.experiment_id = run_id""",
    "per_sensor_stats": with_ctes("scans", """, outages AS (
      SELECT c_custkey // 100 + 1 AS run_id, c_custkey % 100 + 1 AS sensor_id, CAST(100.0::DOUBLE + c_nationkey / 10 AS FLOAT) AS a,
        CAST(199.1::DOUBLE + c_nationkey AS FLOAT) AS b FROM customer WHERE c_nationkey < 5)
    SELECT run_id, sensor_id, count(*) AS scans, CAST(sum(measurement_count) AS BIGINT) AS detections,
      count(*) FILTER (WHERE acquisition_time_seconds >= a AND acquisition_time_seconds < b) AS outage_scans
    FROM scans LEFT JOIN outages USING (run_id, sensor_id) GROUP BY ALL"""),
    "outage_violations": with_ctes("scans", """, outages AS (
      SELECT c_custkey // 100 + 1 AS run_id, c_custkey % 100 + 1 AS sensor_id, CAST(100.0::DOUBLE + c_nationkey / 10 AS FLOAT) AS a,
        CAST(199.1::DOUBLE + c_nationkey AS FLOAT) AS b FROM customer WHERE c_nationkey < 5)
    SELECT run_id, run_generation, sensor_id, stream_sequence FROM scans JOIN outages USING (run_id, sensor_id)
    WHERE acquisition_time_seconds >= a AND acquisition_time_seconds < b"""),
    "production_span": f"""WITH {TRACES}
    SELECT count(*) AS production_marks, (arg_max(wall_ns, arrival) - arg_min(wall_ns, arrival)) / 1e6::DOUBLE
      AS production_wall_span_ms FROM produced""",
}
