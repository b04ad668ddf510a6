"""Registered rule queries for track frames and analytical artifacts, over damaged derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonde.operators import rules as R
from sonde.queries.evaluation import FRAMED
from sonde.queries.sources import RECORDED
from sonde.sources import adapters as A


def _counts(found):
    return found.groupBy("rule", F.coalesce("detail", F.lit("")).alias("detail")).agg(F.count(F.lit(1)).alias("violations"))


def track_frame_rules(spark, d):
    """Frames of 32 events per run: generations, times, kinds and repeated ids are all off somewhere."""
    frames = A.frames(spark, d).withColumn("source", F.col("run_id").cast("string")).withColumn(
        "line_no", F.col("source_sequence"))
    seq = F.col("source_sequence")
    frames = frames.withColumn("acquisition_time", F.when(seq % 10 == 7, 0.0).otherwise(F.col("acquisition_time"))).withColumn(
        "source_type", F.when(seq == 17, "RUN_RESET").when(seq % 9 == 1, "RUN_STARTED").otherwise("MEASUREMENTS"))
    return R.track_frame_rules(frames, block_rows=8).groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))


def _runs(spark, d):
    runs, metrics = A.experiments(spark, d)
    return runs.drop("experiment_id", "experiment_name", "seed"), metrics


def analytical_identity(spark, d):
    """Runs count as clean if their customer has a finished urgent order."""
    clean = A.table(spark, d, "orders").filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select((F.col("o_custkey") + 1).alias("run_id"))
    found = R.analytical_identity(_runs(spark, d)[0], clean)
    return found.select(F.col("run_id").cast("bigint"))


def analytical_nulls(spark, d):
    found = R.analytical_nulls(_runs(spark, d)[1])
    return found.select(F.col("run_id").cast("bigint"))


def analytical_finite(spark, d):
    runs = _runs(spark, d)[0].withColumn(
        "noise", F.when(F.col("run_id") % 7 == 2, F.lit(float("inf"))).when(F.col("run_id") % 7 == 4, F.lit(float("nan"))).otherwise(F.col("noise")))
    return R.analytical_finite(runs).select(F.col("run_id").cast("bigint"))


def metadata_row(spark, d):
    runs = A.table(spark, d, "orders").select(
        F.col("o_custkey").alias("run_id"), (F.col("o_orderkey") % 30).alias("duration_seconds"), F.lit(1).alias("target_count"),
        F.lit(1).alias("sensor_count"), (F.lit(8) + F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)).alias("tick_hz"))
    return _counts(R.metadata_row(runs).withColumn("detail", F.when(F.col("detail").isNotNull(), "repeated")))


def sensor_metadata(spark, d):
    """Recordings declare four sensors with seeds 7, 14, 21, 28; the metadata of some runs differ."""
    events = A.recordings(spark, d)
    runs = events.filter("event_type = 'RUN_STARTED'").select(
        "run_id", (F.lit(4) + F.when(F.col("run_id") % 3 == 0, 1).otherwise(0)).alias("sensor_count"))
    sensors = events.filter("event_type = 'SENSOR_STARTED'").select(
        "run_id", "sensor_id", F.when((F.col("run_id") % 2 == 0) & (F.col("sensor_id") == 2), 1).otherwise(F.col("seed")).alias("seed"))
    return _counts(R.sensor_metadata(runs, sensors, events))


def frames_match_events(spark, d):
    events = A.recordings(spark, d)
    frames = events.filter(F.col("stream_sequence") % 20 != 3).select(
        "run_id", F.col("stream_sequence").alias("source_sequence"),
        (F.col("event_time_seconds") + F.when(F.col("stream_sequence") % 20 == 8, 1).otherwise(0)).cast("double").alias("acquisition_time"),
        F.col("event_type").alias("source_type"), "run_generation")
    found = R.frames_match_events(frames, events)
    return found.select(F.col("run_id").cast("bigint"), "stream_sequence")


def complete_generation(spark, d):
    frames = A.frames(spark, d)
    runs = frames.groupBy("run_id").agg(F.max("acquisition_time").alias("duration_seconds"))
    return R.complete_generation(frames.filter("source_sequence <= 16"), runs).select(F.col("run_id").cast("bigint"))


def truth_grid(spark, d):
    """Planned runs per customer of two seconds and two targets; truth rows lost, added and repeated."""
    runs = A.table(spark, d, "customer").select(
        F.col("c_custkey").alias("run_id"), F.lit(2).alias("duration_seconds"), F.lit(2).alias("target_count"), F.lit(8).alias("tick_hz"))
    tick = (F.col("timestamp") * 8).cast("int")
    truth = R.expected_truth(runs).filter(~((F.col("run_id") % 11 == 3) & (tick == 5))).withColumn(
        "timestamp", F.when((F.col("run_id") % 13 == 4) & (tick == 6), F.col("timestamp") + 0.01).otherwise(F.col("timestamp"))).withColumn(
        "n", F.explode(F.sequence(F.lit(1), F.when((F.col("run_id") % 17 == 5) & (tick == 7), 2).otherwise(1)))).drop("n")
    return _counts(R.truth_grid(runs, truth).withColumn(
        "detail", F.when(F.col("detail").isin("missing", "unexpected"), F.col("detail")).otherwise("repeated")))


def analysis_relations(spark, d):
    scans = A.scans(spark, d)
    sensors = scans.filter("sensor_id <> 5").select("run_id", "sensor_id").distinct()
    tracks = scans.select(
        "run_id", "run_generation", (F.col("stream_sequence") + F.when(F.col("sensor_id") == 6, 10000000000).otherwise(0)).alias("source_sequence"),
        F.col("acquisition_time_seconds").alias("acquisition_time"), F.col("sensor_id").alias("track_id"))
    events = scans.select("run_id", "stream_sequence")
    metrics = scans.groupBy("run_id").agg(
        F.countDistinct("acquisition_time_seconds").alias("times"), F.count(F.lit(1)).alias("target_samples")).select(
        "run_id", "target_samples", (F.col("target_samples") - 1).alias("matched_samples"),
        (F.lit(1) + F.col("run_id") % 2).alias("missed_target_samples"),
        (F.col("times") + F.when(F.col("run_id") % 3 == 0, 1).otherwise(0)).alias("evaluated_frames"))
    found = R.analysis_relations(scans, sensors, tracks, events, metrics)
    known = ("scan without sensor", "track without event", "evaluated frames", "target samples")
    return _counts(found.withColumn("detail", F.when(F.col("detail").isin(*known), F.col("detail")).otherwise("repeated track")))


QUERIES = {f.__name__: f for f in (
    track_frame_rules, analytical_identity, analytical_nulls, analytical_finite, metadata_row, sensor_metadata,
    frames_match_events, complete_generation, truth_grid, analysis_relations)}

ORACLES = {
    "track_frame_rules": f"""WITH {FRAMED}, f AS (SELECT run_id, source_sequence AS seq, run_generation AS g,
      CASE WHEN source_sequence % 10 = 7 THEN 0.0::DOUBLE ELSE (source_sequence - 1) / 4 END AS t,
      CASE WHEN source_sequence = 17 THEN 'RUN_RESET' WHEN source_sequence % 9 = 1 THEN 'RUN_STARTED' ELSE 'MEASUREMENTS' END AS kind,
      count(track_id) FILTER (WHERE event_type IN ('view', 'click', 'error')) AS n,
      count(DISTINCT track_id) FILTER (WHERE event_type IN ('view', 'click', 'error')) AS u FROM framed GROUP BY ALL),
    s AS (SELECT *, row_number() OVER w AS position, count(*) FILTER (WHERE kind = 'RUN_RESET') OVER w AS resets,
      lag(t) OVER w AS pt, last_value(kind) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING
        AND UNBOUNDED FOLLOWING) AS final FROM f WINDOW w AS (PARTITION BY run_id ORDER BY seq)),
    v AS (SELECT run_id, unnest([CASE WHEN position = 1 AND kind <> 'RUN_STARTED' THEN 'frame_start' END,
      CASE WHEN seq <> position THEN 'frame_order' END, CASE WHEN kind = 'RUN_RESET' AND t <> 0 THEN 'frame_reset' END,
      CASE WHEN g <> resets OR t < CASE WHEN position = 1 OR kind = 'RUN_RESET' THEN 0 ELSE pt END THEN 'frame_generation_time' END,
      CASE WHEN n <> u THEN 'track_identity' END, CASE WHEN position = 1 AND final <> 'RUN_FINISHED' THEN 'frame_finish' END]) AS rule FROM s)
    SELECT rule, count(*) AS violations FROM v WHERE rule IS NOT NULL GROUP BY rule""",
    "analytical_identity": """SELECT c_custkey + 1 AS run_id FROM customer WHERE c_custkey NOT IN (
      SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')""",
    "analytical_nulls": """SELECT c_custkey + 1 AS run_id FROM customer
    ANTI JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON o_custkey = c_custkey""",
    "analytical_finite": "SELECT c_custkey + 1 AS run_id FROM customer WHERE (c_custkey + 1) % 7 IN (2, 4)",
    "metadata_row": """SELECT 'metadata_row' AS rule, 'repeated' AS detail, count(*) AS violations
      FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0
    UNION ALL SELECT 'metadata_row', '', count(*) FROM orders WHERE o_orderkey % 30 = 0 OR o_orderstatus = 'P'""",
    "sensor_metadata": f"""WITH {RECORDED}, runs AS (SELECT DISTINCT run_id FROM raw)
    SELECT 'sensor_metadata' AS rule, 'count' AS detail, count(*) AS violations FROM runs WHERE run_id % 3 = 0
    UNION ALL SELECT 'sensor_metadata', 'not in metadata', count(*) FROM runs WHERE run_id % 2 = 0
    UNION ALL SELECT 'sensor_metadata', 'not in recording', count(*) FROM runs WHERE run_id % 2 = 0""",
    "frames_match_events": f"""WITH {RECORDED}
    SELECT run_id, stream_sequence FROM recorded WHERE stream_sequence % 20 IN (3, 8)""",
    "complete_generation": """SELECT DISTINCT run_id FROM (SELECT event_id // 1024 + 1 AS run_id, max(event_id % 1024 // 32) AS last
      FROM events GROUP BY 1) WHERE last > 15""",
    "truth_grid": """WITH per AS (SELECT count(*) FILTER (WHERE c_custkey % 11 = 3) AS lost, count(*) FILTER (WHERE c_custkey % 13 = 4) AS moved,
      count(*) FILTER (WHERE c_custkey % 17 = 5) AS twice FROM customer)
    SELECT 'truth_grid' AS rule, 'missing' AS detail, (lost + moved) * 2 AS violations FROM per
    UNION ALL SELECT 'truth_grid', 'unexpected', moved * 2 FROM per UNION ALL SELECT 'truth_grid', 'repeated', twice * 2 FROM per""",
}
from sonde.queries.common import with_ctes  # noqa: E402

ORACLES["analysis_relations"] = with_ctes("scans", """, runs AS (SELECT DISTINCT run_id FROM scans)
    SELECT 'analysis_relations' AS rule, 'scan without sensor' AS detail, count(*) AS violations FROM scans WHERE sensor_id = 5
    UNION ALL SELECT 'analysis_relations', 'track without event', count(*) FROM scans WHERE sensor_id = 6
    UNION ALL SELECT 'analysis_relations', 'repeated track', count(*) FROM (SELECT 1 FROM scans
      GROUP BY run_id, run_generation, acquisition_time_seconds, sensor_id HAVING count(*) > 1) HAVING count(*) > 0
    UNION ALL SELECT 'analysis_relations', 'evaluated frames', count(*) FROM runs WHERE run_id % 3 = 0 HAVING count(*) > 0
    UNION ALL SELECT 'analysis_relations', 'target samples', count(*) FROM runs WHERE run_id % 2 = 1""")
