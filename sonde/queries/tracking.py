"""Registered tracking queries.

Fusion runs over recordings made of the event table; it is a recurrence without a SQL oracle
(tests hold it against published results and against the unsplit fold).  What reads frames runs
over frames whose content SQL can spell as well.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sonde.operators import decode
from sonde.operators import summaries as S
from sonde.operators import tracking as L
from sonde.queries.common import integers, rounded, with_ctes
from sonde.queries.evaluation import FRAMED
from sonde.sources import adapters as A

KEY = ("run_id", "run_generation", "source_sequence")


def _fused(spark, d):
    return L.fuse_tracks(A.recordings(spark, d))


def fuse_tracks(spark, d):
    out = _fused(spark, d).select(
        "run_id", "source_sequence", "source_type", F.inline_outer("tracks"))
    return out.select("run_id", "source_sequence", "source_type", "track_id", "state", "x", "y", "observations")


def fuse_and_summarize(spark, d):
    return S.track_summary(L.track_samples(_fused(spark, d), ("track_id", "state", "last_seen", "observations")))


def track_samples(spark, d):
    # Two frames share each acquisition time, so only the later one counts.
    frames = A.frames(spark, d).withColumn("acquisition_time", F.floor(F.col("acquisition_time") * 2) / 2)
    out = L.track_samples(frames).select(*KEY, "acquisition_time", "track_id", "state", "x", "y", "sensor_count")
    return integers(out, "sensor_count")


def track_summary(spark, d):
    samples = L.track_samples(A.frames(spark, d))
    out = S.track_summary(samples.withColumn("last_seen", F.col("acquisition_time") - F.col("x") / 100))
    return integers(rounded(out, 6, "max_observation_age"), "contributing_sensors")


def associations(spark, d):
    return integers(L.associations(A.frames(spark, d)), "sensor_id", "detection_id")


def retirements(spark, d):
    return L.retirements(A.frames(spark, d))


def fusion_totals(spark, d):
    return integers(S.fusion_totals(A.frames(spark, d)), "associations", "retirements", "final_active_tracks")


def _single_tracks(frames):
    """One position per track and frame: track ids repeat inside the derived frames."""
    return frames.withColumn("tracks", F.filter("tracks", lambda t, i: ~F.exists(
        F.slice("tracks", 1, i), lambda o: o["track_id"] == t["track_id"])))


def track_trails(spark, d):
    frames = _single_tracks(A.frames(spark, d))
    out = L.track_trails(frames, block_rows=8)
    return integers(out, "age")


def playback_timeline(spark, d):
    events = A.scans(spark, d).withColumnRenamed("acquisition_time_seconds", "event_time_seconds").select(
        "run_id", "run_generation", "stream_sequence", "event_time_seconds")
    out = L.playback_timeline(events, block_rows=2048)
    return out.select("run_id", "stream_sequence", F.round("due_seconds", 3).alias("due_seconds"))


def sensor_state(spark, d):
    events = A.scans(spark, d).withColumn("event_type", F.lit("MEASUREMENTS")).withColumn("measurements", F.lit(None))
    return integers(L.sensor_state(events).drop("latest"), "sensor_id")


def world_observations(spark, d):
    out = decode.world_observations(A.measurements(spark, d)).drop("stream_sequence", "scan_sequence")
    return integers(rounded(out, 4, "x", "y", "confidence", "uncertainty_radius"), "sensor_id", "detection_id")


QUERIES = {f.__name__: f for f in (
    fuse_tracks, fuse_and_summarize, track_samples, track_summary, associations, retirements, fusion_totals, track_trails,
    playback_timeline, sensor_state, world_observations)}

SAMPLES = f"""{FRAMED},
states AS (SELECT run_id, run_generation, source_sequence, (source_sequence - 1) / 4 AS acquisition_time, track_id, x, y, event_type,
  CASE event_type WHEN 'view' THEN 'confirmed' WHEN 'click' THEN 'coasting' ELSE 'tentative' END AS state
  FROM framed WHERE event_type IN ('view', 'click', 'error'))"""
ORACLES = {
    "track_samples": f"""WITH {SAMPLES}, timed AS (SELECT DISTINCT run_id, run_generation, source_sequence,
      floor((source_sequence - 1) / 4 * 2) / 2 AS tick FROM framed),
    last AS (SELECT run_id, run_generation, tick, max(source_sequence) AS source_sequence FROM timed GROUP BY ALL)
    SELECT run_id, run_generation, source_sequence, tick AS acquisition_time, track_id, state, x, y, CAST(1 AS BIGINT) AS sensor_count
    FROM last JOIN states USING (run_id, run_generation, source_sequence)""",
    "track_summary": f"""WITH {SAMPLES}, placed AS (SELECT *, row_number() OVER (PARTITION BY run_id, run_generation, track_id
        ORDER BY acquisition_time) AS nth, row_number() OVER (PARTITION BY run_id, run_generation, track_id
        ORDER BY acquisition_time DESC) AS nth_last FROM states),
    tally AS (SELECT run_id, run_generation, track_id, histogram(state) AS h, max(x) / 100 AS age FROM states GROUP BY ALL),
    starts AS (SELECT run_id, run_generation, track_id, acquisition_time AS first_sample FROM placed WHERE nth = 1),
    stops AS (SELECT run_id, run_generation, track_id, acquisition_time AS last_sample FROM placed WHERE nth_last = 1)
    SELECT run_id, run_generation, track_id, first_sample, last_sample, CAST(list_sum(map_values(h)) AS BIGINT) AS samples,
      CAST(coalesce(h['tentative'], 0) AS BIGINT) AS tentative_samples, CAST(coalesce(h['coasting'], 0) AS BIGINT) AS coasting_samples,
      CAST(1 AS BIGINT) AS observations, CAST(1 AS BIGINT) AS contributing_sensors, round(age, 6) AS max_observation_age
    FROM starts JOIN stops USING (run_id, run_generation, track_id) JOIN tally USING (run_id, run_generation, track_id)""",
    "associations": f"""WITH {FRAMED}
    SELECT run_id, run_generation, source_sequence, (source_sequence - 1) / 4 AS acquisition_time, CAST(1 AS BIGINT) AS sensor_id,
      CAST(0 AS BIGINT) AS sensor_generation, source_sequence AS scan_sequence, target - 10 AS detection_id, track_id
    FROM framed WHERE event_type = 'view'""",
    "retirements": f"""WITH {FRAMED}
    SELECT run_id, run_generation, source_sequence, (source_sequence - 1) / 4 AS acquisition_time, track_id, 'timeout' AS reason
    FROM framed WHERE event_type = 'purchase'""",
    "fusion_totals": f"""WITH {FRAMED}, per AS (SELECT run_id, source_sequence,
      count(*) FILTER (WHERE event_type IN ('view', 'click', 'error')) AS active,
      count(*) FILTER (WHERE event_type = 'view') AS a, count(*) FILTER (WHERE event_type = 'purchase') AS r FROM framed GROUP BY ALL),
    created AS (SELECT run_id, count(DISTINCT track_id) AS tracks_created FROM framed
      WHERE event_type IN ('view', 'click', 'error') GROUP BY 1)
    SELECT run_id, count(*) AS snapshots, CAST(sum(a) AS BIGINT) AS associations, CAST(sum(r) AS BIGINT) AS retirements,
      arg_max(active, source_sequence) AS final_active_tracks, max(tracks_created) AS tracks_created
    FROM per JOIN created USING (run_id) GROUP BY run_id""",
    "track_trails": f"""WITH {SAMPLES}, single AS (SELECT run_id, source_sequence, track_id, x, y FROM (SELECT *, row_number() OVER (
        PARTITION BY run_id, source_sequence, track_id ORDER BY state, x, y) AS n FROM states) WHERE n = 1),
    live AS (SELECT run_id, track_id FROM single JOIN (SELECT run_id, max(source_sequence) AS source_sequence FROM framed GROUP BY 1)
      USING (run_id, source_sequence)),
    moved AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM single WINDOW w AS (PARTITION BY run_id, track_id
      ORDER BY source_sequence)),
    aged AS (SELECT run_id, source_sequence, track_id, x, y, row_number() OVER (PARTITION BY run_id, track_id
      ORDER BY source_sequence DESC) AS age FROM moved WHERE px IS NULL OR px <> x OR py <> y)
    SELECT aged.* FROM aged SEMI JOIN live USING (run_id, track_id) WHERE age <= 32""",
    "playback_timeline": with_ctes("scans", """, stepped AS (SELECT run_id, stream_sequence,
      CASE WHEN lag(run_generation) OVER w = run_generation
        THEN acquisition_time_seconds - lag(acquisition_time_seconds) OVER w ELSE 0 END AS step
      FROM scans WINDOW w AS (PARTITION BY run_id ORDER BY stream_sequence))
    SELECT run_id, stream_sequence, round(sum(step::DOUBLE) OVER (PARTITION BY run_id ORDER BY stream_sequence
      ROWS UNBOUNDED PRECEDING), 3) AS due_seconds FROM stepped"""),
    "sensor_state": with_ctes("scans", """, now AS (SELECT run_id, max(run_generation) AS run_generation FROM scans GROUP BY 1),
    lives AS (SELECT run_id, run_generation, sensor_id, sensor_generation, count(*) AS scans,
      CAST(sum(measurement_count) AS BIGINT) AS measurements FROM scans SEMI JOIN now USING (run_id, run_generation) GROUP BY ALL)
    SELECT * FROM lives QUALIFY sensor_generation = max(sensor_generation) OVER (PARTITION BY run_id, sensor_id)"""),
    "world_observations": with_ctes("measurements", """
    SELECT run_id, run_generation, sensor_id, sensor_generation, detection_id::BIGINT AS detection_id,
      acquisition_time_seconds::DOUBLE AS time, round(x::DOUBLE, 4) AS x, round(y::DOUBLE, 4) AS y,
      round(confidence::DOUBLE, 4) AS confidence, round(uncertainty_radius::DOUBLE, 4) AS uncertainty_radius FROM measurements"""),
}
