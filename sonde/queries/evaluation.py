"""Registered evaluation queries over frames of 32 consecutive events."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonde.operators import evaluation as M
from sonde.operators import spatial
from sonde.plans.ordered import row_blocks
from sonde.queries.common import rounded
from sonde.sources import adapters as A

GATE = 50.0


def _matched(spark, d):
    return M.match_frames(A.frames(spark, d), A.truth(spark, d), GATE)


def match_truth(spark, d):
    return rounded(M.match_truth(_matched(spark, d)), 6, "distance")


def missed_targets(spark, d):
    return M.missed_targets(_matched(spark, d))


def false_tracks(spark, d):
    return M.false_tracks(_matched(spark, d))


def unique_false_tracks(spark, d):
    return M.unique_false_tracks(_matched(spark, d))


def id_switches(spark, d):
    return M.id_switches(M.match_truth(_matched(spark, d)), row_blocks("source_sequence", 8)).select(
        *M.FRAME, "truth_id", "track_id", "previous_track_id")


def tentative_samples(spark, d):
    return _matched(spark, d).groupBy("run_id").agg(F.sum("tentative").alias("tentative_track_samples"))


def run_metrics(spark, d):
    out = M.run_metrics(A.frames(spark, d), A.truth(spark, d), GATE, block=row_blocks("source_sequence", 8))
    return rounded(out, 6, "position_rmse", "mean_position_error").drop("fusion_config")


def evaluation_guards(spark, d):
    frames, truth = A.frames(spark, d), A.truth(spark, d)
    # Every fifth truth frame is repeated, the time of every seventh is off, sequence 9 has no frame.
    seq = F.col("source_sequence")
    truth = truth.withColumn("n", F.explode(F.sequence(F.lit(1), F.when(seq % 5 == 0, 2).otherwise(1)))).drop("n")
    truth = truth.withColumn("acquisition_time", F.when(seq % 7 == 0, 99.5).otherwise(F.col("acquisition_time")))
    found = M.evaluation_guards(frames.filter(seq != 9), truth)
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))


def points(frames, truth):
    """Tracks and targets of frames as rows."""
    tracks = frames.select(*M.FRAME, F.inline("tracks")).select(*M.FRAME, "track_id", "x", "y")
    return tracks, truth.select(*M.FRAME, F.inline("entities")).select(*M.FRAME, "truth_id", "x", "y")


def gated_join(spark, d):
    return rounded(spatial.gated_join(*points(A.frames(spark, d), A.truth(spark, d)), M.FRAME, GATE), 6, "distance")


def truth_frame_join(spark, d):
    t = A.truth(spark, d).withColumnRenamed("acquisition_time", "truth_time")
    return t.join(A.frames(spark, d), list(M.FRAME)).select(
        *M.FRAME, F.size("entities").cast("bigint").alias("targets"), F.size("tracks").cast("bigint").alias("tracks"),
        (F.col("truth_time") == F.col("acquisition_time")).alias("same_time"))


def position_errors(spark, d):
    matches = M.match_truth(_matched(spark, d))
    return rounded(matches.groupBy("run_id", "run_generation").agg(
        F.sqrt(F.avg(F.col("distance") * F.col("distance"))).alias("position_rmse"),
        F.avg("distance").alias("mean_position_error")), 6, "position_rmse", "mean_position_error")


def exclude_tentative(spark, d):
    return A.frames(spark, d).select(*M.FRAME, F.explode("tracks").alias("t")).filter(
        F.col("t.state") != "tentative").groupBy("run_id", "run_generation").agg(F.count(F.lit(1)).alias("samples"))


QUERIES = {f.__name__: f for f in (
    match_truth, missed_targets, false_tracks, unique_false_tracks, id_switches, tentative_samples, run_metrics,
    evaluation_guards, gated_join, truth_frame_join, position_errors, exclude_tentative)}

# The recursive step walks the ranked candidates of a frame and carries the used ids, so it
# decides exactly as a sequential greedy pass would.
FRAMED = """framed AS (SELECT event_id // 1024 + 1 AS run_id, event_id % 1024 // 512 AS run_generation,
    event_id % 1024 // 32 + 1 AS source_sequence, event_id % 32 + 10 AS target, event_id % 48 + 1 AS track_id, event_type,
    value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y FROM events),
entities AS (SELECT run_id, run_generation, source_sequence, CAST(target AS VARCHAR) AS truth_id, x, y FROM framed
  WHERE event_type IN ('purchase', 'signup')),
tracks AS (SELECT run_id, run_generation, source_sequence, track_id, x, y FROM framed WHERE event_type IN ('view', 'click')),
tentative AS (SELECT run_id, run_generation, source_sequence, track_id FROM framed WHERE event_type = 'error')"""
MATCHED = f"""WITH RECURSIVE {FRAMED},
candidates AS (SELECT run_id, run_generation, source_sequence, truth_id, track_id,
    sqrt((e.x - t.x) * (e.x - t.x) + (e.y - t.y) * (e.y - t.y)) AS distance
  FROM entities e JOIN tracks t USING (run_id, run_generation, source_sequence)
  WHERE sqrt((e.x - t.x) * (e.x - t.x) + (e.y - t.y) * (e.y - t.y)) <= 50),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id, run_generation, source_sequence
    ORDER BY distance, truth_id, track_id) AS r FROM candidates),
walk AS (SELECT run_id, run_generation, source_sequence, r, truth_id, track_id, distance, true AS taken,
    [truth_id] AS truths, [track_id] AS used FROM ranked WHERE r = 1
  UNION ALL SELECT n.run_id, n.run_generation, n.source_sequence, n.r, n.truth_id, n.track_id, n.distance,
    NOT (list_contains(w.truths, n.truth_id) OR list_contains(w.used, n.track_id)),
    CASE WHEN list_contains(w.truths, n.truth_id) OR list_contains(w.used, n.track_id) THEN w.truths
      ELSE list_append(w.truths, n.truth_id) END,
    CASE WHEN list_contains(w.truths, n.truth_id) OR list_contains(w.used, n.track_id) THEN w.used
      ELSE list_append(w.used, n.track_id) END
  FROM walk w JOIN ranked n ON n.run_id = w.run_id AND n.run_generation = w.run_generation
    AND n.source_sequence = w.source_sequence AND n.r = w.r + 1),
matches AS (SELECT run_id, run_generation, source_sequence, distance, truth_id, track_id FROM walk WHERE taken),
evaluated AS (SELECT DISTINCT run_id, run_generation, source_sequence FROM entities),
missed AS (SELECT e.run_id, e.run_generation, e.source_sequence, e.truth_id FROM entities e
  ANTI JOIN matches USING (run_id, run_generation, source_sequence, truth_id)),
spurious AS (SELECT t.run_id, t.run_generation, t.source_sequence, t.track_id FROM tracks t
  SEMI JOIN evaluated USING (run_id, run_generation, source_sequence)
  ANTI JOIN matches USING (run_id, run_generation, source_sequence, track_id)),
switches AS (SELECT * FROM (SELECT run_id, run_generation, source_sequence, truth_id, track_id,
    lag(track_id) OVER (PARTITION BY run_id, run_generation, truth_id ORDER BY source_sequence) AS previous_track_id
  FROM matches) WHERE previous_track_id <> track_id)"""
ORACLES = {
    "match_truth": f"""{MATCHED}
    SELECT run_id, run_generation, source_sequence, round(distance, 6) AS distance, truth_id, track_id FROM matches""",
    "missed_targets": f"{MATCHED} SELECT * FROM missed",
    "false_tracks": f"{MATCHED} SELECT * FROM spurious",
    "unique_false_tracks": f"""{MATCHED}
    SELECT run_id, count(DISTINCT track_id) AS unique_false_tracks FROM spurious GROUP BY run_id""",
    "id_switches": f"{MATCHED} SELECT * FROM switches",
    "tentative_samples": f"""WITH {FRAMED}
    SELECT run_id, CAST(sum(n) AS BIGINT) AS tentative_track_samples FROM (
      SELECT run_id, run_generation, source_sequence, count(track_id) AS n
      FROM (SELECT DISTINCT run_id, run_generation, source_sequence FROM entities)
        LEFT JOIN tentative USING (run_id, run_generation, source_sequence) GROUP BY ALL) GROUP BY run_id""",
    "run_metrics": f"""{MATCHED},
    e AS (SELECT run_id, count(*) AS target_samples, count(DISTINCT source_sequence) AS evaluated_frames FROM entities GROUP BY 1),
    m AS (SELECT run_id, count(*) AS matched_samples, round(sqrt(sum(distance * distance) / count(*)), 6) AS position_rmse,
      round(avg(distance), 6) AS mean_position_error FROM matches GROUP BY 1),
    f AS (SELECT run_id, count(*) AS false_track_samples, count(DISTINCT track_id) AS unique_false_tracks FROM spurious GROUP BY 1),
    s AS (SELECT run_id, count(*) AS id_switches FROM switches GROUP BY 1),
    t AS (SELECT run_id, count(*) AS tentative_track_samples FROM tentative
      SEMI JOIN evaluated USING (run_id, run_generation, source_sequence) GROUP BY 1)
    SELECT run_id, 'greedy-distance-v1' AS evaluator_version, evaluated_frames, target_samples,
      coalesce(matched_samples, 0) AS matched_samples, position_rmse, mean_position_error,
      target_samples - coalesce(matched_samples, 0) AS missed_target_samples,
      coalesce(false_track_samples, 0) AS false_track_samples, coalesce(unique_false_tracks, 0) AS unique_false_tracks,
      coalesce(id_switches, 0) AS id_switches, coalesce(tentative_track_samples, 0) AS tentative_track_samples,
      50.0::DOUBLE AS evaluation_gate
    FROM e LEFT JOIN m USING (run_id) LEFT JOIN f USING (run_id) LEFT JOIN s USING (run_id) LEFT JOIN t USING (run_id)""",
    "evaluation_guards": f"""WITH {FRAMED}, keys AS (SELECT DISTINCT run_id, run_generation, source_sequence FROM entities),
    copied AS (SELECT *, unnest(CASE WHEN source_sequence % 5 = 0 THEN [1, 2] ELSE [1] END) AS n FROM keys)
    SELECT 'duplicate_truth_frame' AS rule, count(*) AS violations FROM keys WHERE source_sequence % 5 = 0
    UNION ALL SELECT 'missing_frame', count(*) FROM copied WHERE source_sequence = 9
    UNION ALL SELECT 'truth_time_mismatch', count(*) FROM copied WHERE source_sequence % 7 = 0""",
    "gated_join": f"""WITH {FRAMED}
    SELECT run_id, run_generation, source_sequence, round(sqrt((e.x - t.x) ** 2 + (e.y - t.y) ** 2), 6) AS distance,
      truth_id, track_id
    FROM entities e JOIN (SELECT run_id, run_generation, source_sequence, track_id, x, y FROM framed
      WHERE event_type IN ('view', 'click', 'error')) t
    USING (run_id, run_generation, source_sequence) WHERE sqrt((e.x - t.x) ** 2 + (e.y - t.y) ** 2) <= 50""",
    "truth_frame_join": f"""WITH {FRAMED}, e AS (SELECT run_id, run_generation, source_sequence, count(*) AS targets
      FROM entities GROUP BY ALL), t AS (SELECT run_id, run_generation, source_sequence,
      count(*) FILTER (WHERE event_type IN ('view', 'click', 'error')) AS tracks FROM framed GROUP BY ALL)
    SELECT *, true AS same_time FROM e JOIN t USING (run_id, run_generation, source_sequence)""",
    "position_errors": f"""{MATCHED}
    SELECT run_id, run_generation, round(sqrt(avg(distance * distance)), 6) AS position_rmse,
      round(avg(distance), 6) AS mean_position_error FROM matches GROUP BY ALL""",
    "exclude_tentative": f"""WITH {FRAMED}
    SELECT run_id, run_generation, count(*) AS samples FROM tracks GROUP BY ALL""",
}
