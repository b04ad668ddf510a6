"""Registered streaming queries: the event table read as a stream, results in the scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonde.operators import decode, tracking
from sonde.queries.common import integers
from sonde.queries.sources import RECORDED
from sonde.session import scratch_dir
from sonde.sources import adapters as A
from sonde.sources import sinks
from sonde.streaming import live


def _events(spark, d):
    """The driver's event table as a file stream of recording events."""
    schema = A.table(spark, d, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return A.recording_events(raw)


def _appended(spark, df, label):
    out, checkpoint = scratch_dir(spark, label), scratch_dir(spark, f"{label}-checkpoint")
    live.start_table(df, out, checkpoint).awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def _complete(spark, df, label):
    """Result table of a complete-mode aggregation: each micro-batch replaces it."""
    root, checkpoint = scratch_dir(spark, label), scratch_dir(spark, f"{label}-checkpoint")
    last = {}

    def store(batch, n):
        batch.write.mode("overwrite").parquet(f"{root}/{n}")
        last["path"] = f"{root}/{n}"

    live.start_batches(df, store, checkpoint, "complete").awaitTermination()
    return spark.read.schema(df.schema).parquet(last["path"])


def stream_decode(spark, d):
    messages = sinks.transport_messages(decode.recording_lines(_events(spark, d)))
    out = _appended(spark, live.stream_messages(messages).select("run_id", "event_type", "measurement_count", "error"), "decode")
    return out.groupBy(F.col("run_id").cast("bigint"), "event_type").agg(
        F.count(F.lit(1)).alias("events"), F.sum("measurement_count").alias("measurements"), F.count("error").alias("errors"))


STEPS, FILES = 3, 4


def _arriving(spark, d, arrival=None, keep=None, more=None, steps=range(STEPS), path=None):
    """The event table's recordings as files in the order of `arrival`, a third of every run in each step: several micro-batches."""
    events = A.recording_events(A.table(spark, d, "events")).withColumn("run_id", F.col("run_id").cast("decimal(20,0)"))
    events = events.withColumn("arrival", F.col("stream_sequence") if arrival is None else arrival)
    events = (events if keep is None else events.filter(keep)).drop("ts")
    events = events if more is None else events.unionByName(more(events))
    path = path or scratch_dir(spark, "arriving")
    for step in steps:
        part = events.filter(F.least(F.expr(f"arrival * {STEPS} div 207"), F.lit(STEPS - 1)) == step)
        part.repartition(FILES, "run_id").write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", FILES).parquet(path), events, path


def _rules(out):
    return out.groupBy(F.col("run_id").cast("bigint"), F.coalesce("rule", F.lit("")).alias("rule")).agg(
        F.count(F.lit(1)).alias("events"), F.min("stream_sequence").alias("first_sequence"))


def stream_validate(spark, d):
    """Source order, strictly: odd runs have events 40 and 41 swapped, even runs lose event 169."""
    odd, n = F.col("run_id") % 2 == 1, F.col("stream_sequence")
    swapped = F.when(odd & n.isin(40, 41), 81 - n).otherwise(n)
    arriving, _, _ = _arriving(spark, d, swapped, odd | (n != 169))
    out = _appended(spark, live.stream_validate(arriving, "strict", "arrival").select("run_id", "stream_sequence", "rule"), "validate")
    return _rules(out)


def stream_reorder(spark, d):
    """Events come in tens from back to front; every third run has lost event 100, which its finish brings to light."""
    n = F.col("stream_sequence")
    backwards = F.when(F.col("event_type") == "RUN_FINISHED", F.lit(1000)).otherwise(F.expr("(stream_sequence - 1) div 10 * 10 + 10 - (stream_sequence - 1) % 10"))
    arriving, _, _ = _arriving(spark, d, backwards, (F.col("run_id") % 3 != 0) | (n != 100))
    return _rules(_appended(spark, live.stream_validate(arriving, "reorder", "arrival").select("run_id", "stream_sequence", "rule"), "reorder"))


def stream_fuse(spark, d):
    out = _appended(spark, live.stream_fuse(_arriving(spark, d)[0], arrival="arrival"), "fuse")
    return out.select(
        F.col("run_id").cast("bigint"), "source_sequence", F.size("associations").cast("bigint").alias("associations"))


def stream_restart(spark, d):
    """Fusion stopped after the first third, its state read back, and started again: frames that differ from the batch ones."""
    arriving, events, path = _arriving(spark, d, steps=(0,))
    out, checkpoint = scratch_dir(spark, "restart"), scratch_dir(spark, "restart-checkpoint")
    fused = live.stream_fuse(arriving, arrival="arrival")
    live.start_table(fused, out, checkpoint).awaitTermination()
    halfway = scratch_dir(spark, "restart-state")
    live.run_state(spark, checkpoint).select("run_id", F.col("position").alias("stopped_at")).write.parquet(halfway)
    _arriving(spark, d, steps=range(1, STEPS), path=path)
    live.start_table(live.stream_fuse(spark.readStream.schema(arriving.schema).option("maxFilesPerTrigger", FILES).parquet(path), arrival="arrival"),
                     out, checkpoint).awaitTermination()
    names = ["run_generation", "acquisition_time", "source_type", "tracks", "associations", "retired"]
    frame = F.to_json(F.struct(*names)).alias("frame")
    live_frames = spark.read.schema(fused.schema).parquet(out).select("run_id", "source_sequence", frame)
    batch = tracking.fuse_tracks(events.drop("arrival")).select("run_id", "source_sequence", frame.alias("expected"))
    both = live_frames.join(batch, ["run_id", "source_sequence"], "full")
    return both.groupBy("run_id").agg(F.count("frame").alias("frames"), F.count_if(~F.col("frame").eqNullSafe(F.col("expected"))).alias("differing")).join(
        spark.read.parquet(halfway), "run_id").withColumn("run_id", F.col("run_id").cast("bigint"))


def stream_dedup(spark, d):
    """Events of sensor 2 come again 20 places later, those of sensor 3 with another time: repeats, conflicts, and late ones after the finish."""
    def again(events):
        other = F.col("sensor_id") == 3
        return events.filter(F.col("sensor_id").isin(2, 3)).withColumns({
            "arrival": F.col("arrival") + 20, "event_time_seconds": F.when(other, F.col("event_time_seconds") + 1).otherwise(F.col("event_time_seconds"))})

    arriving, _, _ = _arriving(spark, d, more=again)
    return _rules(_appended(spark, live.stream_dedup(arriving, "arrival").select("run_id", "stream_sequence", "rule"), "dedup"))


def stream_detections_over_time(spark, d):
    """Every 25th scan comes after its run's finish and is late there; other runs' clocks do not matter."""
    late = F.when((F.col("stream_sequence") % 25 == 13) & (F.col("event_type") == "MEASUREMENTS"), F.lit(500)).otherwise(F.col("stream_sequence"))
    arriving, _, _ = _arriving(spark, d, late)
    out = _appended(spark, live.stream_detections_over_time(arriving, "arrival"), "buckets")
    counted = out.groupBy("run_id", "run_generation", "sensor_id", "second", F.coalesce("rule", F.lit("")).alias("rule")).agg(
        *(F.sum(c).alias(c) for c in ("scans", "detections", "empty_scans")))
    return integers(counted, "run_id", "sensor_id")


def stream_record(spark, d):
    out, checkpoint = scratch_dir(spark, "record"), scratch_dir(spark, "record-checkpoint")
    live.stream_record(_arriving(spark, d)[0], out, checkpoint, arrival="arrival").awaitTermination()
    recorded = live.recorded_runs(spark.read.parquet(out))
    return recorded.select(F.col("run_id").cast("bigint"), "events", "complete")


def stream_sensor_state(spark, d):
    out = _complete(spark, live.stream_sensor_state(_events(spark, d)).drop("latest"), "sensor-state")
    return integers(out, "sensor_id")


QUERIES = {f.__name__: f for f in (
    stream_decode, stream_validate, stream_reorder, stream_fuse, stream_restart, stream_dedup, stream_detections_over_time, stream_record,
    stream_sensor_state)}

ORACLES = {
    "stream_decode": f"""WITH {RECORDED}
    SELECT run_id, event_type, count(*) AS events, CAST(sum(n) AS BIGINT) AS measurements, CAST(0 AS BIGINT) AS errors
    FROM recorded GROUP BY ALL""",
    "stream_validate": f"""WITH {RECORDED}, judged AS (SELECT run_id, stream_sequence,
      CASE WHEN stream_sequence <= CASE WHEN run_id % 2 = 1 THEN 40 ELSE 168 END THEN '' ELSE 'sequence_contiguous' END AS rule
      FROM recorded WHERE run_id % 2 = 1 OR stream_sequence <> 169)
    SELECT run_id, rule, count(*) AS events, min(stream_sequence) AS first_sequence FROM judged GROUP BY ALL""",
    "stream_reorder": f"""WITH {RECORDED}, ended AS (SELECT run_id FROM recorded WHERE event_type = 'RUN_FINISHED'),
    judged AS (SELECT run_id, stream_sequence, CASE WHEN run_id % 3 <> 0 OR stream_sequence < 100 THEN ''
        WHEN stream_sequence = 100 THEN 'gap' ELSE 'sequence_contiguous' END AS rule FROM recorded)
    SELECT run_id, rule, count(*) AS events, min(stream_sequence) AS first_sequence FROM judged
    WHERE rule = '' OR run_id IN (SELECT run_id FROM ended) GROUP BY ALL""",
    "stream_restart": f"""WITH {RECORDED}
    SELECT run_id, count(*) AS frames, CAST(0 AS BIGINT) AS differing, max(stream_sequence) FILTER (WHERE stream_sequence < 69) AS stopped_at
    FROM recorded GROUP BY run_id""",
    "stream_fuse": f"""WITH {RECORDED}
    SELECT run_id, stream_sequence AS source_sequence, coalesce(CAST(n AS BIGINT), 0) AS associations FROM recorded""",
    "stream_dedup": f"""WITH {RECORDED}, ended AS (SELECT run_id FROM recorded WHERE event_type = 'RUN_FINISHED'),
    judged AS (SELECT run_id, stream_sequence, '' AS rule FROM recorded
      UNION ALL SELECT run_id, stream_sequence, CASE
        WHEN run_id IN (SELECT run_id FROM ended) AND (stream_sequence + 20 > 206) THEN 'late'
        WHEN sensor_id = 2 THEN 'duplicate_event' ELSE 'conflicting_duplicate' END FROM recorded WHERE sensor_id IN (2, 3))
    SELECT run_id, rule, count(*) AS events, min(stream_sequence) AS first_sequence FROM judged GROUP BY ALL""",
    "stream_detections_over_time": f"""WITH {RECORDED}
    SELECT run_id, CAST(0 AS BIGINT) AS run_generation, sensor_id, CAST(floor(t) AS BIGINT) AS second,
      CASE WHEN stream_sequence % 25 = 13 THEN 'late' ELSE '' END AS rule,
      count(*) AS scans, CAST(sum(n) AS BIGINT) AS detections, count(*) FILTER (WHERE n = 0) AS empty_scans
    FROM recorded WHERE event_type = 'MEASUREMENTS' AND run_id IN (SELECT run_id FROM recorded WHERE event_type = 'RUN_FINISHED') GROUP BY ALL""",
    "stream_record": f"""WITH {RECORDED}
    SELECT run_id, count(*) AS events, count(*) FILTER (WHERE event_type = 'RUN_FINISHED') > 0 AS complete
    FROM recorded GROUP BY run_id""",
    "stream_sensor_state": f"""WITH {RECORDED}
    SELECT run_id, CAST(0 AS BIGINT) AS run_generation, sensor_id, CAST(0 AS BIGINT) AS sensor_generation,
      count(*) FILTER (WHERE event_type = 'MEASUREMENTS') AS scans, CAST(coalesce(sum(n), 0) AS BIGINT) AS measurements
    FROM recorded WHERE sensor_id IS NOT NULL GROUP BY ALL""",
}
