"""Structured Streaming over live event streams.

Sources deliver lines or transport messages in any order; the stream sequence is the order.
Per-run state (lifecycle, live tracks, events waiting for a gap) lives in the state store, and
checkpoints replace replaying a prefix after a restart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StructType

from sonde import schemas
from sonde.functions import lifecycle, trackbook
from sonde.functions.trackbook import FusionSettings
from sonde.operators.decode import _typed, decode_messages
from sonde.session import SETTINGS
from sonde.streaming import policies

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
REACH = 10_000       # events of a run that wait for a gap at most
EVENT_DDL = (
    "event_type string, run_id decimal(20,0), run_generation long, stream_sequence long, event_time_seconds double,"
    "sensor_id int, sensor_generation long, scan_sequence long, measurement_count long, seed long,"
    "measurements array<struct<detection_id:int,x:double,y:double,confidence:double,uncertainty_radius:double>>")
FRAME_BODY = StructType([f for f in schemas.FRAMES.fields if f.name in (
    "run_generation", "acquisition_time", "source_type", "tracks", "associations", "retired")])
# Stateful processors are also loaded by a Python runner beside the driver, which has no shipped package.
for module in (policies, lifecycle, trackbook):
    cloudpickle.register_pickle_by_value(module)


# ---- sources ---------------------------------------------------------------------------------------

def stream_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None,
                 pattern: str = "*.events") -> DataFrame:
    """Lines of recordings as files arrive, with `arrival`, their place in the source; `files_per_trigger` bounds a micro-batch.

    A place is the file's time and name, the start of the split, and the line's number in its task, which reads a
    split from front to back.
    """
    reader = spark.readStream.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            yield batch.append_column("n", pa.array(range(at, at + batch.num_rows), pa.int64()))
            at += batch.num_rows

    lines = reader.text(path).select(
        F.col("_metadata.file_path").alias("source"), F.unix_micros("_metadata.file_modification_time").alias("t"),
        F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    lines = lines.mapInArrow(numbered, "source string, t long, block long, line string, n long")
    return lines.select("source", "line", F.format_string("%018d %s %015d %012d", "t", "source", "block", "n").alias("arrival"))


def kafka_event_source(spark: SparkSession, servers: str, topic: str, max_events: int | None = None,
                       starting: str = "earliest") -> DataFrame:
    """Decoded events of a Kafka topic; `max_events` per trigger bounds a replay.

    The connector is not part of the PySpark distribution; add its package to the session.
    """
    reader = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
              .option("startingOffsets", starting).option("failOnDataLoss", "true"))
    if max_events:
        reader = reader.option("maxOffsetsPerTrigger", max_events)
    return stream_messages(reader.load().withColumn("arrival", F.col("offset")))    # a run's key has one partition


def stream_messages(messages: DataFrame) -> DataFrame:
    """Decoded events of (key, value) messages from any streaming source; `arrival` is kept."""
    return decode_messages(messages.select("key", "value", *(c for c in ("arrival",) if c in messages.columns)))


def stream_decode(lines: DataFrame) -> DataFrame:
    """Typed events, each with `error`; header lines of the text format are skipped."""
    return _typed(lines.filter(F.regexp_replace("line", "[\r\n]+$", "") != schemas.RECORDING_HEADER))


# ---- per-run state ------------------------------------------------------------------------------------

def _encoded(events: DataFrame, arrival: str | None) -> DataFrame:
    """(run_id, stream_sequence, event_type, arrival, body): the event as JSON with float32 values widened exactly."""
    wide = F.transform("measurements", lambda m: F.struct(
        m["detection_id"].alias("detection_id"),
        *(m[c].cast("double").alias(c) for c in ("x", "y", "confidence", "uncertainty_radius"))))
    plain = [c for c in schemas.EVENTS.fieldNames() if c != "event_time_seconds"]
    body = F.to_json(F.struct(
        *plain, F.col("event_time_seconds").cast("double").alias("event_time_seconds"), wide.alias("measurements")))
    return events.select("run_id", "stream_sequence", "event_type", F.col(arrival or "stream_sequence").alias("arrival"), body.alias("body"))


def _stateful(keyed: DataFrame, processor: StatefulProcessor, schema: str, timeout: int | None = None) -> DataFrame:
    # The operator needs this state store; a session may have been built elsewhere.
    keyed.sparkSession.conf.set(STATE_STORE, SETTINGS[STATE_STORE])
    return keyed.groupBy("run_id").transformWithStateInPandas(processor, schema, "Append", "ProcessingTime" if timeout else "None")


def _per_run(events: DataFrame, policy: str, settings: FusionSettings | None, arrival: str | None, reach: int,
             timeout_seconds: float | None) -> DataFrame:
    if policy not in ("strict", "reorder"):
        raise ValueError("policy must be strict or reorder")
    if policy == "strict" and arrival is None:
        raise ValueError("strict judges events in source order: name the column of their position")
    timeout = int(timeout_seconds * 1000) if timeout_seconds else None
    return _stateful(_encoded(events, arrival).drop("event_type"), policies.RunProcessor(policy, settings, reach, timeout, arrival is not None),
                     "run_id decimal(20,0), stream_sequence long, rule string, missing long, body string", timeout)


def _events_of(checked: DataFrame, *more: str) -> DataFrame:
    """Event columns and `rule` of encoded rows; a row without an event keeps its identity."""
    parsed = checked.withColumn("e", F.from_json("body", EVENT_DDL))
    names = schemas.EVENTS.fieldNames()
    return parsed.select(*(F.col(c) if c in ("run_id", "stream_sequence") else F.col(f"e.{c}").alias(c) for c in names), "rule", *more)


def stream_validate(events: DataFrame, policy: str = "reorder", arrival: str | None = None, reach: int = REACH,
                    timeout_seconds: float | None = None) -> DataFrame:
    """Events with `rule`: null for accepted ones, else the rule that refused them; `missing` counts the events of a gap.

    `arrival` names the column of an event's position in its source: line position, offset.  Without it, events of a
    micro-batch are taken in the order of their sequence, and the finish of a run does not close a gap before it.
    """
    return _events_of(_per_run(events, policy, None, arrival, reach, timeout_seconds), "missing")


def stream_fuse(events: DataFrame, settings: FusionSettings | None = None, policy: str = "reorder", arrival: str | None = None,
                reach: int = REACH, timeout_seconds: float | None = None) -> DataFrame:
    """Track frames of the accepted events, equal to the batch frames of the same run."""
    checked = _per_run(events, policy, settings or FusionSettings(), arrival, reach, timeout_seconds).filter(F.col("rule").isNull())
    return checked.select(
        F.lit(1).alias("schema_version"), F.lit("GLOBAL_TRACKS").alias("event_type"), "run_id",
        F.col("stream_sequence").alias("source_sequence"), F.from_json("body", FRAME_BODY).alias("f")).select(
        "schema_version", "event_type", "run_id", "source_sequence", "f.*")


def stream_dedup(events: DataFrame, arrival: str | None = None) -> DataFrame:
    """Events with `rule`: null for the first of each identity, else why the row is a repeat.  A run's identities are kept until it is complete."""
    encoded = _encoded(events, arrival).withColumn("digest", F.xxhash64("body"))
    return _events_of(_stateful(encoded, policies.IdentityProcessor(), "run_id decimal(20,0), stream_sequence long, rule string, body string"))


def stream_detections_over_time(events: DataFrame, arrival: str | None = None, delay: float | None = None) -> DataFrame:
    """One-second counts per sensor of each run, empty scans included, appended when a bucket closes; late scans with rule `late`.

    Buckets close on the run's own finish, and with `delay` once the run's clock is so many seconds past them.
    """
    narrow = events.select("run_id", "stream_sequence", F.col(arrival or "stream_sequence").alias("arrival"), "event_type", "run_generation",
                           F.col("event_time_seconds").cast("double").alias("event_time_seconds"), "sensor_id", "measurement_count")
    return _stateful(narrow, policies.BucketProcessor(delay), "run_id decimal(20,0), run_generation long, sensor_id int, second long,"
                                                              "scans long, detections long, empty_scans long, rule string")


# ---- built-in stateful operators ---------------------------------------------------------------------------

def stream_sensor_state(events: DataFrame) -> DataFrame:
    """Running counters and latest scan per sensor generation (update or complete mode).

    Rows of an older run generation or sensor generation are superseded, not removed; readers
    take the highest generation, as `tracking.sensor_state` does for stored events.
    """
    scan = F.col("event_type") == "MEASUREMENTS"
    return events.filter(F.col("sensor_id").isNotNull()).groupBy(
        "run_id", "run_generation", "sensor_id", "sensor_generation").agg(
        F.count_if(scan).alias("scans"),
        F.coalesce(F.sum(F.when(scan, F.col("measurement_count"))), F.lit(0)).alias("measurements"),
        F.max_by(F.when(scan, F.col("measurements")), F.when(scan, F.col("stream_sequence"))).alias("latest"))


# ---- sinks ---------------------------------------------------------------------------------------------

def start_table(df: DataFrame, path: str, checkpoint: str, partition_by: tuple[str, ...] = (),
                available_now: bool = True) -> StreamingQuery:
    """Append to Parquet.  Every consumer has its own query and checkpoint, hence a full copy."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def start_batches(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update",
                  available_now: bool = True) -> StreamingQuery:
    """Hand each micro-batch to `sink(batch, id)`, which may write to several places."""
    writer = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_record(events: DataFrame, path: str, checkpoint: str, policy: str = "reorder", arrival: str | None = None) -> StreamingQuery:
    """Record accepted live events; refused ones are not recorded.

    A task writes one file for each micro-batch, in which its runs stand one after the other: row group statistics lead to
    a run.  A folder for each run would be a file for each run and micro-batch, and most of the work.
    """
    accepted = stream_validate(events, policy, arrival).filter(F.col("rule").isNull()).drop("rule", "missing")
    return start_table(accepted, path, checkpoint)


def run_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What a checkpoint of `stream_validate` or `stream_fuse` holds of each run."""
    spark.conf.set(STATE_STORE, SETTINGS[STATE_STORE])
    state = spark.read.format("statestore").option("stateVarName", "run").load(checkpoint)
    return state.select(F.col("key.run_id").alias("run_id"), "value.*")


def recorded_runs(recorded: DataFrame) -> DataFrame:
    """(run_id, events, complete): a recording is complete once its finish event is there."""
    return recorded.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("events"), (F.count_if(F.col("event_type") == "RUN_FINISHED") > 0).alias("complete"))
