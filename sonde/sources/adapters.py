"""Domain tables derived from the driver's star schema and event table.

Runs are made of a fixed number of customers (or consecutive events), so a run keeps its size
and the number of runs grows with the data.  All mappings are row-local except the two joins
that give a scan its measurement count and a measurement its scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GENERATIONS = 7          # order years 1995..2001
SENSORS_PER_RUN = 100
RUN_EVENTS = 1024        # consecutive event ids per run of the event-based tables
FRAME_EVENTS = 32        # consecutive event ids per track frame
SEQUENCE_STEP = 10_000_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _run_of(custkey: str):
    return F.expr(f"{custkey} div {SENSORS_PER_RUN} + 1")


def _sensor_of(custkey: str):
    return (F.col(custkey) % SENSORS_PER_RUN + 1).cast("int")


def _scan_columns():
    day = F.dayofyear("o_orderdate") - 1
    return [
        _run_of("o_custkey").alias("run_id"),
        (F.year("o_orderdate") - 1995).cast("bigint").alias("run_generation"),
        F.col("o_orderkey").alias("stream_sequence"),
        day.cast("float").alias("acquisition_time_seconds"),
        _sensor_of("o_custkey").alias("sensor_id"),
        F.expr("cast((month(o_orderdate) - 1) div 6 as bigint)").alias("sensor_generation"),
        (day.cast("bigint") * SEQUENCE_STEP + F.col("o_orderkey")).alias("scan_sequence"),
    ]


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan per order; its measurement count is the number of order lines, or 0."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"))
    orders = table(spark, sf_dir, "orders")
    return orders.join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        *_scan_columns(), F.coalesce("n", F.lit(0)).alias("measurement_count"))


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One measurement per order line that belongs to an order."""
    orders = table(spark, sf_dir, "orders").select(*_scan_columns())
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("stream_sequence"), *_measured())
    return orders.join(lines, "stream_sequence")


def _measured():
    return [
        F.col("l_linenumber").alias("detection_id"),
        F.col("l_extendedprice").cast("float").alias("x"),
        F.col("l_quantity").cast("float").alias("y"),
        (1 - F.col("l_discount")).cast("float").alias("confidence"),
        F.col("l_tax").cast("float").alias("uncertainty_radius"),
    ]


def started(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer is a sensor started in every generation.

    Customers are spread over a fixed number of tasks first: their file is small, and what is made of it in one task is not.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    customers = table(spark, sf_dir, "customer").select("c_custkey").repartition(tasks, "c_custkey")
    return customers.select(
        _run_of("c_custkey").alias("run_id"),
        F.explode(F.sequence(F.lit(0), F.lit(GENERATIONS - 1)).cast("array<bigint>")).alias("run_generation"),
        _sensor_of("c_custkey").alias("sensor_id"),
        F.col("c_custkey").alias("seed"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycle, sensor-start and scan events as one table.

    Sequences are unique per run but not dense: -1 - generation for lifecycle events, below
    that for sensor starts, the order key for scans.
    """
    customers = table(spark, sf_dir, "customer")
    lifecycle = customers.select(_run_of("c_custkey").alias("run_id")).distinct().select(
        "run_id",
        F.explode(F.sequence(F.lit(0), F.lit(GENERATIONS - 1)).cast("array<bigint>")).alias("run_generation"),
    ).select(
        "run_id", "run_generation",
        (-1 - F.col("run_generation")).alias("stream_sequence"),
        F.lit(0.0).cast("float").alias("event_time_seconds"),
        F.when(F.col("run_generation") == 0, "RUN_STARTED").otherwise("RUN_RESET").alias("event_type"),
    )
    starts = started(spark, sf_dir).select(
        "run_id", "run_generation",
        (-100 - F.col("run_generation") * SENSORS_PER_RUN - F.col("sensor_id")).alias("stream_sequence"),
        F.lit(0.0).cast("float").alias("event_time_seconds"), F.lit("SENSOR_STARTED").alias("event_type"),
        "sensor_id", F.lit(0).cast("bigint").alias("sensor_generation"), "seed")
    scan_events = scans(spark, sf_dir).select(
        "run_id", "run_generation", "stream_sequence",
        F.col("acquisition_time_seconds").alias("event_time_seconds"), F.lit("MEASUREMENTS").alias("event_type"),
        "sensor_id", "sensor_generation", "scan_sequence", "measurement_count")
    return scan_events.unionByName(starts, allowMissingColumns=True).unionByName(
        lifecycle, allowMissingColumns=True)


def ragged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as a damaged event stream, so that every lifecycle rule has work.

    The order key is the line number.  Kinds, generations and times come from unrelated
    columns, so gaps, late times, unknown sensors and stale generations all occur.
    """
    kind = (F.when(F.col("o_orderkey") % 50 == 7, "RUN_RESET")
            .when((F.col("o_orderkey") % 211 == 5) & (F.col("o_custkey") % 3 == 0), "RUN_FINISHED")
            .when(F.col("o_orderpriority") == "1-URGENT", "SENSOR_STARTED")
            .when(F.col("o_orderpriority") == "5-LOW", "SENSOR_RESET")
            .otherwise("MEASUREMENTS"))
    lines = table(spark, sf_dir, "orders").select(
        _run_of("o_custkey").cast("string").alias("source"),
        F.col("o_orderkey").alias("line_no"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_custkey") % 7 + 1).otherwise(
            _run_of("o_custkey")).alias("run_id"),
        F.expr("o_orderkey div 500").alias("run_generation"),
        F.expr("o_orderkey div 3 + 1").alias("stream_sequence"),
        (F.dayofyear("o_orderdate") - F.lit(3)).cast("float").alias("event_time_seconds"),
        kind.alias("event_type"),
        (F.col("o_custkey") % 10 + 1).cast("int").alias("raw_sensor"),
        F.expr("cast(month(o_orderdate) div 5 as bigint)").alias("raw_generation"),
        F.expr("o_orderkey div 40 % 9").alias("raw_scan"),
        (F.col("o_totalprice").cast("bigint") % 4).alias("raw_count"),
        (F.col("o_totalprice") / 1000 - 5).cast("float").alias("raw_value"),
    )
    on_sensor = ~F.col("event_type").isin("RUN_RESET", "RUN_FINISHED")
    on_scan = F.col("event_type") == "MEASUREMENTS"
    detection = F.struct(
        F.col("raw_count").cast("int").alias("detection_id"),
        F.col("raw_value").alias("x"), F.col("raw_value").alias("y"),
        (F.col("raw_value") / 400).cast("float").alias("confidence"),
        F.col("raw_value").alias("uncertainty_radius"))
    return lines.select(
        "source", "line_no", "run_id", "run_generation", "stream_sequence", "event_time_seconds", "event_type",
        F.when(on_sensor, F.col("raw_sensor")).alias("sensor_id"),
        F.when(on_sensor, F.col("raw_generation")).alias("sensor_generation"),
        F.when(on_scan, F.col("raw_scan")).alias("scan_sequence"),
        F.when(on_scan, F.col("raw_count")).alias("measurement_count"),
        F.when(F.col("event_type") == "SENSOR_STARTED", F.col("raw_scan")).alias("seed"),
        F.when(on_scan, F.array_repeat(detection, F.col("raw_count").cast("int"))).alias("measurements"),
    )


# ---- event-table based ---------------------------------------------------------------------

def _event_run():
    return F.expr(f"event_id div {RUN_EVENTS} + 1")


def _epoch_micros():
    """Microseconds since 1970 of the zone-less event timestamp."""
    return F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")


def _k():
    return F.get_json_object("props", "$.k").cast("double")


def traces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(produced, consumed) marks per experiment, with repeated, lost and early marks.

    An experiment is a group of 16 users; `arrival` is the row's position in its trace file.
    """
    raw = table(spark, sf_dir, "events").select(
        F.expr("user_id div 16 + 1").alias("experiment_id"), (F.col("event_id") + 1).alias("sequence"),
        (_epoch_micros() * 1000).alias("ns"), "event_type",
        (F.col("value") * 100).cast("bigint").alias("cents"))
    mark = ["experiment_id", "arrival", "phase", "sequence", "wall_ns"]
    repeat = F.when(F.col("event_type") == "error", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    copies = raw.withColumn("copy", F.explode(repeat))
    produced = copies.select(
        "experiment_id", (F.col("sequence") * 2 + F.col("copy")).alias("arrival"),
        F.lit("produced").alias("phase"), "sequence",
        (F.col("ns") + F.col("copy") * 1000000).alias("wall_ns")).select(*mark)
    # Arrivals run in reverse within groups of eight sequences; each tenth-cent lag is one ms,
    # and lags below 1 cent-dozen arrive before they were produced.
    consumed = copies.filter(F.col("event_type") != "signup").select(
        "experiment_id",
        (F.expr("sequence div 8 * 8 + 7 - sequence % 8") * 2 + F.col("copy")).alias("arrival"),
        F.when((F.col("event_type") == "click") & (F.col("cents") % 25 == 0), "resume").otherwise(
            "consumed").alias("phase"),
        "sequence", (F.col("ns") + (F.col("cents") - 120) * 1000000).alias("wall_ns")).select(*mark)
    return produced, consumed


def delivered_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(expected, actual) event payloads per experiment, with arrival positions."""
    raw = table(spark, sf_dir, "events").select(
        F.expr("user_id div 16 + 1").alias("run_id"), (F.col("event_id") + 1).alias("stream_sequence"),
        "event_type", "value")
    expected = raw.filter(F.col("event_type") != "click").select(
        "run_id", "stream_sequence", F.col("value").cast("string").alias("payload"))
    repeat = (F.when(F.col("event_type") == "error", F.array(F.lit(0), F.lit(1), F.lit(2)))
              .when(F.col("event_type") == "signup", F.array().cast("array<int>"))
              .otherwise(F.array(F.lit(0))))
    shift = F.when(F.col("copy") == 2, 1).when(
        (F.col("event_type") == "view") & (F.col("stream_sequence") % 11 == 0), 2).otherwise(0)
    actual = raw.withColumn("copy", F.explode(repeat)).select(
        "run_id", "stream_sequence",
        (F.expr("stream_sequence div 8 * 8 + 7 - stream_sequence % 8") * 3 + F.col("copy")).alias("arrival"),
        (F.col("value") + shift).cast("string").alias("payload"))
    return expected, actual


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track frames: views and clicks (and, tentative, errors) of 32 consecutive events."""
    state = (F.when(F.col("event_type") == "view", "confirmed")
             .when(F.col("event_type") == "click", "coasting").otherwise("tentative"))
    track = F.struct(
        (F.col("event_id") % 48 + 1).alias("track_id"), state.alias("state"),
        F.col("value").alias("x"), _k().alias("y"), F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"),
        F.col("acquisition_time").alias("last_seen"), F.lit(1).cast("bigint").alias("observations"),
        F.lit(1).cast("bigint").alias("distinct_times"), F.array(F.lit(1)).alias("sensors"))
    association = F.struct(
        F.lit(1).alias("sensor_id"), F.lit(0).cast("bigint").alias("sensor_generation"),
        F.col("source_sequence").alias("scan_sequence"), (F.col("event_id") % 32).cast("int").alias("detection_id"),
        (F.col("event_id") % 48 + 1).alias("track_id"))
    retired = F.struct((F.col("event_id") % 48 + 1).alias("track_id"), F.lit("timeout").alias("reason"))
    kind = F.col("event_type")
    gather = lambda cond, value: F.array_sort(F.collect_list(F.when(cond, value)))
    return _framed(spark, sf_dir).groupBy(*_FRAME_KEY, "acquisition_time").agg(
        gather(kind.isin("view", "click", "error"), track).alias("tracks"),
        gather(kind == "view", association).alias("associations"), gather(kind == "purchase", retired).alias("retired"),
    ).withColumn("source_type", F.lit("MEASUREMENTS")).withColumn("schema_version", F.lit(1)).withColumn(
        "event_type", F.lit("GLOBAL_TRACKS"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth frames: purchases and sign-ups of the same 32 events."""
    entity = F.struct(
        F.col("target").cast("string").alias("truth_id"), F.col("value").alias("x"), _k().alias("y"))
    return _framed(spark, sf_dir).filter(F.col("event_type").isin("purchase", "signup")).groupBy(
        *_FRAME_KEY, "acquisition_time").agg(F.array_sort(F.collect_list(entity)).alias("entities"))


_FRAME_KEY = ("run_id", "run_generation", "source_sequence")


def _framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = F.col("event_id") % RUN_EVENTS
    frame = F.expr(f"event_id % {RUN_EVENTS} div {FRAME_EVENTS}")
    return table(spark, sf_dir, "events").select(
        _event_run().alias("run_id"), F.expr(f"event_id % {RUN_EVENTS} div {RUN_EVENTS // 2}").alias("run_generation"),
        (frame + 1).alias("source_sequence"), (frame.cast("double") / 4).alias("acquisition_time"),
        (F.lit(10) + inside % FRAME_EVENTS).alias("target"), "event_id", "event_type", "value", "props")


RECORDING_EVENTS = 200   # consecutive event ids per recording


def recording_events(raw: DataFrame) -> DataFrame:
    """Valid recordings from the (batch or streaming) event table, row-locally.

    200 consecutive event ids make one recording with dense sequences: sequence 1 starts the
    run, 2 to 5 start four sensors, every source event is one scan, and one event ends the run.
    Sensors 1 to 3 see two targets per scan, sensor 4 none.  Every 50 scans the time jumps by
    3 seconds.
    """
    i = F.col("i")
    base = raw.select(
        F.expr(f"event_id div {RECORDING_EVENTS} + 1").alias("run_id"), (F.col("event_id") % RECORDING_EVENTS).alias("i"),
        "value", _k().alias("k"), F.col("ts").alias("ts"))
    sensor = (i % 4 + 1).cast("int")
    scan = F.expr("i div 4")
    time = (i / 8 + F.expr("i div 50") * 3).cast("float")
    empty = F.from_json(F.lit("[]"), _DETECTIONS)

    def event(kind, sequence, at, sensor_id=None, seed=None, scan_sequence=None, count=None, measurements=None):
        none = F.lit(None)
        return F.struct(
            F.lit(kind).alias("event_type"), sequence.cast("bigint").alias("stream_sequence"),
            at.cast("float").alias("event_time_seconds"),
            (none if sensor_id is None else sensor_id).cast("int").alias("sensor_id"),
            (none if sensor_id is None else F.lit(0)).cast("bigint").alias("sensor_generation"),
            (none if scan_sequence is None else scan_sequence).cast("bigint").alias("scan_sequence"),
            (none if count is None else count).cast("bigint").alias("measurement_count"),
            (none if seed is None else seed).cast("bigint").alias("seed"),
            (none if measurements is None else measurements).cast(_DETECTIONS).alias("measurements"))

    def detection(offset, shift):
        return F.struct(
            (scan * 2 + offset).cast("int").alias("detection_id"), (F.col("value") + shift).cast("float").alias("x"),
            (F.col("k") + shift).cast("float").alias("y"), F.lit(0.8).cast("float").alias("confidence"),
            F.lit(2.0).cast("float").alias("uncertainty_radius"))

    sees = sensor != 4
    scanned = event("MEASUREMENTS", i + 6, time, sensor, None, scan + 1, F.when(sees, 2).otherwise(0),
                    F.when(sees, F.array(detection(1, 0.0), detection(2, 120.0))).otherwise(empty))
    opening = F.array(event("RUN_STARTED", F.lit(1), F.lit(0)), *(
        event("SENSOR_STARTED", F.lit(n + 1), F.lit(0), F.lit(n), F.lit(7 * n)) for n in range(1, 5)), scanned)
    closing = F.array(scanned, event("RUN_FINISHED", i + 7, time))
    rows = F.when(i == 0, opening).when(i == RECORDING_EVENTS - 1, closing).otherwise(F.array(scanned))
    return base.select("run_id", F.lit(0).cast("bigint").alias("run_generation"), "ts", F.inline(rows))


_DETECTIONS = "array<struct<detection_id:int,x:float,y:float,confidence:float,uncertainty_radius:float>>"


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recording_events(table(spark, sf_dir, "events")).drop("ts")


def recording_text(events: DataFrame) -> DataFrame:
    """(source, line_no, line): the recordings as numbered text, header included."""
    from sonde.operators.decode import recording_lines
    from sonde.schemas import RECORDING_HEADER

    body = recording_lines(events).select(
        F.col("run_id").cast("string").alias("source"), (F.col("stream_sequence") + 1).alias("line_no"), "line")
    heads = events.filter(F.col("event_type") == "RUN_STARTED").select(
        F.col("run_id").cast("string").alias("source"), F.lit(1).cast("bigint").alias("line_no"),
        F.lit(RECORDING_HEADER).alias("line"))
    return body.unionByName(heads)


def experiments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(experiments, experiment_metrics): one run per customer, conditions from the nation.

    An experiment is a market segment within 4,096 consecutive customers, so it stays within the
    run limit of a sweep.  The seed is the customer key, so (condition, seed) never repeats.
    """
    name = F.concat_ws("-", "c_mktsegment", F.expr("c_custkey div 4096").cast("string"))
    who = table(spark, sf_dir, "customer").select(
        name.alias("experiment_id"), F.concat(F.lit("study "), name).alias("experiment_name"),
        (F.col("c_custkey") + 1).alias("run_id"), F.col("c_custkey").alias("seed"),
        (F.col("c_nationkey") % 3).cast("double").alias("noise"),
        (F.lit(0.5) + (F.col("c_nationkey") % 2) / 4).alias("reliability"))
    per_run = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("orders"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("finished"),
        F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)).alias("urgent"),
        F.max("o_totalprice").alias("top"))
    fixed = {"generator_version": "procedural-v1", "layout_seed": 73, "duration_seconds": 20, "target_count": 4,
             "sensor_count": 3, "tick_hz": 8, "speed_min": 14.0, "speed_max": 16.0, "maneuver": 1.0,
             "convergence": 1.0, "spawn_spread": 1.0, "coverage": 1.0, "layout_spread": 1.0, "clutter": 1.0}
    experiment = who.select(
        "*", F.col("seed").alias("scenario_seed"), *(F.lit(v).alias(n) for n, v in fixed.items()))
    metrics = who.join(per_run, F.col("seed") == F.col("o_custkey"), "left").select(
        "experiment_id", "experiment_name", "run_id", "seed",
        F.lit("greedy-distance-v1").alias("evaluator_version"), F.lit("{}").alias("fusion_config"),
        F.lit(5.0).alias("evaluation_gate"),
        F.when(F.col("finished") > 0, F.col("top") / 1000).alias("position_rmse"),
        F.coalesce("urgent", F.lit(0)).cast("bigint").alias("missed_target_samples"),
        F.coalesce("orders", F.lit(0)).cast("bigint").alias("target_samples"),
        F.coalesce(F.col("finished"), F.lit(0)).cast("bigint").alias("id_switches"),
        (F.coalesce("orders", F.lit(0)) * 3).cast("bigint").alias("measurement_count"),
        (F.coalesce("orders", F.lit(0)) * 3 / 20).alias("measurements_per_second"),
        (F.coalesce("orders", F.lit(0)) * 3 / (F.coalesce("orders", F.lit(0)) + 1)).alias("measurements_per_scan"),
        (F.coalesce("urgent", F.lit(0)) * 2).cast("bigint").alias("false_track_samples"),
        F.coalesce("urgent", F.lit(0)).cast("bigint").alias("unique_false_tracks"))
    return experiment, metrics
