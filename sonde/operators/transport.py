"""Delivery analytics over trace marks and delivered events, per experiment.

Marks have (keys..., arrival, phase, sequence, wall_ns), `arrival` being the position in the
trace file.  Repeated marks are settled by partial aggregation: the last produced mark counts,
and the first consumed one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonde.plans.ordered import BLOCK_ROWS, carry, depth_blocks, exact_percentiles, first_rows, row_blocks

KEYS = ("experiment_id",)
PERCENTILES = {"latency_p50_ms": 50, "latency_p95_ms": 95, "latency_p99_ms": 99}


def produced_marks(produced: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    made = produced.filter(F.col("phase") == "produced").select(*keys, "sequence", "arrival", "wall_ns")
    return first_rows(made, [*keys, "sequence"], ["arrival"], descending=True)


def consumed_marks(consumed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    taken = consumed.filter(F.col("phase") == "consumed").select(*keys, "sequence", "arrival", "wall_ns")
    return first_rows(taken, [*keys, "sequence"], ["arrival"])


def _paired(produced: DataFrame, consumed: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    p = produced_marks(produced, keys).select(*keys, "sequence", F.col("wall_ns").alias("produced_ns"))
    c = consumed_marks(consumed, keys).select(*keys, "sequence", F.col("wall_ns").alias("consumed_ns"))
    return p.join(c, [*keys, "sequence"], how)


def delivery_integrity(expected: DataFrame, actual: DataFrame, keys: Sequence[str] = ("run_id",),
                       block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Duplicates, conflicts, losses, extras, order breaks and changed payloads per key.

    expected/actual: (keys..., stream_sequence, payload), actual also `arrival`.
    """
    key = [*keys, "stream_sequence"]
    copies = actual.groupBy(*key, "payload").agg(F.min("arrival").alias("arrival"), F.count(F.lit(1)).alias("n"))
    firsts = copies.groupBy(*key).agg(
        F.min_by(F.struct("payload", "n"), "arrival").alias("first"), F.min("arrival").alias("arrival"),
        F.sum("n").alias("total"))
    arrived = carry(
        firsts, list(keys), ["arrival"], row_blocks("arrival", block_rows),
        lags={"previous": F.col("stream_sequence")})
    seen = arrived.select(
        *key, F.col("first.payload").alias("actual_payload"), (F.col("total") - 1).alias("repeats"),
        (F.col("total") - F.col("first.n")).alias("conflicts"),
        (F.col("stream_sequence") <= F.coalesce("previous", F.lit(0))).alias("out_of_order"), F.lit(True).alias("seen"))
    planned = expected.groupBy(*key).agg(F.max("payload").alias("payload")).withColumn("planned", F.lit(True))
    both = planned.join(seen, key, "full")
    counts = both.groupBy(*keys).agg(
        F.coalesce(F.sum("repeats"), F.lit(0)).alias("duplicate_count"),
        F.coalesce(F.sum("conflicts"), F.lit(0)).alias("conflicting_duplicate_count"),
        F.count_if(F.col("seen").isNull()).alias("missing_sequence_count"),
        F.count_if("out_of_order").alias("ordering_violations"),
        F.count_if(F.col("planned").isNull()).alias("unexpected_event_count"),
        F.count_if(F.col("planned") & F.col("seen") & ~F.col("payload").eqNullSafe(F.col("actual_payload"))).alias(
            "payload_mismatches"))
    names = [c for c in counts.columns if c not in keys]
    clean = F.lit(True)
    for n in names:
        clean = clean & (F.col(n) == 0)
    return counts.withColumn("integrity_pass", clean)


def latency(produced: DataFrame, consumed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Milliseconds from production to consumption of each event with both marks."""
    return _paired(produced, consumed, keys, "inner").withColumn(
        "latency_ms", (F.col("consumed_ns") - F.col("produced_ns")) / 1e6)


def latency_percentiles(latencies: DataFrame, keys: Sequence[str] = KEYS,
                        percents: dict[str, float] | None = None, block: Column | None = None) -> DataFrame:
    """Exact interpolated percentiles; blocks are one millisecond of latency wide."""
    block = F.floor("latency_ms").cast("bigint") if block is None else block
    return exact_percentiles(latencies, list(keys), "latency_ms", percents or PERCENTILES, block)


def throughput(produced: DataFrame, consumed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Events per second over first-to-last interval; null below two marks or at zero span."""
    both = _paired(produced, consumed, keys, "full")

    def rate(column: str) -> Column:
        span = F.max(column) - F.min(column)
        return F.when((F.count(column) > 1) & (span > 0), (F.count(column) - 1) * F.lit(1e9) / span)

    return both.groupBy(*keys).agg(
        F.count("produced_ns").alias("total_produced"),
        rate("produced_ns").alias("produced_events_per_second"),
        rate("consumed_ns").alias("consumed_events_per_second"))


def backlog(produced: DataFrame, consumed: DataFrame, keys: Sequence[str] = KEYS,
            block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Outstanding events after every mark, in (time, produced first, sequence) order.

    Blocks hold about `block_rows` marks, so a minute that holds them all is no single task.
    """
    both = _paired(produced, consumed, keys, "full")
    # An event consumed before it was produced is never outstanding; one never produced neither.
    waits = F.col("produced_ns").isNotNull() & ~F.coalesce(F.col("consumed_ns") < F.col("produced_ns"), F.lit(False))
    step = F.when(waits, 1).otherwise(0)
    marks = both.select(*keys, "sequence", F.explode(F.array(
        F.struct(F.col("produced_ns").alias("wall_ns"), F.lit(0).alias("phase_order"), step.alias("delta")),
        F.struct(F.col("consumed_ns").alias("wall_ns"), F.lit(1).alias("phase_order"), (-step).alias("delta")))).alias("m")).select(*keys, "sequence", "m.*").filter(
        F.col("wall_ns").isNotNull())
    return carry(
        depth_blocks(marks, keys, "wall_ns", block_rows), list(keys), ["wall_ns", "phase_order", "sequence"], F.col("depth_block"),
        sums={"outstanding_events": F.col("delta")}).drop("depth_block")


def backlog_peaks(timeline: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return timeline.groupBy(*keys).agg(
        F.max("outstanding_events").alias("max_backlog"),
        F.max_by("outstanding_events", F.struct("wall_ns", "phase_order", "sequence")).alias("final_backlog"))


def catchup_seconds(timeline: DataFrame, consumed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Seconds from the last resume to an empty backlog; 0 when empty already, null when never."""
    resumes = consumed.filter(F.col("phase") == "resume").groupBy(*keys).agg(
        F.max_by("wall_ns", "arrival").alias("resume_ns"))
    t, lag = F.col("wall_ns"), F.col("outstanding_events")
    order = F.struct("wall_ns", "phase_order", "sequence")
    # The timeline leads: resumes are one row for each key, and its marks are aggregated before the second join.
    around = timeline.join(resumes, list(keys)).groupBy(*keys).agg(
        F.max_by(F.when(t <= F.col("resume_ns"), lag), F.when(t <= F.col("resume_ns"), order)).alias("lag"),
        F.min(F.when((t >= F.col("resume_ns")) & (lag == 0), t)).alias("empty_ns"))
    around = resumes.join(around, list(keys), "left")
    caught = F.when(F.coalesce("lag", F.lit(0)) == 0, F.col("resume_ns")).otherwise(F.col("empty_ns"))
    return around.select(*keys, ((caught - F.col("resume_ns")) / 1e9).alias("catchup_seconds"))


def clock_errors(produced: DataFrame, consumed: DataFrame, keys: Sequence[str] = KEYS,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Negative latencies plus backward clock steps within each trace file."""
    negative = latency(produced, consumed, keys).filter(F.col("latency_ms") < 0).select(*keys)

    def steps(marks: DataFrame) -> DataFrame:
        lagged = carry(marks.select(*keys, "arrival", "wall_ns"), list(keys), ["arrival"],
                       row_blocks("arrival", block_rows), lags={"previous_ns": F.col("wall_ns")})
        return lagged.filter(F.col("wall_ns") < F.col("previous_ns")).select(*keys)

    return negative.unionByName(steps(produced)).unionByName(steps(consumed)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("clock_errors"))


def trace_integrity(produced: DataFrame, consumed: DataFrame, expected: DataFrame, actual: DataFrame,
                    keys: Sequence[str] = KEYS) -> DataFrame:
    """Marked ids equal the event ids on both sides, and no mark is repeated.

    expected/actual need (keys..., sequence).
    """
    def ids(df: DataFrame, flag: str) -> DataFrame:
        return df.select(*keys, "sequence", F.lit(flag).alias("kind"))

    tagged = (ids(produced, "produced_row")
              .unionByName(ids(produced.filter(F.col("phase") == "produced"), "p"))
              .unionByName(ids(consumed.filter(F.col("phase") == "consumed"), "c"))
              .unionByName(ids(expected, "expected")).unionByName(ids(actual, "actual")))
    count = lambda k: F.count_if(F.col("kind") == k)
    per_id = tagged.groupBy(*keys, "sequence").agg(*(
        count(k).alias(k) for k in ("produced_row", "p", "c", "expected", "actual")))
    wrong = (((F.col("p") > 0) != (F.col("expected") > 0)) | ((F.col("c") > 0) != (F.col("actual") > 0))
             | (F.col("produced_row") > F.when(F.col("p") > 0, 1).otherwise(0)) | (F.col("c") > 1))
    return per_id.groupBy(*keys).agg(F.count_if(wrong).alias("wrong_ids")).withColumn(
        "trace_integrity_pass", F.col("wrong_ids") == 0)


def transport_metrics(produced: DataFrame, consumed: DataFrame, expected: DataFrame, actual: DataFrame,
                      block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per experiment with every delivery metric; all frames keyed by experiment_id."""
    keys = list(KEYS)
    ids = lambda df: df.select(*keys, F.col("stream_sequence").alias("sequence"))
    timeline = backlog(produced, consumed, keys, block_rows)
    consumed_total = consumed.groupBy(*keys).agg(
        F.count_if(F.col("phase") == "consumed").alias("total_consumed"),
        F.coalesce(F.max(F.col("phase") == "resume"), F.lit(False)).alias("pause_observed"))
    out = delivery_integrity(expected, actual, keys)
    for part in (throughput(produced, consumed, keys), consumed_total,
                 latency_percentiles(latency(produced, consumed, keys), keys), backlog_peaks(timeline, keys),
                 catchup_seconds(timeline, consumed, keys), clock_errors(produced, consumed, keys),
                 trace_integrity(produced, consumed, ids(expected), ids(actual), keys).drop("wrong_ids")):
        out = out.join(part, keys, "left")
    zero = ("total_produced", "total_consumed", "max_backlog", "final_backlog", "clock_errors")
    return out.na.fill(0, list(zero)).withColumn("pause_observed", F.coalesce("pause_observed", F.lit(False))).withColumn(
        "integrity_pass", F.col("integrity_pass") & F.coalesce("trace_integrity_pass", F.lit(False))
        & (F.col("clock_errors") == 0))


# ---- sensor outages ------------------------------------------------------------------------------

def disjoint(outages: DataFrame) -> DataFrame:
    """(run_id, sensor_id, start, end) of the united outages of each sensor, at float32 precision; empty ones are left out."""
    sensor = ["run_id", "sensor_id"]
    spans = outages.select(*sensor, F.col("start").cast("float").alias("start"), F.col("end").cast("float").alias("end")).filter(
        "start < end").distinct()
    blocked = depth_blocks(spans, sensor, "start")
    reached = carry(blocked, sensor, ["start", "end"], F.col("depth_block"), prior_max={"reached": F.col("end")})
    opens = F.when(F.col("reached").isNull() | (F.col("start") > F.col("reached")), 1).otherwise(0)
    numbered = carry(reached, sensor, ["start", "end"], F.col("depth_block"), sums={"piece": opens})
    return numbered.groupBy(*sensor, "piece").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("piece")


def in_outage(scans: DataFrame, outages: DataFrame) -> DataFrame:
    """Scans with `in_outage`: time in [start, end) of their sensor's outages, at float32 precision.

    outages: (run_id, sensor_id, start, end).  A sensor's scanned time is cut into as many equal bins as it has
    outages; united outages go to each bin they touch, at most two for each on average, and scans to their own, so
    run, sensor and bin carry an equality join.  Bins grow with time as the times do, so no pair is missed; a scan lies in one
    united outage at most.
    """
    sensor = ["run_id", "sensor_id"]
    t = F.col("acquisition_time_seconds")
    spans = disjoint(outages)
    first, latest = F.col("first_time"), F.col("latest_time")
    grid = scans.groupBy(*sensor).agg(F.min(t).cast("double").alias("first_time"), F.max(t).cast("double").alias("latest_time")).join(
        spans.groupBy(*sensor).agg(F.count(F.lit(1)).alias("outages")), sensor)
    grid = grid.select(*sensor, "first_time", "latest_time", F.when(latest > first, (latest - first) / F.col("outages")).otherwise(F.lit(1.0)).alias("width"))

    def bin_of(time: Column) -> Column:
        inside = F.greatest(F.least(time.cast("double"), latest), first)
        return F.floor((inside - first) / F.col("width")).cast("bigint")

    binned = spans.join(grid, sensor).filter((F.col("start") <= latest) & (F.col("end") > first)).select(
        *sensor, "start", "end", F.explode(F.sequence(bin_of(F.col("start")), bin_of(F.col("end")))).alias("bin"))
    placed = scans.join(grid, sensor, "left").withColumn("bin", bin_of(t)).drop("first_time", "latest_time", "width")
    s, o = placed.alias("s"), binned.alias("o")
    same = [F.col(f"s.{c}") == F.col(f"o.{c}") for c in (*sensor, "bin")]
    within = (F.col("o.start") <= F.col("s.acquisition_time_seconds")) & (F.col("s.acquisition_time_seconds") < F.col("o.end"))
    met = s.join(o, [*same, within], "left")
    return met.select(*(F.col(f"s.{c}") for c in scans.columns), F.col("o.start").isNotNull().alias("in_outage"))


def outage_violations(scans: DataFrame, outages: DataFrame) -> DataFrame:
    return in_outage(scans, outages).filter("in_outage")


def per_sensor_stats(scans: DataFrame, outages: DataFrame) -> DataFrame:
    return in_outage(scans, outages).groupBy("run_id", "sensor_id").agg(
        F.count(F.lit(1)).alias("scans"), F.sum("measurement_count").alias("detections"),
        F.count_if("in_outage").alias("outage_scans"))


def transport_comparison(summaries: DataFrame) -> DataFrame:
    """Report rows from nested experiment summaries; failed runs stay, missing timings stay null."""
    m = lambda name: F.col(f"metrics.{name}")
    return summaries.select(
        F.col("config.name").alias("scenario"), "transport", m("total_produced").alias("produced"),
        m("total_consumed").alias("consumed"), F.round(m("produced_events_per_second"), 2).alias("produced_eps"),
        F.round(m("consumed_events_per_second"), 2).alias("consumed_eps"), F.round(m("latency_p50_ms"), 2).alias("p50_ms"),
        F.round(m("latency_p95_ms"), 2).alias("p95_ms"), F.round(m("latency_p99_ms"), 2).alias("p99_ms"),
        m("max_backlog").alias("max_backlog"), F.round(m("catchup_seconds"), 3).alias("recovery_seconds"),
        m("duplicate_count").alias("duplicates"), m("missing_sequence_count").alias("missing"),
        m("integrity_pass").alias("integrity_pass"))


def as_summaries(metrics: DataFrame, name: Column, transport: Column) -> DataFrame:
    """Metrics rows in the nested shape of a summary document."""
    from sonde import schemas

    fields = [f.name for f in schemas.EXPERIMENT_SUMMARY["metrics"].dataType.fields]
    return metrics.select(
        F.struct(name.alias("name")).alias("config"), transport.alias("transport"),
        F.struct(*(F.col(f) for f in fields)).alias("metrics"))
