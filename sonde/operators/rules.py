"""Validation rules: each finds violations instead of stopping at the first.

Lifecycle rules need the stream order of a recording.  They run on narrow rows (no measurement
arrays) through block-wise running columns, so one very long recording is checked by many tasks.
A violation row is (source, run_id, stream_sequence, rule, detail).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonde import schemas
from sonde.functions import grammar as G
from sonde.plans.ordered import BLOCK_ROWS, carry, row_blocks

LIFECYCLE_RULES = (
    "first_is_start", "single_run", "sequence_contiguous", "finite_nonnegative_time", "run_reset_transition",
    "generation_stable", "time_monotone", "sensor_start_window", "sensor_start_order", "known_sensor",
    "sensor_reset_transition", "scan_generation", "scan_sequence_contiguous", "detection_identity",
    "measurement_values", "nothing_after_finish", "finished")
# What a rule compares a row with, beyond the row itself: the run so far, its sensor, or the sensor's life
ROW_RULES = ("finite_nonnegative_time", "measurement_values")
SENSOR_RULES = ("known_sensor", "sensor_reset_transition", "scan_generation")
LIFE_RULES = ("scan_sequence_contiguous", "detection_identity")
RUN_RULES = tuple(r for r in LIFECYCLE_RULES if r not in (*ROW_RULES, *SENSOR_RULES, *LIFE_RULES, "finished"))


def dedup_events(events: DataFrame) -> DataFrame:
    """First occurrence of each (source, run_id, stream_sequence), with how often it came.

    `copies` counts all occurrences, `conflicts` those whose typed payload differs from the
    first one's.  Repeated identities are found on narrow rows, by partial counts, so many copies
    of one event never meet in one task.  The list of repeated identities is short in any sane
    input; joining it then costs no shuffle of the events, and a long one is joined by shuffle.
    """
    from sonde.functions.identity import canonical_event, sha256

    key = ["source", "run_id", "stream_sequence"]
    hashed = events.withColumn("payload_sha256", sha256(canonical_event()))
    repeated = hashed.groupBy(*key, F.unhex("payload_sha256").alias("payload")).agg(
        F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n"),
    ).groupBy(*key).agg(
        F.min("first_line").alias("first_line"), F.sum("n").alias("copies"), F.min_by("n", "first_line").alias("first_n"),
    ).filter(F.col("copies") > 1)
    first = F.col("first_line").isNull() | (F.col("line_no") == F.col("first_line"))
    return hashed.join(repeated, key, "left").filter(first).select(
        *hashed.columns, F.coalesce("copies", F.lit(1)).alias("copies"),
        F.coalesce(F.col("copies") - F.col("first_n"), F.lit(0)).alias("conflicts"))


def conflicting_duplicates(unique: DataFrame) -> DataFrame:
    """Violations for identities that came again with another payload."""
    return _violations(unique.filter(F.col("conflicts") > 0), "conflicting_duplicate",
                       F.concat(F.col("conflicts").cast("string"), F.lit(" conflicting copies")))


def _violations(df: DataFrame, rule: str, detail: Column | None = None) -> DataFrame:
    has = set(df.columns)
    return df.select(
        (F.col("source") if "source" in has else F.lit(None)).cast("string").alias("source"),
        (F.col("run_id") if "run_id" in has else F.lit(None)).cast("decimal(20,0)").alias("run_id"),
        (F.col("stream_sequence") if "stream_sequence" in has else F.lit(None)).cast("bigint").alias("stream_sequence"),
        F.lit(rule).alias("rule"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def running_state(events: DataFrame, block_rows: int = BLOCK_ROWS, only: Sequence[str] = LIFECYCLE_RULES) -> DataFrame:
    """Deduplicated events with the state the lifecycle rules `only` compare against; what none of them needs is not computed.

    Added: position (1-based in its source), resets so far, the previous row's run, generation,
    kind and time, the last reset / scan / sensor start before this row, finishes before it, and
    per sensor: starts, resets, scans and detections so far.
    """
    kind = F.col("event_type")
    starts, resets = kind == "SENSOR_STARTED", kind == "SENSOR_RESET"
    scans, run_reset = kind == "MEASUREMENTS", kind == "RUN_RESET"
    # Whether a scan's ids count up by one is local to the row; only its first id has to match
    # the running total.  That keeps measurement arrays out of every shuffle below.
    detections = F.coalesce("measurements", F.array())
    dense = F.forall(
        F.transform(detections, lambda m, i: (m["detection_id"] - i) == F.get(detections, F.lit(0))["detection_id"]),
        lambda ok: ok)
    bad_value = F.exists(
        detections,
        lambda m: ~F.coalesce(
            G.finite(m["x"]) & G.finite(m["y"]) & G.finite(m["confidence"]) & G.finite(m["uncertainty_radius"])
            & (m["confidence"] >= 0) & (m["confidence"] <= 1) & (m["uncertainty_radius"] >= 0), F.lit(False)))
    narrow = events.select(
        "source", "line_no", "run_id", "run_generation", "stream_sequence", "event_time_seconds", "event_type",
        "sensor_id", "sensor_generation", "scan_sequence", F.size(detections).cast("bigint").alias("detections"),
        F.get(detections, F.lit(0))["detection_id"].alias("first_detection"), dense.alias("dense_ids"),
        bad_value.alias("bad_value"))
    one = F.lit(1).cast("bigint")
    needs = lambda names: any(r in names for r in only)
    ordered = narrow if not needs(RUN_RULES) else carry(
        narrow, ["source"], ["line_no"], row_blocks("line_no", block_rows),
        sums={"position": one, "resets": F.when(run_reset, 1)},
        prior_max={
            "reset_line": F.when(run_reset, F.col("line_no")),
            "scan_line": F.when(scans | resets, F.col("line_no")),
            "last_start": F.when(starts, F.struct("line_no", "sensor_id")),
            "finish_line": F.when(kind == "RUN_FINISHED", F.col("line_no")),
        },
        lags={"previous_run": F.col("run_id"), "previous_time": F.col("event_time_seconds")})
    if not needs((*SENSOR_RULES, *LIFE_RULES)):
        return ordered
    sensor_rows = ordered.filter(kind.isin(*schemas.SENSOR_KINDS))
    other_rows = ordered.filter(~kind.isin(*schemas.SENSOR_KINDS))
    block = row_blocks("line_no", block_rows)
    per_sensor = sensor_rows if not needs(SENSOR_RULES) else carry(
        sensor_rows, ["source", "run_generation", "sensor_id"], ["line_no"], block,
        sums={"sensor_starts": F.when(starts, 1), "sensor_resets": F.when(resets, 1)})
    per_life = per_sensor if not needs(LIFE_RULES) else carry(
        per_sensor, ["source", "run_generation", "sensor_id", "sensor_generation"], ["line_no"], block,
        sums={"scan_count": F.when(scans, 1), "detection_count": F.when(scans, F.col("detections"))})
    return per_life.unionByName(other_rows, allowMissingColumns=True)


def lifecycle_violations(events: DataFrame, block_rows: int = BLOCK_ROWS, only: Sequence[str] = LIFECYCLE_RULES) -> DataFrame:
    """All violations of the ordering, generation, identity and value rules, or of the rules `only`."""
    state = running_state(events, block_rows, only)
    kind = F.col("event_type")
    starts, resets = kind == "SENSOR_STARTED", kind == "SENSOR_RESET"
    scans, run_reset = kind == "MEASUREMENTS", kind == "RUN_RESET"
    first, time = F.col("position") == 1, F.col("event_time_seconds")
    generation = F.col("run_generation")
    since_reset = lambda line: line.isNotNull() & (line > F.coalesce("reset_line", F.lit(0)))
    started_before = F.col("sensor_starts") > 0
    broken = {
        "first_is_start": F.when(
            first, (kind != "RUN_STARTED") | (F.col("run_id") == 0) | (F.col("stream_sequence") != 1)
            | (generation != 0) | (time != 0)).otherwise(kind == "RUN_STARTED"),
        "single_run": ~first & (F.col("run_id") != F.col("previous_run")),
        "sequence_contiguous": F.col("stream_sequence") != F.col("position"),
        "finite_nonnegative_time": ~(G.finite(time) & (time >= 0)),
        "run_reset_transition": run_reset & ((generation != F.col("resets")) | (time != 0) | first),
        "generation_stable": ~run_reset & (generation != F.col("resets")),
        "time_monotone": ~run_reset & (time < F.col("previous_time")),
        "sensor_start_window": starts & (
            since_reset(F.col("scan_line")) | (time != 0) | (F.col("sensor_generation") != 0)),
        "sensor_start_order": starts & since_reset(F.col("last_start.line_no")) & (
            F.col("sensor_id") <= F.col("last_start.sensor_id")),
        "known_sensor": (resets | scans) & ~started_before,
        "sensor_reset_transition": resets & started_before & (F.col("sensor_generation") != F.col("sensor_resets")),
        "scan_generation": scans & started_before & (F.col("sensor_generation") != F.col("sensor_resets")),
        "scan_sequence_contiguous": scans & (F.col("scan_sequence") != F.col("scan_count")),
        "detection_identity": scans & (F.col("detections") > 0) & ~(
            F.col("dense_ids") & (F.col("first_detection") == F.col("detection_count") - F.col("detections") + 1)),
        "measurement_values": scans & F.col("bad_value"),
        "nothing_after_finish": F.col("finish_line").isNotNull(),
    }
    failed = F.array_compact(F.array(*(
        F.when(F.coalesce(cond, F.lit(False)), F.lit(rule)) for rule, cond in broken.items() if rule in only)).cast("array<string>"))
    found = state.select("source", "run_id", "stream_sequence", F.explode(failed).alias("rule"),
                         F.concat(F.lit("line "), F.col("line_no").cast("string")).alias("detail"))
    row_rules = found.select(
        "source", F.col("run_id").cast("decimal(20,0)").alias("run_id"), F.col("stream_sequence").cast("bigint"),
        "rule", "detail")
    if "finished" not in only:
        return row_rules
    unfinished = events.groupBy("source").agg(
        F.min_by("run_id", "line_no").alias("run_id"), F.count_if(kind == "RUN_FINISHED").alias("ends")
    ).filter(F.col("ends") == 0)
    missing = _violations(unfinished, "finished", F.lit("missing RUN_FINISHED"))
    return missing if set(only) == {"finished"} else row_rules.unionByName(missing)


def grammar_violations(decoded: DataFrame) -> DataFrame:
    """C18/C19: lines the decoder refused, measurement counts included."""
    bad = decoded.filter(F.col("error").isNotNull())
    rule = F.when(F.col("error").contains("count does not match"), "measurement_count").otherwise("token_grammar")
    return bad.select(
        "source", F.col("run_id").cast("decimal(20,0)").alias("run_id"), F.col("stream_sequence").cast("bigint"),
        rule.alias("rule"),
        F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": "), F.col("error")).alias("detail"))


def validate_events(events: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Lifecycle rules plus conflicting duplicates over typed events with `line_no`."""
    unique = dedup_events(events)
    return lifecycle_violations(unique, block_rows).unionByName(conflicting_duplicates(unique))


def violation_counts(violations: DataFrame) -> DataFrame:
    return violations.groupBy("source", "rule").agg(F.count(F.lit(1)).alias("violations"))


# ---- reconciliation of stored tables -----------------------------------------------------------

def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(run_id, events, scans, measurements) counted from the three tables."""
    tagged = union_all([df.select("run_id", F.lit(name).alias("t")) for name, df in tables.items()])
    return tagged.groupBy("run_id").agg(*(
        F.count_if(F.col("t") == name).alias(name) for name in ("events", "scans", "measurements")))


def reconcile_counts(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Runs whose stored row counts differ from the source's, missing runs included."""
    names = ("events", "scans", "measurements")
    both = expected.select("run_id", *(F.col(n).alias(f"e_{n}") for n in names)).join(
        actual.select("run_id", *(F.col(n).alias(f"a_{n}") for n in names)), "run_id", "full")
    differs = reduce(lambda a, b: a | b, (~F.col(f"e_{n}").eqNullSafe(F.col(f"a_{n}")) for n in names))
    detail = F.concat_ws(", ", *(F.format_string(f"{n} %s/%s", f"e_{n}", f"a_{n}") for n in names))
    return _violations(both.filter(differs), "reconcile_counts", detail)


def reconcile_event_scan(events: DataFrame, scans: DataFrame) -> DataFrame:
    """Scan events whose (sequence, count) is not among the scans."""
    key = ("run_id", "stream_sequence", "measurement_count")
    missing = events.filter(F.col("event_type") == "MEASUREMENTS").select(*key).subtract(scans.select(*key))
    return _violations(missing, "reconcile_event_scan")


def reconcile_scan_measurements(scans: DataFrame, measurements: DataFrame) -> DataFrame:
    """Scans whose count differs from their measurement rows, and measurements without a scan."""
    key = ["run_id", "stream_sequence"]
    counted = measurements.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    both = scans.select(*key, "measurement_count").join(counted, key, "full")
    wrong = both.filter(
        F.col("measurement_count").isNull() | (F.col("measurement_count") != F.coalesce("n", F.lit(0))))
    return _violations(wrong, "reconcile_scan_measurements",
                       F.format_string("declared %s, stored %s", "measurement_count", "n"))


def repeated_keys(df: DataFrame, keys: Sequence[str], label: str = "table_keys") -> DataFrame:
    """Key values held by more than one row, by partial counts."""
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return _violations(twice, label, F.concat_ws(" ", *(F.col(k).cast("string") for k in keys)))


def null_columns(df: DataFrame, schema: T.StructType, label: str = "not_null") -> DataFrame:
    """Rows with a null in a column declared NOT NULL."""
    required = [f.name for f in schema.fields if not f.nullable]
    return _violations(
        df.filter(_any_null(required)), label,
        F.concat_ws(" ", *(F.when(F.col(c).isNull(), F.lit(c)) for c in required)))


def table_constraints(tables: dict[str, DataFrame]) -> DataFrame:
    """Primary keys, unique keys and NOT NULL columns of the clean tables."""
    parts = []
    for name, df in tables.items():
        parts.append(null_columns(df, schemas.CLEAN_TABLES[name]))
        parts += [repeated_keys(df, keys) for keys in schemas.TABLE_KEYS[name]]
    return union_all(parts)


def _any_null(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns))


# ---- track frames -----------------------------------------------------------------------------

def track_frame_rules(frames: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Order, schema, generation, time and track rules of frames with (source, line_no).

    A source of frames must start with RUN_STARTED, end with RUN_FINISHED and count its source
    sequence from 1; per-frame track rules look only inside the frame's own array.
    """
    tracks = F.coalesce("tracks", F.array())
    ids = F.transform(tracks, lambda t: t["track_id"])
    values_ok = lambda t: reduce(
        lambda a, b: a & b, (G.finite(t[c]) for c in ("x", "y", "vx", "vy", "last_seen")))
    local = frames.select(
        "source", "line_no", "run_id", "run_generation", F.col("source_sequence").alias("stream_sequence"),
        "acquisition_time", "source_type",
        ((F.col("schema_version") == 1) & (F.col("event_type") == "GLOBAL_TRACKS")).alias("schema_ok"),
        ((F.size(F.array_distinct(ids)) == F.size(ids)) & F.forall(
            tracks, lambda t: (t["track_id"] > 0) & t["state"].isin(*schemas.TRACK_STATES))).alias("tracks_ok"),
        F.forall(tracks, values_ok).alias("values_ok"))
    reset = F.col("source_type") == "RUN_RESET"
    state = carry(
        local, ["source"], ["line_no"], row_blocks("line_no", block_rows),
        sums={"position": F.lit(1).cast("bigint"), "resets": F.when(reset, 1)},
        lags={"previous_run": F.col("run_id"), "previous_time": F.col("acquisition_time")})
    time, first = F.col("acquisition_time"), F.col("position") == 1
    broken = {
        "frame_start": first & (F.col("source_type") != "RUN_STARTED"),
        "frame_order": ~F.col("schema_ok") | (~first & (F.col("run_id") != F.col("previous_run")))
        | (F.col("stream_sequence") != F.col("position")),
        "frame_reset": reset & (time != 0),
        "frame_generation_time": (F.col("run_generation") != F.col("resets")) | ~G.finite(time)
        | (time < F.when(first | reset, F.lit(0.0)).otherwise(F.col("previous_time"))),
        "track_identity": ~F.col("tracks_ok"),
        "track_values": ~F.col("values_ok"),
    }
    failed = F.array_compact(F.array(*(
        F.when(F.coalesce(c, F.lit(True)), F.lit(rule)) for rule, c in broken.items())))
    rows = state.select(
        "source", F.col("run_id").cast("decimal(20,0)").alias("run_id"), "stream_sequence",
        F.explode(failed).alias("rule"), F.concat(F.lit("frame "), F.col("line_no").cast("string")).alias("detail"))
    last = frames.groupBy("source").agg(
        F.max_by("source_type", "line_no").alias("last"), F.min_by("run_id", "line_no").alias("run_id"))
    return rows.unionByName(_violations(last.filter(F.col("last") != "RUN_FINISHED"), "frame_finish"))


# ---- analytical artifacts -----------------------------------------------------------------------

def analytical_identity(table: DataFrame, clean_runs: DataFrame) -> DataFrame:
    """Rows whose run is null or has no published clean run."""
    known = clean_runs.select("run_id").distinct()
    return _violations(table.join(known, "run_id", "left_anti"), "analytical_identity")


def analytical_nulls(table: DataFrame) -> DataFrame:
    return _violations(table.filter(_any_null(table.columns)), "analytical_nulls")


def analytical_finite(table: DataFrame) -> DataFrame:
    numbers = [f.name for f in table.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not numbers:
        return _violations(table.filter(F.lit(False)), "analytical_finite")
    bad = reduce(lambda a, b: a | b, (~G.finite(F.col(c)) for c in numbers))
    return _violations(table.filter(bad), "analytical_finite")


def metadata_row(runs: DataFrame) -> DataFrame:
    """Exactly one metadata row per run, with positive sizes and the fixed tick rate."""
    repeated = repeated_keys(runs, ["run_id"], "metadata_row")
    wrong = runs.filter(
        (F.col("duration_seconds") <= 0) | (F.col("target_count") <= 0) | (F.col("sensor_count") <= 0)
        | (F.col("tick_hz") != schemas.TICK_HZ))
    return repeated.unionByName(_violations(wrong, "metadata_row"))


def metadata_absent(runs: DataFrame, *others: DataFrame) -> DataFrame:
    """Runs that other artifacts speak of but that have no metadata row."""
    named = reduce(lambda a, b: a.unionAll(b), (t.select(F.col("run_id").cast("decimal(20,0)").alias("run_id")).distinct() for t in others)).distinct()
    lost = named.filter(F.col("run_id").isNotNull()).join(runs.select(F.col("run_id").cast("decimal(20,0)").alias("run_id")), "run_id", "left_anti")
    return _violations(lost.withColumn("detail", F.lit("no metadata row")), "metadata_row")


def sensor_metadata(runs: DataFrame, sensors: DataFrame, events: DataFrame) -> DataFrame:
    """Sensor count and identities against the metadata; (id, seed) against the recording."""
    counted = sensors.groupBy("run_id", "sensor_id").agg(F.count(F.lit(1)).alias("n")).groupBy("run_id").agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("ids"))
    wrong = runs.select("run_id", "sensor_count").join(counted, "run_id", "left").filter(
        ~(F.col("rows").eqNullSafe(F.col("sensor_count").cast("bigint"))
          & F.col("ids").eqNullSafe(F.col("sensor_count").cast("bigint"))))
    pair = ("run_id", "sensor_id", "seed")
    started = events.filter(F.col("event_type") == "SENSOR_STARTED").join(
        runs.select("run_id"), "run_id", "left_semi").select(*pair)
    listed = sensors.select(*pair)
    return union_all([
        _violations(wrong, "sensor_metadata", F.lit("count")),
        _violations(started.exceptAll(listed), "sensor_metadata", F.lit("not in metadata")),
        _violations(listed.exceptAll(started), "sensor_metadata", F.lit("not in recording"))])


def frames_match_events(frames: DataFrame, events: DataFrame) -> DataFrame:
    """Every event has a frame of the same time, kind and generation, and no frame is extra."""
    key = ["run_id", "stream_sequence"]
    f = frames.select(
        "run_id", F.col("source_sequence").alias("stream_sequence"), F.col("acquisition_time").alias("f_time"),
        F.col("source_type").alias("f_kind"), F.col("run_generation").alias("f_generation"))
    e = events.select(*key, F.col("event_time_seconds").cast("double").alias("e_time"), "event_type", "run_generation")
    both = e.join(f, key, "full")
    wrong = both.filter(~(
        F.col("e_time").eqNullSafe(F.col("f_time")) & F.col("event_type").eqNullSafe(F.col("f_kind"))
        & F.col("run_generation").eqNullSafe(F.col("f_generation"))))
    return _violations(wrong, "frames_match_events")


def complete_generation(frames: DataFrame, runs: DataFrame) -> DataFrame:
    """One generation only, and the last frame at the run's duration."""
    last = frames.groupBy("run_id").agg(
        F.max_by("acquisition_time", "source_sequence").alias("end"), F.max("run_generation").alias("top"))
    wrong = runs.select("run_id", "duration_seconds").join(last, "run_id", "left").filter(
        ~F.coalesce((F.col("end") == F.col("duration_seconds")) & (F.col("top") == 0), F.lit(False)))
    return _violations(wrong, "complete_generation")


def expected_truth(runs: DataFrame) -> DataFrame:
    """(run_id, target_id, timestamp) of every tick and target; each run expands from its own row."""
    return runs.select(
        "run_id", "target_count", "tick_hz",
        F.explode(F.sequence(F.lit(0), F.col("duration_seconds") * F.col("tick_hz"))).alias("tick"),
    ).select(
        "run_id", F.explode(F.sequence(F.lit(1), F.col("target_count"))).alias("target_id"),
        (F.col("tick") / F.col("tick_hz")).alias("timestamp"))


def truth_grid(runs: DataFrame, ground_truth: DataFrame) -> DataFrame:
    """Missing, unexpected and repeated truth rows.

    Ticks are exploded from small rows, which size estimates do not see, so both sides are joined by shuffle
    and never collected for a broadcast.
    """
    key = ["run_id", "target_id", "timestamp"]
    expected, actual = expected_truth(runs), ground_truth.select(*key)
    return union_all([
        _violations(expected.join(actual.hint("merge"), key, "left_anti"), "truth_grid", F.lit("missing")),
        _violations(actual.join(expected.hint("merge"), key, "left_anti"), "truth_grid", F.lit("unexpected")),
        repeated_keys(actual, key, "truth_grid")])


def analysis_relations(scans: DataFrame, sensors: DataFrame, tracks: DataFrame, events: DataFrame,
                       run_metrics: DataFrame) -> DataFrame:
    """Foreign keys and totals across the clean and analytical tables."""
    analysed = run_metrics.select("run_id")
    own_scans = scans.join(analysed, "run_id", "left_semi")
    no_sensor = own_scans.join(sensors.select("run_id", "sensor_id"), ["run_id", "sensor_id"], "left_anti")
    no_event = tracks.join(
        events.select("run_id", F.col("stream_sequence").alias("source_sequence")), ["run_id", "source_sequence"], "left_anti")
    times = own_scans.groupBy("run_id", "acquisition_time_seconds").agg(F.lit(1).alias("one")).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("scan_times"))
    frames_off = run_metrics.join(times, "run_id", "left").filter(
        ~F.col("evaluated_frames").eqNullSafe(F.coalesce("scan_times", F.lit(0).cast("bigint"))))
    totals_off = run_metrics.filter(
        F.col("target_samples") != F.col("matched_samples") + F.col("missed_target_samples"))
    return union_all([
        _violations(no_sensor, "analysis_relations", F.lit("scan without sensor")),
        _violations(no_event, "analysis_relations", F.lit("track without event")),
        repeated_keys(tracks, ["run_id", "run_generation", "acquisition_time", "track_id"], "analysis_relations"),
        _violations(frames_off, "analysis_relations", F.lit("evaluated frames")),
        _violations(totals_off, "analysis_relations", F.lit("target samples"))])


# ---- sweeps, studies and result contracts ---------------------------------------------------------

def sweep_identity(table: DataFrame, manifest: DataFrame) -> DataFrame:
    """Run counts, distinct runs, one experiment per sweep, names and seeds, against its manifest.

    `manifest` has one row per experiment: experiment_id, name, run_count.
    """
    counts = table.groupBy("experiment_id", "run_id").agg(F.count(F.lit(1)).alias("n")).groupBy("experiment_id").agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("ids"))
    wrong = manifest.join(counts, "experiment_id", "left").filter(
        ~(F.col("rows").eqNullSafe(F.col("run_count")) & F.col("ids").eqNullSafe(F.col("run_count"))))
    named = table.join(
        manifest.select("experiment_id", F.col("name").alias("manifest_name")), "experiment_id", "left")
    odd = named.filter(~F.col("experiment_name").eqNullSafe(F.col("manifest_name")) | F.col("seed").isNull())
    return _violations(wrong, "sweep_identity", F.lit("run count")).unionByName(
        _violations(odd, "sweep_identity", F.lit("experiment or seed")))


def sweep_checks(individual: DataFrame, values: DataFrame, statistics: DataFrame, manifest: DataFrame) -> DataFrame:
    """Membership, seed match, one seed per condition, finite metrics, and run accounting."""
    joined = individual.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("n"))
    members = manifest.join(joined, "experiment_id", "left").filter(
        ~F.coalesce("n", F.lit(0).cast("bigint")).eqNullSafe(F.col("run_count")))
    seeds = individual.filter(~F.col("seed").eqNullSafe(F.col("scenario_seed")))
    infinite = values.filter(F.col("value").isNotNull() & ~G.finite(F.col("value")))
    accounted = statistics.groupBy("experiment_id", "analysis", "metric").agg(F.sum("run_count").alias("n")).join(
        manifest, "experiment_id").filter(F.col("n") != F.col("run_count"))
    return union_all([
        _violations(members, "sweep_membership"), _violations(seeds, "seed_match"),
        repeated_keys(individual, ["experiment_id", "condition_id", "seed"], "unique_seed_per_condition"),
        _violations(infinite, "finite_metric"), _violations(accounted, "run_accounting")])


def paired_seeds(statistics: DataFrame, plan: DataFrame) -> DataFrame:
    """Each charted condition present once per planned level, with exactly the planned seeds.

    `plan` has one row per (analysis, metric): level_count and the ordered `seeds` array.
    """
    charted = statistics.join(plan.withColumnRenamed("seeds", "planned"), ["analysis", "metric"], "right")
    wrong = charted.filter(
        F.col("run_count").isNull() | (F.col("run_count") != F.size("planned")) | ~F.col("seeds").eqNullSafe(F.col("planned")))
    levels = charted.groupBy("analysis", "metric", "level_count").agg(F.count("run_count").alias("n")).filter(
        F.col("n") != F.col("level_count"))
    return _violations(wrong, "paired_seeds", F.concat_ws(" ", "analysis", "metric")).unionByName(
        _violations(levels, "paired_seeds", F.concat_ws(" ", "analysis", "metric")))


def result_invariants(points: DataFrame) -> DataFrame:
    """Display contract of study points (panel, chart, value, runs, valid, mean, stddev, minimum, maximum).

    With `experiment_id` each experiment is a study of its own.  Null statistics are read as 0, as the display export
    writes them.
    """
    study = [c for c in ("experiment_id",) if c in points.columns]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    mean, sd, low, high = zero("mean"), zero("stddev"), zero("minimum"), zero("maximum")
    seeds = points.groupBy(*study).agg(F.max("runs").alias("seeds"))
    per_chart = Window.partitionBy(*study, "panel", "chart").orderBy("value")  # at most five levels per chart
    ranked = points.withColumn("rank", F.row_number().over(per_chart)).withColumn(
        "same_before", F.lag("value").over(per_chart) == F.col("value"))
    bad = (~(G.finite(F.col("value")) & G.finite(mean) & G.finite(sd) & G.finite(low) & G.finite(high))
           | (F.col("value") < 0) | (sd < 0) | (low < 0) | (mean < low) | (mean > high)
           | (F.col("valid") < 0) | (F.col("valid") > F.col("runs")) | F.coalesce("same_before", F.lit(False)))
    label, place = F.concat_ws(" ", *study, "panel", "chart"), F.concat_ws(" ", *study, "panel")
    # The expected run count is the study's seeds per condition: one row for each study.
    unequal = (points.join(seeds, study) if study else points.withColumn("one", F.lit(1)).join(F.broadcast(seeds.withColumn("one", F.lit(1))), "one")).filter(F.col("runs") != F.col("seeds"))
    xs = ranked.groupBy(*study, "panel", "rank").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n"))
    charts = ranked.groupBy(*study, "panel").agg(
        F.count_if(F.col("rank") == 1).alias("charts"), F.max("rank").alias("levels"))
    shape = charts.filter(~F.col("charts").between(2, 3) | ~F.col("levels").between(2, 5))
    misaligned = xs.join(charts, [*study, "panel"]).filter((F.col("lo") != F.col("hi")) | (F.col("n") != F.col("charts")))
    return union_all([
        _violations(ranked.filter(bad), "result_invariants", label),
        _violations(unequal, "result_invariants", label),
        _violations(shape, "result_invariants", place),
        _violations(misaligned, "result_invariants", place)])
