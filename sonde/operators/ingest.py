"""Recordings -> verified, immutable, per-run tables.

One job handles a whole inbox: decode, deduplicate, check, digest and classify every source
together, write the new runs, re-read and reconcile what was written, and only then append
manifest rows.  A run is visible through its manifest row, so a job that dies at any point
leaves nothing to clean up.  One writer per dataset.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonde import schemas
from sonde.functions.identity import flat_digest, tree_digest
from sonde.operators import decode, rules
from sonde.plans.ordered import BLOCK_ROWS, first_rows
from sonde.session import few_listing_tasks, scratch_dir
from sonde.sources import recordings, sinks, tables

# Names of the checks of a quality report
CHECKS = ("run_lifecycle", "global_sequence", "sensor_scan_sequence", "acquisition_time",
          "logical_event_identity", "measurement_count")
FINAL_CHECK = "clean_reconciliation"


def normalized_digest(unique: DataFrame) -> DataFrame:
    """(source, digest): identity of a recording's typed events, whatever their spelling."""
    return tree_digest(unique, ["source"], "stream_sequence", F.col("payload_sha256")).drop("leaves")


def source_counts(unique: DataFrame, keys: tuple[str, ...] = ("source",)) -> DataFrame:
    scan = F.col("event_type") == "MEASUREMENTS"
    return unique.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(scan).alias("scans"),
        F.coalesce(F.sum(F.when(scan, F.col("measurement_count"))), F.lit(0)).alias("measurements"))


def examine(decoded: DataFrame, unique: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One verdict row per source, from its decoded lines and its deduplicated events.

    A verdict has run_id, digest, counts, duplicates_removed, and `error`: the first violation
    by line, or null for a source that passed everything.
    """
    problems = rules.union_all([
        rules.grammar_violations(decoded), rules.lifecycle_violations(unique, block_rows),
        rules.conflicting_duplicates(unique)])
    line = F.coalesce(F.regexp_extract("detail", r"^line (\d+)", 1).try_cast("bigint"), F.lit((1 << 62)))
    errors = problems.groupBy("source").agg(
        F.min_by(F.concat_ws(": ", "rule", "detail"), F.struct(line.alias("line"), F.col("rule"))).alias("error"))
    facts = unique.groupBy("source").agg(
        F.min_by("run_id", "line_no").alias("run_id"), F.sum(F.col("copies") - 1).alias("duplicates_removed"))
    sources = decoded.select("source").distinct()
    counts = source_counts(unique)
    verdicts = sources.join(facts, "source", "left").join(counts, "source", "left").join(
        normalized_digest(unique), "source", "left").join(errors, "source", "left")
    nothing = F.when(F.col("run_id").isNull() & F.col("error").isNull(), "empty recording")
    return verdicts.withColumnRenamed("digest", "normalized_sha256").withColumn(
        "error", F.coalesce("error", nothing))


def run_conflicts(verdicts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sources that passed but reuse a run id with different events.

    Against published runs, and inside the batch, where the first source by name wins.
    """
    passed = verdicts.filter(F.col("error").isNull())
    winner = passed.groupBy("run_id").agg(F.min_by("normalized_sha256", "source").alias("winner"))
    stored = manifest.select("run_id", F.col("normalized_sha256").alias("stored"))
    return passed.join(winner, "run_id").join(stored, "run_id", "left").filter(
        F.col("normalized_sha256") != F.coalesce("stored", "winner")).select("source", "run_id")


def classify_imports(found: DataFrame, verdicts: DataFrame, archive: DataFrame, quality: DataFrame,
                     manifest: DataFrame) -> DataFrame:
    """One row per source with its status.

    unchanged  known bytes whose run is published      rejected  broken rules or a conflicting run
    imported   new bytes, new run                      recovered known bytes, run not yet published
    archived   new bytes that spell a published run, or repeat another source of this batch
    """
    conflict = run_conflicts(verdicts, manifest).select("source", F.lit(True).alias("conflict"))
    known = archive.select("recording_sha256", F.lit(True).alias("known")).distinct()
    saved = quality.filter(F.col("status") == "rejected").groupBy("recording_sha256").agg(
        F.min("error").alias("saved_error"))
    stored = manifest.select("run_id", F.lit(True).alias("published"))
    df = found.join(verdicts, "source", "left").join(conflict, "source", "left").join(
        known, "recording_sha256", "left").join(saved, "recording_sha256", "left").join(stored, "run_id", "left")
    clash = F.when(F.col("conflict"), F.concat(
        F.lit("run "), F.col("run_id").cast("string"), F.lit(" is published with other events; the recording needs its own run_id")))
    error = F.coalesce("saved_error", "error", clash)
    df = df.withColumn("error", F.coalesce(error, F.when(F.col("run_id").isNull(), "empty recording")))
    # Of several new spellings of one new run, the first source is the import, the rest are archived.
    lead = df.filter(F.col("error").isNull()).groupBy("run_id").agg(F.min("source").alias("lead"))
    status = (F.when(F.col("error").isNotNull(), "rejected")
              .when(F.col("known") & F.col("published"), "unchanged")
              .when(F.col("published"), "archived")
              .when(F.col("source") != F.col("lead"), "archived")
              .when(F.col("known"), "recovered").otherwise("imported"))
    return df.join(lead, "run_id", "left").withColumn("status", status)


def batch_totals(classified: DataFrame) -> DataFrame:
    s = F.col("status")
    return classified.agg(
        F.count_if(s.isin("imported", "recovered")).alias("new_runs"),
        F.count_if(s.isin("imported", "archived")).alias("new_recordings"),
        F.count_if(s == "unchanged").alias("unchanged"), F.count_if(s == "rejected").alias("rejected"))


# What verify_partitions reads of each table.
RECONCILED = {"events": ("run_id", "stream_sequence", "event_type", "measurement_count"),
              "scans": ("run_id", "stream_sequence", "measurement_count"), "measurements": ("run_id", "stream_sequence")}


def read_once(spark: SparkSession, stored: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The columns that are reconciled, in a few large files: the many of the runs are opened once, not for each rule."""
    return {name: _frozen(spark, df.select(*RECONCILED[name]), f"stored-{name}") for name, df in stored.items()}


def verify_partitions(manifest: DataFrame, stored: dict[str, DataFrame]) -> DataFrame:
    """Violations where stored tables differ from their manifest counts or from each other."""
    return rules.union_all([
        rules.reconcile_counts(manifest, rules.table_counts(stored)),
        rules.reconcile_event_scan(stored["events"], stored["scans"]),
        rules.reconcile_scan_measurements(stored["scans"], stored["measurements"])])


def stored_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256, bytes) of the Parquet files below `path`; files are hashed in parallel."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option(
        "recursiveFileLookup", "true").load(path)
    return files.select(
        F.regexp_extract("path", "/clean/(.*)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"),
        F.col("length").alias("bytes"))


def verify_files(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """(file, problem) of recorded files that are gone or no longer have their recorded bytes."""
    now = found.select("file", F.col("sha256").alias("now"))
    return recorded.join(now, "file", "left").filter(~F.col("sha256").eqNullSafe(F.col("now"))).select(
        "file", F.when(F.col("now").isNull(), "missing").otherwise("changed").alias("problem"))


def materialize_runs(spark: SparkSession, root: str, unique: DataFrame, chosen: DataFrame,
                     batch: str | None = None) -> DataFrame:
    """Write the chosen sources' runs, reconcile the stored files, append manifest rows.

    chosen: source, run_id, normalized_sha256, events, scans, measurements, duplicates_removed.
    Returns the violations; any violation keeps its run out of the manifest.
    """
    batch = batch or uuid.uuid4().hex
    rows = unique.join(chosen.select("source"), "source", "left_semi")
    parts = {"events": decode.event_rows(rows), "scans": decode.explode_scans(rows),
             "measurements": decode.explode_measurements(rows)}
    files = {name: sinks.write_clean(df, f"{root}/clean/{name}", batch) for name, df in parts.items()}
    written = {
        name: tables.read_table(spark, f"{root}/clean", name, _stored(schema)).filter(F.col("batch") == batch)
        for name, schema in schemas.CLEAN_TABLES.items()}
    bad = verify_partitions(chosen, read_once(spark, written)).select("run_id", "rule", "detail")
    path = scratch_dir(spark, "reconciliation")
    bad.write.parquet(path)
    bad = spark.read.schema(bad.schema).parquet(path)
    good = chosen.join(bad.select("run_id"), "run_id", "left_anti")
    if tables.path_exists(spark, f"{root}/clean/events") and not chosen.isEmpty():
        known = [df.withColumn("file", F.concat(F.lit(f"{name}/"), "file")) for name, df in files.items() if df is not None]
        stored = rules.union_all(known) if known else stored_files(spark, f"{root}/clean/*/*/batch={batch}")
        stored.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{root}/files")
    good.select(
        "run_id", F.lit(schemas.SCHEMA_VERSION).alias("schema_version"), F.lit(1).alias("recording_version"), "source",
        "normalized_sha256", "events", "scans", "measurements", "duplicates_removed", F.lit(batch).alias("batch"),
    ).write.mode("append").parquet(f"{root}/manifest")
    return bad


def _stored(schema):
    from pyspark.sql import types as T

    return T.StructType([*schema.fields, T.StructField("batch", T.StringType())])


@dataclass
class Imported:
    classified: DataFrame
    totals: dict[str, int]


def ingest(spark: SparkSession, path: str, root: str, pattern: str = "*.events",
           block_rows: int = BLOCK_ROWS) -> Imported:
    """Import a file, or a folder of recordings, into the dataset at `root`.

    Known bytes with a final report are neither decoded nor checked again.
    """
    few_listing_tasks(spark)
    archive = tables.read_table(spark, root, "archive", schemas.RAW_ARCHIVE)
    quality = tables.read_table(spark, root, "quality", schemas.QUALITY)
    manifest = tables.published(spark, root)
    # Snapshots of the state before this batch: later appends must not change what was decided.
    archive, quality, manifest = (_frozen(spark, df, n) for df, n in (
        (archive, "archive"), (quality, "quality"), (manifest, "manifest")))
    found = _frozen(spark, recordings.archive_raw(spark, path, pattern), "found")
    if found.isEmpty():
        return Imported(found, {"new_runs": 0, "new_recordings": 0, "unchanged": 0, "rejected": 0})
    last = first_rows(quality.filter(F.col("status").isin("passed", "rejected")), ["recording_sha256"], ["status"])
    settled = last.join(manifest.select(F.col("run_id").alias("published_run")), F.col("run_id") == F.col("published_run"), "left").filter(
        (F.col("status") == "rejected") | F.col("published_run").isNotNull())
    fresh = found.join(settled.select("recording_sha256"), "recording_sha256", "left_anti")
    lines = recordings.read_recordings(spark, path, pattern).withColumn(
        "source", plain_path(F.col("source"))).join(fresh.select(plain_path(F.col("source")).alias("source")), "source", "left_semi")
    # Text is parsed once and deduplicated once; the checks read the columns they need.
    decoded = _frozen(spark, decode.decode_events(lines), "decoded")
    unique = _frozen(spark, rules.dedup_events(decode.accepted(decoded)), "unique")
    verdicts = _frozen(spark, examine(decoded, unique, block_rows), "verdicts")
    found = found.withColumn("source", plain_path(F.col("source")))
    known_verdicts = found.join(settled.filter(F.col("status") == "passed").select(
        "recording_sha256", "run_id", "normalized_sha256", "duplicates_removed", F.col("source_events").alias("events"),
        F.col("source_scans").alias("scans"), F.col("source_measurements").alias("measurements")), "recording_sha256").select(
        "source", "run_id", "duplicates_removed", "events", "scans", "measurements", "normalized_sha256",
        F.lit(None).cast("string").alias("error"))
    classified = _frozen(spark, classify_imports(
        found, verdicts.unionByName(known_verdicts.select(*verdicts.columns)), archive, quality, manifest), "classified")
    new = classified.join(archive.select("recording_sha256"), "recording_sha256", "left_anti")
    first_rows(new.select("recording_sha256", "bytes", "source_name"), ["recording_sha256"], ["source_name"]).write.mode(
        "append").parquet(f"{root}/archive")
    chosen = classified.filter(F.col("status").isin("imported", "recovered")).select(
        "source", "run_id", "normalized_sha256", "events", "scans", "measurements", "duplicates_removed")
    failed = materialize_runs(spark, root, unique, chosen)
    quality_report(classified, failed).join(
        settled.select("recording_sha256"), "recording_sha256", "left_anti").write.mode("append").parquet(f"{root}/quality")
    return Imported(classified, batch_totals(classified).first().asDict())


def quality_report(classified: DataFrame, failed: DataFrame) -> DataFrame:
    """One row per source: status, stage reached, checks passed, counts and the error."""
    lost = failed.groupBy("run_id").agg(F.min(F.concat_ws(": ", "rule", "detail")).alias("lost"))
    df = classified.join(lost, "run_id", "left")
    rejected, error = F.col("status") == "rejected", F.col("lost").isNotNull()
    checks = F.when(rejected, F.lit("")).when(error, ",".join(CHECKS)).otherwise(",".join((*CHECKS, FINAL_CHECK)))
    clean = lambda c: F.when(~rejected & ~error, F.col(c))
    return df.select(
        "recording_sha256", "source", "run_id", "normalized_sha256",
        F.when(rejected, "rejected").when(error, "error").otherwise("passed").alias("status"),
        F.when(rejected, "validation").when(error, "publication").otherwise("complete").alias("stage"),
        checks.alias("checks_passed"), *(F.col(c).alias(f"source_{c}") for c in ("events", "scans", "measurements")),
        *(clean(c).alias(f"clean_{c}") for c in ("events", "scans", "measurements")), "duplicates_removed",
        F.coalesce("error", "lost").alias("error"))


def plain_path(column):
    """file:///a and file:/a name one file; both readers are brought to the latter."""
    return F.regexp_replace(column, "^([a-z0-9]+):/{2,}", "$1:/")


def _frozen(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stream_diff(recorded: DataFrame, replayed: DataFrame) -> DataFrame:
    """Typed events present in only one of two streams, with multiplicity."""
    columns = [c for c in decode.EVENT_COLUMNS] + ["measurements"]
    a, b = recorded.select(*columns), replayed.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("recorded")).unionByName(
        b.exceptAll(a).withColumn("side", F.lit("replayed")))


def analysis_violations(runs: DataFrame, sensors: DataFrame, ground_truth: DataFrame, frames: DataFrame,
                        events: DataFrame) -> DataFrame:
    """All checks of analytical artifacts against each other and the clean events."""
    inputs = (runs, sensors, ground_truth)
    own = events.join(runs.select("run_id"), "run_id", "left_semi")
    return rules.union_all([
        *(rules.analytical_identity(t, events) for t in inputs), *(rules.analytical_nulls(t) for t in inputs),
        *(rules.analytical_finite(t) for t in inputs), rules.metadata_row(runs), rules.metadata_absent(runs, sensors, ground_truth, frames),
        rules.sensor_metadata(runs, sensors, own), rules.frames_match_events(frames, own),
        rules.complete_generation(frames, runs), rules.truth_grid(runs, ground_truth)])


def publish_analysis(spark: SparkSession, root: str, runs: DataFrame, sensors: DataFrame, ground_truth: DataFrame,
                     frames: DataFrame, gate: float = 5.0) -> DataFrame:
    """Publish truth, tracks and metrics of clean runs; returns (run_id, status, error), one row for each run of the inputs.

    Each run is a transaction of its own: `created`, `unchanged` (the same artifacts are published), or `refused` with
    the first rule it breaks, or because other artifacts of it are published.  A refused run holds no other back.
    Rows become visible by their run's manifest row, written last.
    """
    from sonde.operators import evaluation, tracking

    clean = tables.open_dataset(spark, root)
    inputs = {"runs": runs, "sensors": sensors, "ground_truth": ground_truth, "frames": frames}
    first = F.min(F.struct("rule", F.coalesce("detail", F.lit("")).alias("detail"))).alias("first")
    faults = analysis_violations(runs, sensors, ground_truth, frames, clean["events"]).groupBy("run_id").agg(first).select(
        "run_id", F.rtrim(F.concat_ws(": ", "first.rule", "first.detail")).alias("fault"))
    source = tables.published(spark, root).select("run_id", F.col("normalized_sha256").alias("source_sha256"))
    before = _frozen(spark, tables.published(spark, root, "analysis_manifest", schemas.ANALYSIS_MANIFEST).select(
        "run_id", F.col("inputs_sha256").alias("stored")), "analysis-manifest")
    same = lambda df: [F.col("d.run_id").eqNullSafe(df["run_id"])]
    state = inputs_digest(inputs, gate).alias("d").join(faults, same(faults), "left").join(source, same(source), "left").join(before, same(before), "left")
    other, known = F.col("stored") != F.col("inputs_sha256"), F.col("stored").isNotNull()
    error = (F.when(F.col("fault").isNotNull(), F.col("fault")).when(F.col("source_sha256").isNull(), "no published clean run")
             .when(other, "other artifacts of this run are published; they cannot be replaced"))
    state = _frozen(spark, state.select("d.run_id", "inputs_sha256", "source_sha256", error.alias("error"), known.alias("known")), "analysis-state")
    fresh = state.filter(F.col("error").isNull() & ~F.col("known"))
    keep = lambda df: df.join(fresh.select("run_id"), "run_id", "left_semi")
    truth = evaluation.truth_at_scans(keep(frames), keep(ground_truth))
    metrics = evaluation.run_metrics(keep(frames), truth, gate, tracking.fusion_config(frames))
    batch = uuid.uuid4().hex
    sinks.write_analysis({
        "runs": keep(runs), "sensors": keep(sensors), "ground_truth": keep(ground_truth),
        "tracks": tracking.track_samples(keep(frames)), "run_metrics": metrics}, f"{root}/analysis", batch)
    fresh.select(
        "run_id", F.lit(schemas.SCHEMA_VERSION).alias("schema_version"), "source_sha256", "inputs_sha256",
        F.lit(batch).alias("batch")).write.mode("append").parquet(f"{root}/analysis_manifest")
    status = F.when(F.col("error").isNotNull(), "refused").when(F.col("known"), "unchanged").otherwise("created")
    return state.select("run_id", status.alias("status"), "error")


def inputs_digest(inputs: dict[str, DataFrame], gate: float) -> DataFrame:
    """(run_id, inputs_sha256): order-free digest of each run's artifact rows and the gate."""
    rows = rules.union_all([
        df.select("run_id", F.sha2(F.concat_ws("|", F.lit(name), F.to_json(F.struct(*sorted(
            c for c in df.columns if c not in ("source", "line_no"))))), 256).alias("row")) for name, df in inputs.items()])
    digest = flat_digest(rows, ["run_id"], "row")
    return digest.select("run_id", F.sha2(F.concat_ws("|", "digest", F.lit(repr(float(gate)))), 256).alias("inputs_sha256"))
