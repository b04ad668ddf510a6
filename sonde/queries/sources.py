"""Registered source, sink, decode and ingest queries.

Files are written from the given tables into the shared scratch folder and read back, so the
work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sonde import schemas
from sonde.operators import decode, ingest, rules, summaries
from sonde.queries.common import integers, rounded, with_ctes
from sonde.session import scratch_dir
from sonde.sources import adapters as A
from sonde.sources import archive, recordings, sinks, tables


def _lines(spark, d):
    return A.recording_text(A.recordings(spark, d))


def _decoded(spark, d):
    return decode.decode_events(_lines(spark, d))


def _event_columns(df):
    out = rounded(df, 4, "event_time_seconds").withColumn("run_id", F.col("run_id").cast("bigint"))
    return integers(out, "sensor_id")


def _inbox(spark, d):
    """One text file per recording, all in one folder."""
    path = scratch_dir(spark, "inbox")
    sinks.write_recordings(_lines(spark, d), path)
    return path


def decode_events(spark, d):
    return _event_columns(decode.event_rows(decode.accepted(_decoded(spark, d))))


def decode_rejects(spark, d):
    """The same lines damaged by line number: lost fields, bad numbers, unknown kinds, wrong counts."""
    n = F.col("line_no") % 10
    damaged = _lines(spark, d).withColumn("line", F.when(
        (n == 3) & F.col("line").startswith("MEASUREMENTS"), F.concat("line", F.lit(" 1"))).when(
        n == 5, F.regexp_replace("line", "^[A-Z]+_?[A-Z]*", "NOTHING")).when(
        n == 7, F.regexp_replace("line", r"^(\S+ )(\S+)", "$1-$2")).when(n == 9, F.lit("  ")).otherwise(F.col("line")))
    out = decode.rejects(decode.decode_events(damaged))
    return out.groupBy("source", "error").agg(F.count(F.lit(1)).alias("lines"))


def decode_messages(spark, d):
    messages = sinks.transport_messages(decode.recording_lines(A.recordings(spark, d)))
    seq = F.regexp_extract("value", r"\n\S+ \S+ \S+ (\d+)", 1).cast("bigint")
    messages = messages.withColumn("key", F.when(seq % 10 == 3, "0").otherwise(F.col("key"))).withColumn(
        "value", F.when(seq % 10 == 7, F.concat("value", F.lit("extra\n"))).otherwise(F.col("value")))
    out = decode.decode_messages(messages)
    return out.groupBy(F.coalesce("error", F.lit("")).alias("error")).agg(F.count(F.lit(1)).alias("messages"))


def explode_scans(spark, d):
    out = decode.explode_scans(decode.accepted(_decoded(spark, d)))
    return _event_columns(out.withColumnRenamed("acquisition_time_seconds", "event_time_seconds"))


def explode_measurements(spark, d):
    out = decode.explode_measurements(decode.accepted(_decoded(spark, d)))
    out = rounded(out.withColumnRenamed("acquisition_time_seconds", "event_time_seconds"), 3, "x", "y", "confidence", "uncertainty_radius")
    return integers(_event_columns(out), "detection_id")


def read_recordings(spark, d):
    lines = recordings.read_recordings(spark, _inbox(spark, d), "*.txt")
    run = F.regexp_extract("source", "name=([0-9]+)", 1).cast("bigint").alias("run_id")
    sequence = F.regexp_extract("line", r"^\S+ \S+ \S+ (\d+)", 1)
    return lines.groupBy(run).agg(
        F.count(F.lit(1)).alias("lines"), F.max("line_no").alias("last_line"),
        F.count_if((F.col("line_no") > 1) & (sequence.try_cast("bigint") == F.col("line_no") - 1)).alias("numbered"))


def read_inbox(spark, d):
    files = recordings.read_inbox(spark, _inbox(spark, d), "*.txt")
    return files.select(
        F.regexp_extract("source", "name=([0-9]+)", 1).cast("bigint").alias("run_id"), (F.col("bytes") > 0).alias("filled"))


def archive_raw(spark, d):
    """Each recording archived, twice, and restored: its bytes against the file's, and the chunks its second copy added."""
    inbox, store = _inbox(spark, d), scratch_dir(spark, "archive")
    recordings.archive_raw(spark, inbox, "*.txt").write.parquet(scratch_dir(spark, "archive-identity"))
    archive.archive_bytes(spark, inbox, store, "*.txt")
    chunks = spark.read.parquet(f"{store}/chunks").count()
    archive.archive_bytes(spark, inbox, store, "*.txt")
    added = spark.read.parquet(f"{store}/chunks").count() - chunks
    source = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(inbox).select(F.col("path").alias("source"), F.sha2("content", 256).alias("digest"))
    back = archive.contents(archive.restore(spark, store)).select("source", F.sha2("content", 256).alias("restored"))
    run = F.regexp_extract("source", "name=([0-9]+)", 1).cast("bigint").alias("run_id")
    return source.join(back, "source", "left").groupBy(run).agg(
        F.count(F.lit(1)).alias("copies"), F.bool_and(F.col("digest").eqNullSafe(F.col("restored"))).alias("same_bytes")).withColumn("added", F.lit(added).cast("bigint"))


def ingest_recordings(spark, d):
    """Whole ingest of the recordings, then the published tables counted through the views."""
    root = scratch_dir(spark, "dataset")
    ingest.ingest(spark, _inbox(spark, d), root, "*.txt")
    tables.open_dataset(spark, root)
    return spark.sql("""
        SELECT CAST(run_id AS BIGINT) AS run_id, count(*) AS events, count_if(event_type = 'MEASUREMENTS') AS scans,
          sum(coalesce(measurement_count, 0)) AS measurements FROM events GROUP BY run_id""")


def quality_report(spark, d):
    root = scratch_dir(spark, "dataset")
    ingest.ingest(spark, _inbox(spark, d), root, "*.txt")
    report = tables.read_table(spark, root, "quality", schemas.QUALITY)
    return report.select(F.col("run_id").cast("bigint"), "status", "stage", "source_events", "clean_measurements", "duplicates_removed")


def source_counts(spark, d):
    return ingest.source_counts(A.recordings(spark, d), ("run_id",))


def normalized_digest(spark, d):
    """Spelling variants of one recording share their digest: two spellings, one identity per run."""
    lines = _lines(spark, d)
    variant = lines.withColumn("source", F.concat("source", F.lit("b"))).withColumn(
        "line", F.regexp_replace("line", " 0\\.8 ", " 0.80 "))
    unique = rules.dedup_events(decode.accepted(decode.decode_events(lines.unionByName(variant))))
    run = F.regexp_replace("source", "b", "").cast("bigint").alias("run_id")
    return ingest.normalized_digest(unique).groupBy(run).agg(
        F.count(F.lit(1)).alias("sources"), F.countDistinct("digest").alias("digests"))


def classify_imports(spark, d):
    """Customers as import sources: known, published, rejected and clashing by their columns."""
    who = A.table(spark, d, "customer").select(
        F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("source"), F.col("c_custkey").alias("k"),
        F.col("c_nationkey").alias("n"), F.expr("c_custkey div 2").cast("decimal(20,0)").alias("run_id"))
    found = who.select("source", F.concat(F.lit("sha"), "source").alias("recording_sha256"))
    verdicts = who.select(
        "source", "run_id", F.concat(F.lit("d"), F.col("n") % 2).alias("normalized_sha256"),
        F.when(F.col("n") == 7, "broken").alias("error"))
    archive = who.filter(F.col("k") % 3 == 0).select(F.concat(F.lit("sha"), "source").alias("recording_sha256"))
    quality = who.filter(F.col("n") == 9).select(
        F.concat(F.lit("sha"), "source").alias("recording_sha256"), F.lit("rejected").alias("status"), F.lit("saved").alias("error"))
    manifest = who.filter(F.col("k") % 5 == 0).select("run_id", F.lit("d0").alias("normalized_sha256")).distinct()
    out = ingest.classify_imports(found, verdicts, archive, quality, manifest)
    return out.select("source", "status", F.coalesce(F.col("error").substr(1, 6), F.lit("")).alias("error"))


def run_conflicts(spark, d):
    orders = A.table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("source"), F.col("o_custkey").cast("decimal(20,0)").alias("run_id"),
        F.col("o_orderstatus").alias("normalized_sha256"), F.lit(None).cast("string").alias("error"))
    manifest = A.table(spark, d, "customer").filter("c_nationkey < 5").select(
        F.col("c_custkey").cast("decimal(20,0)").alias("run_id"), F.lit("F").alias("normalized_sha256"))
    return ingest.run_conflicts(orders, manifest).select("source", F.col("run_id").cast("bigint"))


def stream_diff(spark, d):
    recorded = A.recordings(spark, d)
    replayed = recorded.filter(F.col("stream_sequence") % 50 != 9).withColumn(
        "event_time_seconds", F.when(F.col("stream_sequence") % 40 == 8, F.col("event_time_seconds") + 1).otherwise(
            F.col("event_time_seconds")).cast("float"))
    return ingest.stream_diff(recorded, replayed).groupBy("run_id", "side").agg(F.count(F.lit(1)).alias("events"))


def write_clean(spark, d):
    path = scratch_dir(spark, "clean")
    sinks.write_clean(A.scans(spark, d), path, "b1")
    stored = spark.read.parquet(path)
    return stored.groupBy(F.col("run_id").cast("bigint")).agg(
        F.count(F.lit(1)).alias("scans"), F.sum("measurement_count").alias("detections"))


def read_traces(spark, d):
    path = scratch_dir(spark, "traces")
    produced, consumed = A.traces(spark, d)
    marks = produced.unionByName(consumed).select("experiment_id", "arrival", *schemas.TRACE.fieldNames())
    marks.repartition("experiment_id").sortWithinPartitions("experiment_id", "phase", "arrival").drop("arrival").write.option(
        "header", True).partitionBy("experiment_id").csv(path)
    back = tables.read_traces(spark, path)
    run = F.regexp_extract("source", "experiment_id=([0-9]+)", 1).cast("bigint").alias("experiment_id")
    return back.groupBy(run, "phase").agg(
        F.count(F.lit(1)).alias("marks"), F.sum("sequence").alias("sequences"), F.min("wall_ns").alias("first_ns"))


def read_track_frames(spark, d):
    path = scratch_dir(spark, "frames")
    sinks.write_frames(A.frames(spark, d), path)
    back = tables.read_track_frames(spark, path)
    return back.select(
        F.col("run_id").cast("bigint"), "source_sequence", F.size("tracks").cast("bigint").alias("tracks"),
        F.size("associations").cast("bigint").alias("associations"), F.size("retired").cast("bigint").alias("retired"))


def read_truth_frames(spark, d):
    path = scratch_dir(spark, "truth")
    A.truth(spark, d).write.json(path)
    return tables.read_truth_frames(spark, path).select(
        F.col("run_id").cast("bigint"), "source_sequence", F.size("entities").cast("bigint").alias("targets"))


def read_analytical_csv(spark, d):
    path = scratch_dir(spark, "csv")
    runs, _ = A.experiments(spark, d)
    runs.select(*schemas.RUNS.fieldNames()).write.option("header", True).csv(path)
    back = tables.read_analytical_csv(spark, "runs", path)
    return back.select(F.col("run_id").cast("bigint"), "scenario_seed", "noise", "reliability", "generator_version")


def read_experiment_summaries(spark, d):
    path = scratch_dir(spark, "summaries")
    per_user = A.table(spark, d, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("event_type") == "error", 1)).alias("bad"), F.max("value").alias("top"))
    per_user.select(
        F.struct(F.concat(F.lit("u"), "user_id").alias("name")).alias("config"), F.lit("local").alias("transport"), F.struct(
            F.col("n").alias("total_produced"), F.col("bad").alias("duplicate_count"), F.when(F.col("top") > 200, F.col("top")).alias(
                "latency_p99_ms")).alias("metrics"), (F.col("user_id") % 8).alias("folder")).write.partitionBy("folder").json(path)
    from sonde.operators.transport import transport_comparison

    # Spark writes JSON Lines, several documents per file; the reader takes one or many per file.
    back = spark.read.schema(schemas.EXPERIMENT_SUMMARY).json(f"{path}/*/*.json")
    return transport_comparison(back).select("scenario", "transport", "produced", "consumed", "p99_ms", "duplicates", "integrity_pass")


def read_layout(spark, d):
    """Customers as sensor geometry lines with comments, blanks, bad ranges and repeated sensors."""
    who = A.table(spark, d, "customer")
    bad = F.when(F.col("c_nationkey") == 3, "-1").otherwise("150")
    text = F.concat_ws(" ", F.lit("0"), F.expr("c_custkey div 2").cast("string"), F.lit("0 0 0 360"), bad)
    line = F.when(F.col("c_nationkey") == 5, "# comment").when(F.col("c_nationkey") == 6, "  ").otherwise(text)
    lines = who.select(F.col("c_mktsegment").alias("source"), (F.col("c_custkey") + 2).alias("line_no"), line.alias("line"))
    good, rejected = tables.parse_layout(lines)
    counted = lambda df, label: df.groupBy("source").agg(F.count(F.lit(1)).alias(label))
    return counted(good, "sensors").join(counted(rejected, "rejected"), "source", "full").na.fill(0)


def union_sweeps(spark, d):
    from sonde.operators import experiments as N

    individual = N.individual_runs(*A.experiments(spark, d))
    path = scratch_dir(spark, "sweeps")
    individual.withColumn("part", F.col("seed") % 3).write.partitionBy("part").parquet(path)
    return tables.union_sweeps(spark, [f"{path}/part={n}" for n in range(3)]).select("experiment_id", "run_id", "seed")


def write_canonical(spark, d):
    from sonde.operators import experiments as N

    individual = N.individual_runs(*A.experiments(spark, d))
    path = scratch_dir(spark, "canonical")
    sinks.write_canonical(individual, N.canonical_statistics(N.condition_statistics(individual)), N.metric_definitions(spark), path)
    return spark.read.parquet(f"{path}/statistics").groupBy("analysis").agg(
        F.count(F.lit(1)).alias("statistics"), F.sum("run_count").alias("runs"))


def write_csv_result(spark, d):
    path = scratch_dir(spark, "result")
    sinks.write_csv_result(summaries.sensing_totals(A.scans(spark, d)), path)
    return spark.read.option("header", True).schema(
        "run_id bigint, scan_count bigint, measurement_count bigint, empty_scan_count bigint").csv(path)


def run_query(spark, d):
    """User SQL with a bound parameter over registered views."""
    return tables.run_query(
        spark, """SELECT run_id, run_generation, sensor_id AS sensor, count(*) AS scans FROM scans
        WHERE measurement_count >= :least GROUP BY ALL HAVING count(*) > 1;""", {"least": 3}, {"scans": A.scans(spark, d).withColumn(
            "sensor_id", F.col("sensor_id").cast("bigint"))})


QUERIES = {f.__name__: f for f in (
    decode_events, decode_rejects, decode_messages, explode_scans, explode_measurements, read_recordings, read_inbox,
    archive_raw, ingest_recordings, quality_report, source_counts, normalized_digest, classify_imports, run_conflicts,
    stream_diff, write_clean, read_traces, read_track_frames, read_truth_frames, read_analytical_csv,
    read_experiment_summaries, read_layout, union_sweeps, write_canonical, write_csv_result, run_query)}

RECORDED = """raw AS (SELECT event_id // 200 + 1 AS run_id, event_id % 200 AS i, value,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
recorded AS (
  SELECT run_id, i + 6 AS stream_sequence, 'MEASUREMENTS' AS event_type, i / 8 + i // 50 * 3 AS t, i % 4 + 1 AS sensor_id,
    i // 4 + 1 AS scan_sequence, CASE WHEN i % 4 = 3 THEN 0 ELSE 2 END AS n, CAST(NULL AS BIGINT) AS seed, value, k FROM raw
  UNION ALL SELECT run_id, 1, 'RUN_STARTED', 0, NULL, NULL, NULL, NULL, NULL, NULL FROM raw WHERE i = 0
  UNION ALL SELECT run_id, s + 1, 'SENSOR_STARTED', 0, s, NULL, NULL, s * 7, NULL, NULL FROM raw, range(1, 5) AS r(s) WHERE i = 0
  UNION ALL SELECT run_id, i + 7, 'RUN_FINISHED', i / 8 + i // 50 * 3, NULL, NULL, NULL, NULL, NULL, NULL FROM raw WHERE i = 199)"""
_COUNTS = """SELECT run_id, count(*) AS events, count(*) FILTER (WHERE event_type = 'MEASUREMENTS') AS scans,
      CAST(coalesce(sum(n), 0) AS BIGINT) AS measurements FROM recorded"""
ORACLES = {
    "decode_events": f"""WITH {RECORDED}
    SELECT run_id, CAST(0 AS BIGINT) AS run_generation, stream_sequence, round(t::DOUBLE, 4) AS event_time_seconds, event_type,
      sensor_id, CASE WHEN sensor_id IS NOT NULL THEN CAST(0 AS BIGINT) END AS sensor_generation, scan_sequence,
      CAST(n AS BIGINT) AS measurement_count, seed FROM recorded""",
    "decode_rejects": f"""WITH {RECORDED}, numbered AS (SELECT run_id, stream_sequence + 1 AS line_no, event_type FROM recorded),
    judged AS (SELECT CAST(run_id AS VARCHAR) AS source, CASE
      WHEN line_no % 10 = 3 AND event_type = 'MEASUREMENTS' THEN 'measurement count does not match tuples'
      WHEN line_no % 10 = 5 THEN 'unknown event type' WHEN line_no % 10 = 7 THEN 'invalid integer'
      WHEN line_no % 10 = 9 THEN 'empty event line' END AS error FROM numbered)
    SELECT source, error, count(*) AS lines FROM judged WHERE error IS NOT NULL GROUP BY ALL""",
    "decode_messages": f"""WITH {RECORDED}
    SELECT CASE stream_sequence % 10 WHEN 3 THEN 'message key/run identity mismatch'
      WHEN 7 THEN 'more than one event in a transport message' ELSE '' END AS error, count(*) AS messages FROM recorded GROUP BY 1""",
    "explode_scans": f"""WITH {RECORDED}
    SELECT run_id, CAST(0 AS BIGINT) AS run_generation, stream_sequence, round(t::DOUBLE, 4) AS event_time_seconds, sensor_id,
      CAST(0 AS BIGINT) AS sensor_generation, scan_sequence, CAST(n AS BIGINT) AS measurement_count
    FROM recorded WHERE event_type = 'MEASUREMENTS'""",
    "explode_measurements": f"""WITH {RECORDED}
    SELECT run_id, CAST(0 AS BIGINT) AS run_generation, stream_sequence, round(t::DOUBLE, 4) AS event_time_seconds, sensor_id,
      CAST(0 AS BIGINT) AS sensor_generation, scan_sequence, (scan_sequence - 1) * 2 + m AS detection_id,
      round(CAST(value + (m - 1) * 120 AS FLOAT)::DOUBLE, 3) AS x, round(CAST(k + (m - 1) * 120 AS FLOAT)::DOUBLE, 3) AS y,
      0.8::DOUBLE AS confidence, 2.0::DOUBLE AS uncertainty_radius
    FROM recorded, range(1, 3) AS d(m) WHERE n = 2""",
    "read_recordings": f"""WITH {RECORDED}
    SELECT run_id, count(*) + 1 AS lines, count(*) + 1 AS last_line, count(*) AS numbered FROM recorded GROUP BY run_id""",
    "read_inbox": f"WITH {RECORDED} SELECT DISTINCT run_id, true AS filled FROM raw",
    "archive_raw": f"WITH {RECORDED} SELECT DISTINCT run_id, CAST(2 AS BIGINT) AS copies, true AS same_bytes, CAST(0 AS BIGINT) AS added FROM raw",
    "ingest_recordings": f"""WITH {RECORDED} {_COUNTS} GROUP BY run_id HAVING count(*) = 206""",
    "quality_report": f"""WITH {RECORDED} SELECT run_id, 'passed' AS status, 'complete' AS stage, count(*) AS source_events,
      CAST(sum(n) AS BIGINT) AS clean_measurements, CAST(0 AS BIGINT) AS duplicates_removed FROM recorded GROUP BY run_id
      HAVING count(*) = 206""",
    "source_counts": f"WITH {RECORDED} {_COUNTS} GROUP BY run_id",
    "normalized_digest": f"""WITH {RECORDED}
    SELECT DISTINCT run_id, CAST(2 AS BIGINT) AS sources, CAST(1 AS BIGINT) AS digests FROM raw""",
    "classify_imports": """WITH who AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS source, c_custkey AS k, c_nationkey AS n,
      c_custkey // 2 AS run_id, 'd' || (c_nationkey % 2) AS digest FROM customer),
    manifest AS (SELECT DISTINCT run_id, 'd0' AS stored FROM who WHERE k % 5 = 0),
    winner AS (SELECT run_id, arg_min(digest, source) AS winner FROM who WHERE n <> 7 GROUP BY run_id),
    judged AS (SELECT w.*, stored, CASE WHEN n = 9 THEN 'saved' WHEN n = 7 THEN 'broken'
      WHEN digest <> coalesce(stored, winner) THEN 'run ' || substr(CAST(run_id AS VARCHAR) || ' al', 1, 2) END AS error
      FROM who w LEFT JOIN manifest USING (run_id) LEFT JOIN winner USING (run_id)),
    leads AS (SELECT run_id, min(source) AS lead FROM judged WHERE error IS NULL GROUP BY run_id)
    SELECT source, CASE WHEN error IS NOT NULL THEN 'rejected' WHEN k % 3 = 0 AND stored IS NOT NULL THEN 'unchanged'
      WHEN stored IS NOT NULL THEN 'archived' WHEN source <> lead THEN 'archived' WHEN k % 3 = 0 THEN 'recovered'
      ELSE 'imported' END AS status, coalesce(error, '') AS error FROM judged LEFT JOIN leads USING (run_id)""",
    "run_conflicts": """WITH winner AS (SELECT o_custkey, arg_min(o_orderstatus, CAST(o_orderkey AS VARCHAR)) AS w FROM orders GROUP BY 1),
    stored AS (SELECT c_custkey, 'F' AS s FROM customer WHERE c_nationkey < 5)
    SELECT CAST(o_orderkey AS VARCHAR) AS source, o_custkey AS run_id FROM orders JOIN winner USING (o_custkey)
    LEFT JOIN stored ON c_custkey = o_custkey WHERE o_orderstatus <> coalesce(s, w)""",
    "stream_diff": f"""WITH {RECORDED}, marked AS (SELECT run_id, stream_sequence % 50 = 9 AS lost, stream_sequence % 40 = 8 AS late
      FROM recorded)
    SELECT run_id, 'recorded' AS side, count(*) AS events FROM marked WHERE lost OR late GROUP BY run_id
    UNION ALL SELECT run_id, 'replayed', count(*) FROM marked WHERE late AND NOT lost GROUP BY run_id""",
    "write_clean": with_ctes("scans", """
    SELECT run_id, count(*) AS scans, CAST(sum(measurement_count) AS BIGINT) AS detections FROM scans GROUP BY run_id"""),
    "read_track_frames": """WITH f AS (SELECT event_id // 1024 + 1 AS run_id, event_id % 1024 // 32 + 1 AS source_sequence, event_type
      FROM events)
    SELECT run_id, source_sequence, count(*) FILTER (WHERE event_type IN ('view', 'click', 'error')) AS tracks,
      count(*) FILTER (WHERE event_type = 'view') AS associations, count(*) FILTER (WHERE event_type = 'purchase') AS retired
    FROM f GROUP BY ALL""",
    "read_truth_frames": """SELECT event_id // 1024 + 1 AS run_id, event_id % 1024 // 32 + 1 AS source_sequence, count(*) AS targets
    FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY ALL""",
    "read_analytical_csv": """SELECT c_custkey + 1 AS run_id, c_custkey AS scenario_seed, CAST(c_nationkey % 3 AS DOUBLE) AS noise,
      0.5::DOUBLE + (c_nationkey % 2) / 4 AS reliability, 'procedural-v1' AS generator_version FROM customer""",
    "read_experiment_summaries": """SELECT 'u' || user_id AS scenario, 'local' AS transport, count(*) AS produced,
      CAST(NULL AS BIGINT) AS consumed, CASE WHEN max(value) > 200 THEN round(max(value), 2) END AS p99_ms,
      CAST(nullif(count(*) FILTER (WHERE event_type = 'error'), 0) AS BIGINT) AS duplicates, CAST(NULL AS BOOLEAN) AS integrity_pass
    FROM events GROUP BY user_id""",
    "read_layout": """WITH l AS (SELECT c_mktsegment AS source, c_custkey // 2 AS id, c_nationkey AS n, c_custkey AS k FROM customer
      WHERE c_nationkey NOT IN (5, 6)), v AS (SELECT *, n <> 3 AND row_number() OVER (PARTITION BY source, id, n <> 3 ORDER BY k) = 1
      AS good FROM l)
    SELECT source, count(*) FILTER (WHERE good) AS sensors, count(*) FILTER (WHERE NOT good) AS rejected FROM v GROUP BY source""",
    "union_sweeps": """SELECT c_mktsegment || '-' || (c_custkey // 4096) AS experiment_id, c_custkey + 1 AS run_id, c_custkey AS seed
    FROM customer""",
    "write_csv_result": with_ctes("scans", """
    SELECT run_id, count(*) AS scan_count, CAST(sum(measurement_count) AS BIGINT) AS measurement_count,
      count(*) FILTER (WHERE measurement_count = 0) AS empty_scan_count FROM scans GROUP BY run_id"""),
    "run_query": with_ctes("scans", """
    SELECT run_id, run_generation, sensor_id AS sensor, count(*) AS scans FROM scans WHERE measurement_count >= 3
    GROUP BY ALL HAVING count(*) > 1"""),
}
from sonde.queries.experiments import MAP, RUNS  # noqa: E402
from sonde.queries.transport import TRACES  # noqa: E402

ORACLES["write_canonical"] = f"""WITH {RUNS}, {MAP}
    SELECT analysis, count(*) AS statistics, CAST(sum(run_count) AS BIGINT) AS runs FROM stats JOIN analyses USING (metric)
    GROUP BY analysis"""
ORACLES["read_traces"] = f"""WITH {TRACES}, marks_read AS (SELECT experiment_id, phase, sequence, wall_ns FROM produced
      UNION ALL SELECT experiment_id, phase, sequence, wall_ns FROM consumed)
    SELECT experiment_id, phase, count(*) AS marks, CAST(sum(sequence) AS BIGINT) AS sequences, min(wall_ns) AS first_ns
    FROM marks_read GROUP BY ALL"""
