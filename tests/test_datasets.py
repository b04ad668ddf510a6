import os

import pytest
from pyspark.sql import functions as F
from recordings import HEADER, Script, collected, events_of, harbour, lines_of, rule_names, with_frame_lines

from sonde import schemas
from sonde.operators import ingest, rules, tracking
from sonde.operators.summaries import analysis_summary
from sonde.sources import sinks, tables


def procedural(run_id=9, seconds=2):
    """A complete one-generation run of three sensors on the 8 Hz grid."""
    s = Script(run_id, (1, 2, 3))
    for tick in range(seconds * 8 + 1):
        for sensor in (1, 2, 3):
            if tick % sensor == 0 and tick != 5:
                s.scan(tick / 8, sensor, [(tick / 4, 5), (100 - tick / 4, 50)])
    return s.finish(seconds)


def artifacts(spark, run_id=9, seconds=2):
    dec = lambda df: df.withColumn("run_id", F.col("run_id").cast("decimal(20,0)"))
    names = lambda s: [f.name for f in s.fields]
    runs = dec(spark.createDataFrame(
        [(run_id, "procedural-v1", 7, 73, seconds, 2, 3, 8, 14., 16., *[1.] * 8)], names(schemas.RUNS))).select(
        *(F.col(f.name).cast(f.dataType) for f in schemas.RUNS.fields))
    sensors = dec(spark.createDataFrame(
        [(run_id, i, i + 6, 0., 0., 0., 6.28, 200., 8. / i, 1., 1., 1.) for i in (1, 2, 3)], names(schemas.SENSORS))).select(
        *(F.col(f.name).cast(f.dataType) for f in schemas.SENSORS.fields))
    truth = dec(spark.createDataFrame(
        [(run_id, i, t / 8, (t / 4 if i == 1 else 100 - t / 4), (5. if i == 1 else 50.), 2., 0., "linear")
         for t in range(seconds * 8 + 1) for i in (1, 2)], names(schemas.GROUND_TRUTH))).select(
        *(F.col(f.name).cast(f.dataType) for f in schemas.GROUND_TRUTH.fields))
    return runs, sensors, truth


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("data")
    (base / "in").mkdir()
    (base / "in" / "a.events").write_text(procedural())
    root = str(base / "root")
    assert ingest.ingest(spark, str(base / "in"), root).totals["new_runs"] == 1
    path = str(base / "frames")
    sinks.write_frames(tracking.fuse_tracks(events_of(spark, procedural()), split=False), path)
    return root, tables.read_track_frames(spark, path).drop("source", "line_no")


def test_publish_query_and_refuse(spark, published):
    root, frames = published
    runs, sensors, truth = artifacts(spark)
    broken = truth.filter("not (target_id = 2 and timestamp = 2)")
    publish = lambda *a, **k: [(int(r.run_id), r.status, (r.error or "").split(":")[0]) for r in ingest.publish_analysis(spark, root, *a, **k).collect()]
    assert publish(runs, sensors, broken, frames) == [(9, "refused", "truth_grid")]
    assert publish(runs.limit(0), sensors, truth, frames)[0][1] == "refused"
    assert "metadata_row" in rule_names(ingest.analysis_violations(runs.limit(0), sensors, truth, frames, tables.open_dataset(spark, root)["events"]))
    with pytest.raises(ValueError, match="no analytical"):
        tables.open_analysis(spark, root)
    assert publish(runs, sensors, truth, frames) == [(9, "created", "")]
    assert publish(runs, sensors, truth, frames) == [(9, "unchanged", "")]
    refused = [(9, "refused", "other artifacts of this run are published; they cannot be replaced")]
    assert publish(runs, sensors, truth.withColumn("vx", F.col("vx") + 1), frames) == refused
    assert publish(runs, sensors, truth, frames, gate=6) == refused
    views = tables.open_analysis(spark, root)
    row = analysis_summary(views["runs"], views["run_metrics"]).first()
    # 17 ticks, one without scans; two targets.
    assert (row["evaluated_frames"], row["target_samples"]) == (16, 32)
    assert row["matched_samples"] + row["missed_target_samples"] == 32 and row["position_rmse"] < 1
    assert views["ground_truth"].count() == 34
    assert rules.analysis_relations(views["scans"], views["sensors"], views["tracks"], views["events"], views["run_metrics"]).count() == 0
    out = tables.run_query(spark, "SELECT count(*) AS n FROM tracks JOIN runs USING (run_id) WHERE state = :s", {"s": "confirmed"})
    assert out.first()["n"] > 0
    tables.open_tracks(frames)
    assert spark.sql("SELECT count(DISTINCT track_id) FROM track_samples").first()[0] == 2


def test_a_broken_run_holds_no_other_back(spark, tmp_path):
    """Three runs, one with damaged truth: two are published; mended, the third follows and the others stay as they are."""
    (tmp_path / "in").mkdir()
    for run in (9, 10, 11):
        (tmp_path / "in" / f"{run}.events").write_text(procedural(run))
    root = str(tmp_path / "root")
    assert ingest.ingest(spark, str(tmp_path / "in"), root).totals["new_runs"] == 3
    sinks.write_frames(tracking.fuse_tracks(events_of(spark, *(procedural(n) for n in (9, 10, 11))), split=False), str(tmp_path / "frames"))
    frames = tables.read_track_frames(spark, str(tmp_path / "frames")).drop("source", "line_no")
    three = [artifacts(spark, n) for n in (9, 10, 11)]
    runs, sensors, truth = (a.unionAll(b).unionAll(c) for a, b, c in zip(*three))
    damaged = truth.withColumn("x", F.when((F.col("run_id") == 10) & (F.col("timestamp") == 1), F.lit(float("nan"))).otherwise(F.col("x")))
    publish = lambda t: {int(r.run_id): (r.status, (r.error or "").split(":")[0]) for r in ingest.publish_analysis(spark, root, runs, sensors, t, frames).collect()}
    assert publish(damaged) == {9: ("created", ""), 10: ("refused", "analytical_finite"), 11: ("created", "")}
    views = tables.open_analysis(spark, root)
    assert {int(r.run_id) for r in views["run_metrics"].select("run_id").collect()} == {9, 11}
    assert publish(truth) == {9: ("unchanged", ""), 10: ("created", ""), 11: ("unchanged", "")}
    assert tables.open_analysis(spark, root)["run_metrics"].count() == 3


def test_artifact_rules_name_the_damage(spark, published):
    root, frames = published
    runs, sensors, truth = artifacts(spark)
    events = tables.open_dataset(spark, root)["events"]
    names = lambda *a: rule_names(ingest.analysis_violations(*a))
    assert names(runs, sensors, truth, frames, events) == set()
    assert names(runs.withColumn("tick_hz", F.lit(9)), sensors, truth, frames, events) >= {"metadata_row"}
    assert names(runs.union(runs), sensors, truth, frames, events) >= {"metadata_row"}
    assert names(runs, sensors.withColumn("seed", F.lit(1).cast("bigint")), truth, frames, events) == {"sensor_metadata"}
    assert names(runs, sensors.filter("sensor_id < 3"), truth, frames, events) == {"sensor_metadata"}
    assert names(runs, sensors, truth, frames.filter("source_sequence <> 5"), events) == {"frames_match_events"}
    assert names(runs, sensors, truth.withColumn("x", F.lit(float("nan"))), frames, events) == {"analytical_finite"}
    assert names(runs, sensors, truth.withColumn("motion_type", F.lit(None).cast("string")), frames, events) == {"analytical_nulls"}
    other = truth.withColumn("run_id", F.lit(77).cast("decimal(20,0)"))
    assert names(runs, sensors, other, frames, events) == {"analytical_identity", "metadata_row", "truth_grid"}    # run 77 has no metadata row
    assert names(runs.withColumn("duration_seconds", F.lit(3)), sensors, truth, frames, events) == {"complete_generation", "truth_grid"}


def test_frame_rules(spark, published):
    _, frames = published
    frames = with_frame_lines(frames)
    names = lambda df: rule_names(rules.track_frame_rules(df, block_rows=4))
    seq = F.col("source_sequence")
    assert names(frames) == set()
    assert names(frames.filter(seq > 1)) >= {"frame_start", "frame_order"}
    assert names(frames.filter(seq < 9)) == {"frame_finish"}
    assert names(frames.union(frames.filter(seq == 4).withColumn("line_no", F.lit(4.5).cast("bigint")))) >= {"frame_order"}
    assert names(frames.withColumn("acquisition_time", F.when(seq == 9, -1.0).otherwise(F.col("acquisition_time")))) == {"frame_generation_time"}
    assert names(frames.withColumn("tracks", F.concat("tracks", "tracks"))) == {"track_identity"}
    bad = F.transform("tracks", lambda t: t.withField("x", F.lit(float("inf"))))
    assert names(frames.withColumn("tracks", bad)) == {"track_values"}


def test_csv_keeps_unsigned_ids_and_fails_on_bad_values(spark, tmp_path):
    header = ",".join(schemas.RUNS.fieldNames())
    row = "18446744073709551615,procedural-v1,7,73,2,2,3,8,14,16,1,1,1,1,1,1,1,1"
    (tmp_path / "runs.csv").write_text(f"{header}\n{row}\n")
    assert int(tables.read_analytical_csv(spark, "runs", str(tmp_path / "runs.csv")).first()["run_id"]) == 2**64 - 1
    (tmp_path / "bad.csv").write_text(f"{header}\n{row.replace('73', 'x')}\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|cannot"):
        tables.read_analytical_csv(spark, "runs", str(tmp_path / "bad.csv")).collect()


def test_layout(spark):
    good, bad = tables.parse_layout(lines_of(spark, "\n".join([
        "SENSOR_LAYOUT 1", "# comment", "", "0 1 0 0 0 360 200", "0 2 50 20 0 360 150", "0 2 1 1 0 90 5", "0 3 0 0 0 361 5",
        "0 4 0 0 0 360 0", "-1 5 0 0 0 360 5", "0 6 0 0 0 360", "0 7 0 0 0 360 5 9", "1 1 nan 0 0 360 5", "1 2 -3.5 +4 -90 45 1e3"])))
    assert collected(good.select("generation", "sensor_id", "range"), "generation", "sensor_id") == [
        (0, 1, 200.0), (0, 2, 150.0), (1, 2, 1000.0)]
    assert bad.count() == 7 and bad.filter("error like 'duplicate%'").count() == 1
    _, wrong = tables.parse_layout(lines_of(spark, "SENSOR_LAYOUT 2\n0 1 0 0 0 360 200"))
    assert wrong.filter("error like 'missing%'").count() == 1


def test_clean_files_of_one_big_run_are_split_and_ordered(spark, tmp_path):
    df = spark.range(5000).select(F.lit(1).alias("run_id"), (5000 - F.col("id")).alias("stream_sequence"), F.col("id").alias("v"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_clean(df, str(tmp_path / "t"), "b")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    files = [f for _, _, names in os.walk(tmp_path / "t") for f in names if f.endswith(".zstd.parquet")]
    assert len(files) == 2
    back = spark.read.parquet(str(tmp_path / "t"))
    spans = back.groupBy(F.input_file_name()).agg(F.min("stream_sequence").alias("a"), F.max("stream_sequence").alias("b")).orderBy("a").collect()
    assert spans[0]["b"] < spans[1]["a"] and back.count() == 5000


def test_header_only_and_user_sql(spark):
    events = events_of(spark, harbour())
    assert tables.run_query(spark, "SELECT count(*) FROM e WHERE sensor_id = ?", [4], {"e": events}).first()[0] == 5
    from sonde.operators.decode import decode_events

    assert decode_events(lines_of(spark, HEADER)).count() == 0


def test_starts_are_made_in_many_tasks(spark):
    """The customer file is one small split; its starts, seven for each, do not stand in one task."""
    from sonde.sources import adapters

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    starts = adapters.started(spark, "/root/testdata/sf0.001")
    assert starts.select(F.spark_partition_id()).distinct().count() == tasks > 1
