import glob
import os

import pytest
from pyspark.sql import functions as F
from recordings import HEADER, Script, buoy, collected, edited, events_of, f32, harbour, lines_of, rule_names, without

from sonde.operators import decode, ingest, rules, summaries
from sonde.session import LISTING
from sonde.sources import recordings, sinks, tables


def write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", newline="") as f:
        f.write(text)


def problems(spark, *texts):
    """Rules broken by each text, in order."""
    decoded = decode.decode_events(lines_of(spark, *texts)).cache()
    unique = rules.dedup_events(decode.accepted(decoded))
    found = rules.union_all([rules.grammar_violations(decoded), rules.lifecycle_violations(unique, block_rows=4),
                             rules.conflicting_duplicates(unique)])
    broken = {}
    for row in found.collect():
        broken.setdefault(row["source"], set()).add(row["rule"])
    return [broken.get(f"r{i}", set()) for i in range(len(texts))]


def test_typed_tables_of_a_recording(spark):
    events = events_of(spark, harbour())
    scans, measured = decode.explode_scans(events), decode.explode_measurements(events)
    assert (events.count(), scans.count(), measured.count()) == (16, 6, 6)
    last = measured.filter("run_generation = 0").orderBy(F.desc("stream_sequence")).first()
    assert tuple(last)[2:] == (10, 1.125, 2, 0, 2, 3, 19.25, -6.25, f32(.9), 2.0)
    assert collected(scans.filter("measurement_count = 0").select("stream_sequence", "sensor_id")) == [(7, 8)]
    assert collected(events.filter("seed is not null").select("stream_sequence", "seed"), "stream_sequence") == [
        (2, 8), (3, 10), (4, 14), (12, 8), (13, 10), (14, 14)]
    cadence = {tuple(r)[1:4]: tuple(r)[4:] for r in summaries.scan_cadence(scans).collect()}
    assert cadence == {(0, 2, 0): (2, 1., 1., 1., 1.)} | {k: (1, None, None, None, None) for k in [
        (0, 4, 0), (0, 4, 1), (0, 8, 0), (1, 8, 0)]}
    rows = {tuple(r)[1:3]: tuple(r)[3:] for r in summaries.sensor_summary(decode.event_rows(events), scans).collect()}
    assert rows == {(0, 2): (2, 3, 0, 0., 1.5), (0, 4): (2, 2, 0, 0., 1.), (0, 8): (1, 0, 1, 100., 0.),
                    (1, 2): (0, 0, 0, None, None), (1, 4): (0, 0, 0, None, None), (1, 8): (1, 1, 0, 0., 1.)}


def test_silent_sensors_are_summarised(spark):
    events = events_of(spark, Script(77, (5, 6)).finish(3))
    scans = decode.explode_scans(events)
    assert scans.count() == 0
    rows = summaries.sensor_summary(decode.event_rows(events), scans)
    assert collected(rows.drop("run_id"), "sensor_id") == [(0, s, 0, 0, 0, None, None) for s in (5, 6)]


# (rule that must be reported, event, tokens that are replaced) on `harbour`
EDITS = [
    ("first_is_start", 1, {3: 4}), ("first_is_start", 1, {0: "RUN_RESET"}), ("single_run", 4, {1: 312}),
    ("generation_stable", 16, {2: 0}), ("time_monotone", 10, {4: .3125}), ("finite_nonnegative_time", 16, {4: -1}),
    ("run_reset_transition", 11, {2: 5}), ("sensor_start_order", 3, {5: 9}), ("known_sensor", 10, {5: 6}),
    ("sensor_start_window", 8, {0: "SENSOR_STARTED", 5: 9, 6: "0 5"}), ("sensor_reset_transition", 8, {6: 2}),
    ("scan_generation", 9, {6: 0}), ("scan_sequence_contiguous", 10, {7: 4}), ("detection_identity", 10, {9: 9}),
    ("measurement_values", 9, {12: -.25}), ("measurement_count", 5, {8: 3}), ("measurement_count", 15, {8: 0}),
    ("token_grammar", 3, {4: "0.0 0.0"}), ("token_grammar", 8, {0: "SENSOR_PAUSED"}), ("token_grammar", 6, {10: "inf"}),
    ("token_grammar", 6, {10: "9e38"}), ("token_grammar", 6, {10: "3e-70"}), ("token_grammar", 6, {11: "7,5"}),
    ("token_grammar", 1, {1: 2**64})]


def test_every_rule_finds_its_defect(spark):
    text = harbour()
    rows = text.split("\n")
    cases = [(rule, edited(text, event, tokens)) for rule, event, tokens in EDITS]
    cases += [("token_grammar", text.replace(HEADER, "SENSOR_EVENTS 7")),
              ("finished", without(text, 16)), ("first_is_start", without(text, 1)), ("sequence_contiguous", without(text, 7)),
              ("sequence_contiguous", "\n".join([*rows[:6], rows[7], rows[6], *rows[8:]])),
              ("nothing_after_finish", text + "SENSOR_RESET 311 1 17 0.75 4 1\n"),
              ("conflicting_duplicate", text + edited(text, 9, {10: 19.5}).split("\n")[9] + "\n")]
    assert problems(spark, text, harbour(2**64 - 1), buoy()) == [set()] * 3
    for (rule, changed), got in zip(cases, problems(spark, *(c[1] for c in cases))):
        assert rule in got, (rule, got, changed)
    assert all(problems(spark, *("\n".join(rows[:n]) + "\n" for n in range(2, 17))))


def test_one_rule_computes_no_state_of_others(spark):
    """Each rule alone finds what it finds among all, with no more shuffles than its own state needs."""
    from functools import reduce

    text = harbour()
    texts = [edited(text, event, tokens) for _, event, tokens in EDITS] + [without(text, 16), text + "SENSOR_RESET 311 1 17 0.75 4 1\n"]
    events = rules.dedup_events(decode.accepted(decode.decode_events(lines_of(spark, *texts)))).localCheckpoint()
    every = rules.lifecycle_violations(events, 4)
    alone = {rule: rules.lifecycle_violations(events, 4, (rule,)) for rule in rules.LIFECYCLE_RULES}
    key = ("source", "stream_sequence", "rule", "detail")
    got = collected(reduce(lambda a, b: a.unionByName(b), alone.values()).select(*key), *key)
    assert got == collected(every.select(*key), *key) and {r[2] for r in got} == set(rules.LIFECYCLE_RULES)
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert all(shuffles(alone[r]) == 0 for r in rules.ROW_RULES)
    assert all(shuffles(alone[r]) < shuffles(every) / 2 for r in (*rules.RUN_RULES, *rules.SENSOR_RULES, *rules.LIFE_RULES, "finished"))


def test_duplicates_are_removed_and_digest_is_spelling_free(spark):
    text = harbour()
    respelled = text + edited(text, 6, {10: "18.50"}).split("\n")[6] + "\n" + text.split("\n")[16] + "\n"
    decoded = decode.decode_events(lines_of(spark, text, respelled, edited(text, 15, {10: 4}))).cache()
    verdicts = ingest.examine(decoded, rules.dedup_events(decode.accepted(decoded)).cache(), 4)
    a, b, c = verdicts.orderBy("source").collect()
    assert (a["error"], b["error"], b["duplicates_removed"], b["events"]) == (None, None, 2, 16)
    assert a["normalized_sha256"] == b["normalized_sha256"] != c["normalized_sha256"]


def test_line_numbers_survive_file_splits(spark, tmp_path):
    write(tmp_path, "a.events", "".join(f"line {n}\n" for n in range(1, 5001)))
    write(tmp_path, "b.events", "".join(f"line {n}\r\n" for n in range(1, 301)))
    write(tmp_path, "skip.txt", "line 9\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = recordings.read_recordings(spark, str(tmp_path))
        assert lines.count() == 5300
        assert lines.filter(F.col("line") != F.concat(F.lit("line "), F.col("line_no").cast("string"))).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_short_recordings_are_read_once_and_not_shuffled(spark, tmp_path):
    """Files of one split get their line numbers while they are read; only longer ones are counted by split and joined."""
    lines = spark.createDataFrame([(f"s{k}", n, f"line {n}") for k in range(7) for n in range(1, 400 if k == 3 else 40)],
                                  "source string, line_no bigint, line string")
    path = str(tmp_path / "in")
    sinks.write_recordings(lines, path, ".events")
    assert sorted(os.listdir(path)) == [f"name=s{k}.events" for k in range(7)]
    name = F.regexp_extract("source", r"name=(\w+)", 1).alias("source")
    for least in ("1000", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", least)
        try:
            found = recordings.read_recordings(spark, path)
            assert collected(found.select(name, "line_no", "line"), "source", "line_no") == collected(lines, "source", "line_no")
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    whole = found._jdf.queryExecution().optimizedPlan().children().head().toString()
    assert "Join" not in whole and "Aggregate" not in whole and "Window" not in whole


def test_ingest_end_to_end(spark, tmp_path):
    inbox, root = str(tmp_path / "inbox"), str(tmp_path / "data")
    write(inbox, "one.events", harbour())
    write(inbox, "two.events", buoy(2**64 - 1))
    write(inbox, "bad.events", buoy(5).replace("6.500", "nan"))
    first = ingest.ingest(spark, inbox, root, block_rows=4)
    assert first.totals == {"new_runs": 2, "new_recordings": 2, "unchanged": 0, "rejected": 1}
    clean = tables.open_dataset(spark, root)
    assert {n: df.count() for n, df in clean.items()} == {"events": 22, "scans": 9, "measurements": 8}
    assert {int(r[0]) for r in spark.sql("SELECT DISTINCT run_id FROM scans").collect()} == {311, 2**64 - 1}
    report = {r["status"]: r for r in spark.read.parquet(f"{root}/quality").collect()}
    assert report["passed"]["clean_events"] == report["passed"]["source_events"] and "token_grammar" in report["rejected"]["error"]
    files = sorted(glob.glob(f"{root}/clean/**/*.parquet", recursive=True))

    again = ingest.ingest(spark, inbox, root, block_rows=4)
    assert again.totals == {"new_runs": 0, "new_recordings": 0, "unchanged": 2, "rejected": 1}
    # A new spelling is archived; a reused id with other events is refused; a new run is added.
    write(inbox, "spelling.events", buoy(2**64 - 1).replace("\r\n", "\n").replace("6.500", "6.5"))
    write(inbox, "reuse.events", edited(harbour(), 15, {10: 4}))
    write(inbox, "three.events", buoy(3))
    third = ingest.ingest(spark, inbox, root, block_rows=4)
    assert third.totals == {"new_runs": 1, "new_recordings": 2, "unchanged": 2, "rejected": 2}
    status = {r["source_name"]: (r["status"], r["error"]) for r in third.classified.collect()}
    assert status["spelling.events"][0] == "archived" and "published with other events" in status["reuse.events"][1]
    assert set(files) <= set(glob.glob(f"{root}/clean/**/*.parquet", recursive=True))
    assert collected(spark.sql("SELECT run_id, count(*) FROM events GROUP BY 1").select("count(1)"), "count(1)") == [(6,), (16,)]
    assert tables.open_dataset(spark, root)["events"].count() == 28
    pruned = tables.open_dataset(spark, root, verify=False)["events"].filter("run_id = 311")
    assert "PartitionFilters: [isnotnull(run_id" in pruned._jdf.queryExecution().executedPlan().toString()


def test_interrupted_write_is_recovered_and_damage_is_seen(spark, tmp_path, monkeypatch):
    inbox, root = str(tmp_path / "inbox"), str(tmp_path / "data")
    write(inbox, "one.events", buoy(1))
    with monkeypatch.context() as m:
        m.setattr(ingest, "verify_partitions", lambda *a: (_ for _ in ()).throw(OSError("interrupted")))
        with pytest.raises(OSError):
            ingest.ingest(spark, inbox, root)
    with pytest.raises(ValueError, match="no published runs"):
        tables.open_dataset(spark, root)
    result = ingest.ingest(spark, inbox, root)
    assert result.totals["new_runs"] == 1 and result.classified.first()["status"] == "recovered"
    assert tables.open_dataset(spark, root)["events"].count() == 6
    batch = spark.read.parquet(f"{root}/manifest").first()["batch"]
    assert tables.open_dataset(spark, root, verify="files")["events"].count() == 6
    target = glob.glob(f"{root}/clean/scans/run_id=1/batch={batch}/*.parquet")[0]
    bytes_ = open(target, "rb").read()
    # Same rows, other bytes: only the file check can tell.
    spark.read.parquet(target).coalesce(1).write.option("compression", "gzip").parquet(str(tmp_path / "other"))
    crc = os.path.join(os.path.dirname(target), "." + os.path.basename(target) + ".crc")
    os.replace(crc, str(tmp_path / "old.crc"))
    with open(target, "wb") as f:
        f.write(open(glob.glob(str(tmp_path / "other" / "*.parquet"))[0], "rb").read())
    with pytest.raises(ValueError, match="files do not match.*changed"):
        tables.open_dataset(spark, root, verify="files")
    with open(target, "wb") as f:
        f.write(bytes_)
    lost = glob.glob(f"{root}/clean/measurements/run_id=1/batch={batch}/*.parquet")
    for f in lost:
        os.replace(f, str(tmp_path / os.path.basename(f)))
    with pytest.raises(ValueError, match="integrity"):
        tables.open_dataset(spark, root)


def test_empty_inbox_and_stream_diff(spark, tmp_path):
    os.makedirs(tmp_path / "inbox")
    assert ingest.ingest(spark, str(tmp_path / "inbox"), str(tmp_path / "d")).totals["new_runs"] == 0
    a, b = events_of(spark, harbour()), events_of(spark, edited(harbour(), 15, {10: 4}))
    assert ingest.stream_diff(a, a).count() == 0 and ingest.stream_diff(a, b).count() == 2


def test_sources_of_any_size_have_one_identity(spark, tmp_path):
    write(tmp_path, "a.events", harbour())
    write(tmp_path, "b.events", buoy())
    (tmp_path / "c.events").write_bytes(harbour().replace("\n", "\r\n").encode())
    rows = {r["source_name"]: r["recording_sha256"] for r in recordings.archive_raw(spark, str(tmp_path)).collect()}
    assert rows["a.events"] == rows["c.events"] != rows["b.events"]
    assert len(rows) == 3 and all(len(v) == 64 for v in rows.values())


def test_reconciliation_rules(spark):
    events = events_of(spark, harbour())
    ev, sc, me = decode.event_rows(events), decode.explode_scans(events), decode.explode_measurements(events)
    assert rules.table_constraints({"events": ev, "scans": sc, "measurements": me}).count() == 0
    assert rules.reconcile_scan_measurements(sc, me).count() == rules.reconcile_event_scan(ev, sc).count() == 0
    fewer = me.filter("stream_sequence <> 9")
    assert rules.reconcile_scan_measurements(sc, fewer).count() == 1
    assert rules.reconcile_scan_measurements(sc.filter("stream_sequence <> 9"), me).count() == 1
    assert rules.reconcile_event_scan(ev, sc.filter("stream_sequence <> 7")).count() == 1
    doubled = rule_names(rules.table_constraints({"events": ev.union(ev), "scans": sc, "measurements": me}))
    assert doubled == {"table_keys"}


def test_archived_bytes_come_back(spark, tmp_path, monkeypatch):
    """Every spelling of a file is restored byte for byte after the inbox is empty; equal chunks are stored once."""
    from sonde.sources import archive

    monkeypatch.setattr(archive, "LINES", 3)
    text = "".join(f"line {n} é\n" for n in range(20)).encode()
    files = {"a": text, "b": text, "crlf": text.replace(b"\n", b"\r\n"), "cr": text.replace(b"\n", b"\r"), "open": text[:-1], "empty": b"", "lf": b"\n",
             "bom": b"\xef\xbb\xbf" + text, "bom_open": b"\xef\xbb\xbfx", "raw": b"\xff\xfe\x00\n\x80\n\n", "one": b"x", "blank": b"\n\n\n\nx\n"}
    inbox, store = tmp_path / "in", str(tmp_path / "store")
    inbox.mkdir()
    for name, data in files.items():
        (inbox / f"{name}.events").write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    try:
        archive.archive_bytes(spark, str(inbox), store)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    chunks = spark.read.parquet(f"{store}/chunks")
    assert chunks.count() == chunks.select("chunk").distinct().count()
    for name in files:
        (inbox / f"{name}.events").unlink()
    (inbox / "again.events").write_bytes(text)
    before = chunks.count()
    archive.archive_bytes(spark, str(inbox), store)
    assert spark.read.parquet(f"{store}/chunks").count() == before
    back = {os.path.basename(r.source)[:-7]: bytes(r.content) for r in archive.contents(archive.restore(spark, store)).collect()}
    assert back == {**files, "again": text}
    parts = archive.restore(spark, store).filter("source_name = 'a.events'").orderBy("position").collect()
    assert len(parts) == 7 and b"".join(bytes(p.body) for p in parts) == text


def test_many_runs_are_listed_by_few_tasks(spark, tmp_path):
    """Opening a dataset of 40 runs starts no task for each of its folders."""
    inbox, root, tracker = str(tmp_path / "in"), str(tmp_path / "data"), spark.sparkContext.statusTracker()
    for run in range(1, 41):
        write(inbox, f"{run}.events", buoy(run))
    assert ingest.ingest(spark, inbox, root).totals["new_runs"] == 40
    spark.conf.unset(LISTING)
    spark.sparkContext.setJobGroup("listing", "")
    try:
        views = tables.open_dataset(spark, root, verify=False)
        tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setJobGroup("other", "")
    assert tasks and max(tasks) <= 4 * spark.sparkContext.defaultParallelism < 40
    assert views["events"].select("run_id").distinct().count() == 40


def test_many_runs_are_written_and_read_back_once(spark, tmp_path, monkeypatch):
    """Files of runs are written by their tasks, with digests and checksums; verification opens each once, decoding reads lines once."""
    import hashlib
    import zlib

    folder = str(tmp_path / "t")
    df = spark.range(60).select((F.col("id") % 6).cast("decimal(20,0)").alias("run_id"), F.col("id").alias("stream_sequence"))
    files = sinks.write_clean(df.withColumn("run_id", F.when(F.col("run_id") < 5, F.col("run_id"))), folder, "b:1").collect()
    for f in files:
        data = open(f"{folder}/{f.file}", "rb").read()
        assert (hashlib.sha256(data).hexdigest(), len(data)) == (f.sha256, f.bytes)
        sums = open(f"{folder}/{os.path.dirname(f.file)}/.{os.path.basename(f.file)}.crc", "rb").read()
        assert sums == b"crc\0\0\0\2\0" + b"".join(zlib.crc32(data[i:i + 512]).to_bytes(4, "big") for i in range(0, len(data), 512))
    sinks.write_clean(df.filter("run_id = 1"), folder, "b:1")      # appends
    back = spark.read.schema("run_id decimal(20,0), stream_sequence bigint, batch string").parquet(folder)
    counts = {None if r[0] is None else int(r[0]): r[1] for r in back.filter("batch = 'b:1'").groupBy("run_id").count().collect()}
    assert counts == {0: 10, 1: 20, 2: 10, 3: 10, 4: 10, None: 10}

    stored = ingest.read_once(spark, {"events": df.select("*", F.lit("MEASUREMENTS").alias("event_type"), F.lit(0).alias("measurement_count"), F.lit(1).alias("x"))})
    assert stored["events"].count() == 60 and "x" not in stored["events"].columns
    decoded = decode.decode_events(lines_of(spark, harbour(), "SENSOR_EVENTS 7\n").localCheckpoint())
    assert decoded._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    wrong = decoded.filter("line_no = 1").collect()
    assert [(r.error, r.event_type, r.run_id) for r in wrong] == [("unsupported recording header/version", None, None)]
