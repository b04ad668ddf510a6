import os
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F
from recordings import HEADER, Script, collected, events_of, harbour, relay

from sonde.operators import decode, tracking
from sonde.operators.summaries import detections_over_time
from sonde.sources import sinks
from sonde.streaming import live, policies


def write(folder, name, lines, age):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    os.utime(path, (1_700_000_000 + age, 1_700_000_000 + age))


def pieces(folder, text, size, order=None):
    """The recording cut into files that are read in `order`."""
    lines = text.rstrip("\n").split("\n")
    cut = [lines[i:i + size] for i in range(0, len(lines), size)]
    for n, i in enumerate(order or range(len(cut))):
        write(folder, f"p{n:03d}.events", cut[i], n)
    return len(cut)


def events_stream(spark, folder):
    decoded = live.stream_decode(live.stream_lines(spark, folder, files_per_trigger=1))
    return decoded.filter(F.col("error").isNull())


def run(query):
    query.awaitTermination(240)
    assert query.exception() is None and not query.isActive


def longer():
    s = Script(7, (1, 2))
    for n in range(30):
        s.scan(n * .25, 1 + n % 2, [(n, 5), (60 - n, 9)] if n % 3 else [])
    return s.finish(12)


def test_shuffled_live_fusion_equals_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    text = longer()
    n = pieces(folder, text, 9)
    os.makedirs(folder, exist_ok=True)
    pieces(folder, text, 9, [2, 0, 3, 1] + list(range(4, n)))
    run(live.start_table(live.stream_fuse(events_stream(spark, folder)), str(tmp_path / "out"), str(tmp_path / "ck")))
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = tracking.fuse_tracks(events_of(spark, text), split=False)
    columns = ["run_generation", "source_sequence", "acquisition_time", "source_type", "tracks", "associations", "retired"]
    rows = lambda df: [r.asDict(True) for r in df.select(*columns).orderBy("source_sequence").collect()]
    assert rows(got) == rows(batch)


def disordered(kind):
    """Lines of a run whose sixth and seventh events are swapped, or whose tenth is lost, in arrival order."""
    head, *lines = longer().rstrip("\n").split("\n")
    if kind == "swapped":
        lines[6], lines[7] = lines[7], lines[6]
    elif kind == "lost":
        del lines[9]
    return [head, *lines]


@pytest.mark.parametrize("policy, kind", [("strict", "swapped"), ("strict", "lost"), ("reorder", "swapped"), ("reorder", "lost"), ("strict", "right")])
def test_answers_do_not_depend_on_triggers(spark, tmp_path, policy, kind):
    lines, seen = disordered(kind), []
    for n, size in enumerate((1000, 12, 1) if (policy, kind) == ("reorder", "lost") else (1000, 12)):
        folder = str(tmp_path / f"in{n}")
        for k in range(0, len(lines), size):
            write(folder, f"p{k:03d}.events", lines[k:k + size], k)
        checked = live.stream_validate(events_stream(spark, folder), policy, "arrival")
        run(live.start_table(checked, str(tmp_path / f"out{n}"), str(tmp_path / f"ck{n}")))
        seen.append(sorted((r.stream_sequence, r.rule or "", r.missing or 0) for r in spark.read.parquet(str(tmp_path / f"out{n}")).collect()))
    assert all(found == seen[0] for found in seen)
    rules = {rule: sum(r[1] == rule for r in seen[0]) for rule in ("", "gap", "sequence_contiguous")}
    events = 34
    assert rules == {("strict", "swapped"): {"": 7, "gap": 0, "sequence_contiguous": events - 7},
                     ("strict", "lost"): {"": 9, "gap": 0, "sequence_contiguous": events - 10},
                     ("reorder", "swapped"): {"": events, "gap": 0, "sequence_contiguous": 0},
                     ("reorder", "lost"): {"": 9, "gap": 1, "sequence_contiguous": events - 10},
                     ("strict", "right"): {"": events, "gap": 0, "sequence_contiguous": 0}}[policy, kind]


def test_gap_stands_after_reach_or_silence(spark, tmp_path):
    lines = disordered("lost")
    write(str(tmp_path / "in"), "a.events", lines[:22], 0)
    ahead = live.stream_validate(events_stream(spark, str(tmp_path / "in")), arrival="arrival", reach=5)
    run(live.start_table(ahead, str(tmp_path / "out"), str(tmp_path / "ck")))
    rows = collected(spark.read.parquet(str(tmp_path / "out")).filter("rule is not null").select("stream_sequence", "rule", "missing"), "stream_sequence")
    assert rows[0] == (10, "gap", 1) and [r[0] for r in rows[1:]] == list(range(11, 23))
    silent = live.stream_validate(events_stream(spark, str(tmp_path / "in")), arrival="arrival", timeout_seconds=2)
    out = str(tmp_path / "out2")
    query = live.start_table(silent, out, str(tmp_path / "ck2"), available_now=False)
    try:
        for _ in range(60):
            time.sleep(1)
            if os.path.isdir(out) and spark.read.schema(silent.schema).parquet(out).filter("rule = 'gap'").count():
                break
    finally:
        query.stop()
    assert collected(spark.read.parquet(out).filter("rule is not null").select("stream_sequence", "rule", "missing"), "stream_sequence") == rows
    state = live.run_state(spark, str(tmp_path / "ck2")).first()
    assert (state.position, state.failed, state.held) == (9, True, 0)


def test_silence_before_the_finish_is_reported(spark, tmp_path):
    write(str(tmp_path / "in"), "a.events", longer().split("\n")[:12], 0)
    out = str(tmp_path / "out")
    silent = live.stream_fuse(events_stream(spark, str(tmp_path / "in")), arrival="arrival", timeout_seconds=1)
    checked = live.stream_validate(events_stream(spark, str(tmp_path / "in")), arrival="arrival", timeout_seconds=1)
    assert silent.columns[0] == "schema_version"
    query = live.start_table(checked, out, str(tmp_path / "ck"), available_now=False)
    try:
        for _ in range(60):
            time.sleep(1)
            if os.path.isdir(out) and spark.read.schema(checked.schema).parquet(out).filter("rule = 'finished'").count():
                break
    finally:
        query.stop()
    assert collected(spark.read.parquet(out).filter("rule is not null").select("stream_sequence", "rule"), "stream_sequence") == [(12, "finished")]


def test_strict_needs_a_source_order(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    with pytest.raises(ValueError):
        live.stream_validate(events_stream(spark, str(tmp_path / "in")), "strict")


def test_processors_load_outside_the_repository(tmp_path):
    """The Python runner beside the driver has no path to the package."""
    write(str(tmp_path / "in"), "a.events", longer().rstrip("\n").split("\n"), 0)
    script = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark.sql import functions as F
from sonde import build_session
from sonde.streaming import live
spark = build_session("outside", "local[2]", spark__sql__shuffle__partitions="1", spark__ui__enabled="false", spark__checkpoint__dir={str(tmp_path / "ckpt")!r})
events = live.stream_decode(live.stream_lines(spark, {str(tmp_path / "in")!r})).filter(F.col("error").isNull())
live.start_table(live.stream_fuse(events, arrival="arrival"), {str(tmp_path / "out")!r}, {str(tmp_path / "ck")!r}).awaitTermination()
print("frames", spark.read.parquet({str(tmp_path / "out")!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "frames 34" in done.stdout, done.stderr[-2000:]


def test_strict_refuses_and_restart_continues(spark, tmp_path):
    folder, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    lines = harbour().rstrip("\n").split("\n")
    write(folder, "a.events", lines[:6], 0)
    start = lambda: run(live.start_table(live.stream_validate(events_stream(spark, folder), "strict", "arrival"), out, ck))
    start()
    # A second start resumes from the checkpoint: state is kept, nothing is taken twice.
    write(folder, "b.events", [lines[4]] + lines[6:8] + lines[9:10], 1)
    write(folder, "c.events", lines[8:], 2)
    start()
    rows = spark.read.parquet(out)
    refused = collected(rows.filter("rule is not null").select("stream_sequence", "rule"), "stream_sequence")
    assert refused == [(4, "sequence_contiguous"), (9, "sequence_contiguous")]
    accepted = rows.filter("rule is null")
    assert [r[0] for r in collected(accepted.select("stream_sequence"), "stream_sequence")] == list(range(1, 17))
    same = events_of(spark, harbour())
    exact = accepted.withColumn("event_time_seconds", F.col("event_time_seconds").cast("float")).select(*decode.EVENT_COLUMNS)
    assert exact.exceptAll(decode.event_rows(same)).count() == 0


def test_recording_is_complete_only_after_finish(spark, tmp_path):
    folder, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    lines = relay().rstrip("\n").split("\n")
    write(folder, "a.events", lines[:8], 0)
    run(live.stream_record(events_stream(spark, folder), out, ck))
    state = lambda: [tuple(r)[1:] for r in live.recorded_runs(spark.read.parquet(out)).collect()]
    assert state() == [(7, False)]
    write(folder, "b.events", lines[8:], 1)
    run(live.stream_record(events_stream(spark, folder), out, ck))
    assert state() == [(12, True)]


def test_buckets_close_on_their_own_run(spark, tmp_path):
    """Two runs, interleaved, equal the batch buckets under any trigger; scans after the finish are late."""
    one, two = longer().rstrip("\n").split("\n"), relay().rstrip("\n").split("\n")
    mixed = [x for pair in zip(one[1:], two[1:] + [None] * len(one)) for x in pair if x]
    late = next(x for x in one if x.startswith("MEASUREMENTS"))
    counts = lambda df: collected(df.select("run_id", "run_generation", "sensor_id", "second", "scans", "detections", "empty_scans"), "run_id", "run_generation", "sensor_id", "second")
    batch = counts(detections_over_time(decode.explode_scans(events_of(spark, longer(), relay()))).withColumnRenamed("simulation_second", "second"))
    for n, size in enumerate((1000, 9)):
        lines, folder = [one[0], *mixed, late], str(tmp_path / f"in{n}")
        for k in range(0, len(lines), size):
            write(folder, f"p{k:03d}.events", lines[k:k + size], k)
        run(live.start_table(live.stream_detections_over_time(events_stream(spark, folder), "arrival"), str(tmp_path / f"out{n}"), str(tmp_path / f"ck{n}")))
        rows = spark.read.parquet(str(tmp_path / f"out{n}"))
        assert counts(rows.filter("rule is null")) == batch
        assert [r.rule for r in rows.filter("rule is not null").collect()] == ["late"]


def test_buckets_close_on_the_runs_clock(spark, tmp_path):
    """With a delay, buckets are given out while the run goes on; a scan behind the clock is late."""
    lines = longer().rstrip("\n").split("\n")
    scans = [i for i, x in enumerate(lines) if x.startswith("MEASUREMENTS")]
    moved = [*lines[:scans[0]], *lines[scans[1]:scans[20]], lines[scans[0]]]
    for n, size in enumerate((1000, 4)):
        folder = str(tmp_path / f"in{n}")
        for k in range(0, len(moved), size):
            write(folder, f"p{k:03d}.events", moved[k:k + size], k)
        run(live.start_table(live.stream_detections_over_time(events_stream(spark, folder), "arrival", delay=1.0), str(tmp_path / f"out{n}"), str(tmp_path / f"ck{n}")))
    rows = [collected(spark.read.parquet(str(tmp_path / f"out{n}")), "sensor_id", "second", "rule") for n in range(2)]
    assert rows[0] == rows[1] and [r[-1] for r in rows[0]].count("late") == 1 and {r[3] for r in rows[0]} == {0, 1, 2}


def test_open_buckets_share_state_entries(spark, tmp_path):
    lines = longer().rstrip("\n").split("\n")
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "ck")
    entries = lambda: spark.read.format("statestore").option("stateVarName", "buckets").load(checkpoint).count()
    for n, part in enumerate((lines[:-1], lines[-1:])):      # all but the finish, then the finish
        write(folder, f"p{n}.events", part, n)
        run(live.start_table(live.stream_detections_over_time(events_stream(spark, folder), "arrival"), str(tmp_path / "out"), checkpoint))
        rows = spark.read.parquet(str(tmp_path / "out")).count()
        assert (rows, entries()) == (0, 1) if n == 0 else rows > 1 and entries() == 0


def test_dedup_and_independent_consumers(spark, tmp_path):
    folder = str(tmp_path / "in")
    text = longer()
    pieces(folder, text, 9)
    lines = text.rstrip("\n").split("\n")
    other = lines[7].replace(" 2.0", " 2.5") if " 2.0" in lines[7] else lines[7] + "0"
    write(folder, "repeat.events", lines[5:7] + [other], 1.5)      # before the run is complete
    write(folder, "tail.events", lines[8:10], 90)                  # after it
    events = events_stream(spark, folder)
    one = live.start_table(live.stream_dedup(events, "arrival"), str(tmp_path / "one"), str(tmp_path / "ck1"))
    two = live.start_table(events, str(tmp_path / "two"), str(tmp_path / "ck2"))
    run(one), run(two)
    rules = {r.rule: r["count"] for r in spark.read.parquet(str(tmp_path / "one")).groupBy("rule").count().collect()}
    assert rules[None] == 34 and rules["late"] == 2 and rules["duplicate_event"] >= 2
    assert spark.read.parquet(str(tmp_path / "two")).count() == sum(rules.values())


def test_sensor_state_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    pieces(folder, relay(), 4)
    latest = {}
    query = live.start_batches(live.stream_sensor_state(events_stream(spark, folder)), lambda df, n: latest.update(
        {(r["run_generation"], r["sensor_id"], r["sensor_generation"]): (r["scans"], r["measurements"]) for r in df.collect()}), str(tmp_path / "ck"))
    run(query)
    assert latest == {(0, 3, 0): (2, 1), (0, 5, 0): (1, 2), (0, 5, 1): (0, 0), (1, 3, 0): (0, 0), (1, 5, 0): (1, 1)}


def test_messages_check_envelope_and_key(spark, tmp_path):
    events = events_of(spark, harbour())
    messages = sinks.transport_messages(decode.recording_lines(events))
    assert decode.decode_messages(messages).filter("error is null").count() == 16
    again = decode.accepted(decode.decode_messages(messages)).select(*decode.EVENT_COLUMNS)
    assert again.exceptAll(decode.event_rows(events)).count() == 0
    body = "RUN_STARTED 1 0 1 0\n"
    rows = [("2", f"{HEADER}\n{body}"), (None, f"{HEADER}\n{body}"), ("1", f"SENSOR_EVENTS 2\n{body}"),
            ("1", f"{HEADER}\n{body}{body}"), ("1", f"{HEADER}\n"), ("1", f"{HEADER}\n{body}")]
    out = decode.decode_messages(spark.createDataFrame(rows, "key string, value string"))
    assert [r["error"] is None for r in out.collect()] == [False] * 5 + [True]
    # The same rows through a file stream stand in for a broker.
    messages.withColumn("value", F.col("value").cast("binary")).withColumn("key", F.col("key").cast("binary")).write.parquet(
        str(tmp_path / "topic"))
    topic = spark.readStream.schema("key binary, value binary").parquet(str(tmp_path / "topic"))
    run(live.start_table(live.stream_messages(topic), str(tmp_path / "out"), str(tmp_path / "ck")))
    assert spark.read.parquet(str(tmp_path / "out")).filter("error is null").count() == 16


def test_events_that_wait_within_a_batch_touch_no_state():
    """Of 100 events from back to front only those that still wait when their batch ends are written, one call each."""
    import json
    from types import SimpleNamespace

    import pandas as pd

    class Kept(dict):
        calls = 0

        def exists(self):
            return bool(self)

        def get(self):
            return self["value"]

        def update(self, value):
            self["value"] = value

        def updateValue(self, k, value):  # noqa: N802
            self[k], self.calls = value, self.calls + 1

        def removeKey(self, k):  # noqa: N802
            del self[k]
            self.calls += 1

        def containsKey(self, k):  # noqa: N802
            self.calls += 1
            return k in self

        def getValue(self, k):  # noqa: N802
            return self[k]

        def iterator(self):
            return iter(list(self.items()))

    def event(n):
        kind = "RUN_STARTED" if n == 1 else "SENSOR_STARTED"
        return json.dumps({"event_type": kind, "run_id": 1, "run_generation": 0, "stream_sequence": n, "event_time_seconds": 0.0,
                           "sensor_id": n if n > 1 else None, "sensor_generation": 0 if n > 1 else None, "seed": 1 if n > 1 else None})

    states = {name: Kept() for name in ("run", "sensors", "waiting", "tracks")}
    processor = policies.RunProcessor("reorder", None, 10_000, None, True)
    processor.init(SimpleNamespace(getValueState=lambda n, _: states[n], getMapState=lambda n, *_: states[n]))
    taken = []
    for batch, waiting in ((range(100, 50, -1), 50), (range(50, 1, -1), 99), ([1], 0)):
        rows = pd.DataFrame({"arrival": range(len(batch)), "stream_sequence": list(batch), "body": [event(n) for n in batch]})
        for out in processor.handleInputRows((1,), iter([rows]), None):
            taken += out["stream_sequence"].tolist()
            assert out["rule"].isna().all()
        assert len(states["waiting"]) == waiting
    assert taken == list(range(1, 101)) and states["waiting"].calls == 99 + 99      # each written once and removed once


def test_a_recording_makes_no_file_for_each_run(spark, tmp_path):
    """Twelve runs in one micro-batch are as many files as tasks have rows, each run whole and in order in one of them."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    texts = [Script(k, (1, 2)).scan(.5, 1, [(1, 2)]).finish(1).rstrip("\n").split("\n") for k in range(1, 13)]
    write(folder, "a.events", [texts[0][0], *(line for group in zip(*texts) for line in group if line != texts[0][0])], 0)
    run(live.stream_record(events_stream(spark, folder), out, str(tmp_path / "ck"), arrival="arrival"))
    files = [f for _, _, names in os.walk(out) for f in names if f.endswith(".parquet")]
    assert 0 < len(files) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    back = spark.read.parquet(out)
    assert dict(back.dtypes)["run_id"] == "decimal(20,0)"
    whole = back.withColumn("file", F.input_file_name()).groupBy("run_id").agg(F.countDistinct("file").alias("files"), F.max("stream_sequence").alias("last"))
    assert {(int(r.run_id), r.files, r.last) for r in whole.collect()} == {(k, 1, len(texts[0]) - 1) for k in range(1, 13)}
    assert {(int(r[0]), r[1], r[2]) for r in live.recorded_runs(back).collect()} == {(k, len(texts[0]) - 1, True) for k in range(1, 13)}
