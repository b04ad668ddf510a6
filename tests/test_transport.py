import json

import pytest
from pyspark.sql import functions as F
from recordings import collected

from sonde.operators import transport as O
from sonde.sources import tables

SECOND = 1_000_000_000
MARKS = "experiment_id string, arrival bigint, phase string, sequence bigint, wall_ns bigint"


def marks(spark, *rows):
    return spark.createDataFrame(
        [("e", n, phase, seq, int(round(s * SECOND))) for n, (phase, seq, s) in enumerate(rows)], MARKS)


def events(spark, *rows, key="experiment_id"):
    return spark.createDataFrame(
        [("e", n, seq, payload) for n, (seq, payload) in enumerate(rows)], f"{key} string, arrival bigint, stream_sequence bigint, payload string")


@pytest.fixture(scope="module")
def recovery(spark):
    p = marks(spark, ("produced", 1, 1), ("produced", 2, 2), ("produced", 3, 3))
    c = marks(spark, ("consumed", 1, 1.1), ("pause", 1, 1.2), ("resume", 1, 4), ("consumed", 2, 4.1), ("consumed", 3, 4.2))
    return p, c, events(spark, (1, "a"), (2, "b"), (3, "c"))


def test_backlog_and_recovery(recovery):
    p, c, expected = recovery
    row = O.transport_metrics(p, c, expected, expected, block_rows=2).first()
    assert row["integrity_pass"] and row["trace_integrity_pass"] and row["pause_observed"]
    assert (row["max_backlog"], row["final_backlog"], row["clock_errors"], row["total_consumed"]) == (2, 0, 0, 3)
    assert row["catchup_seconds"] == pytest.approx(.2) and row["produced_events_per_second"] == pytest.approx(1)
    assert row["consumed_events_per_second"] == pytest.approx(2 / 3.1) and row["latency_p50_ms"] == pytest.approx(1200)
    assert O.latency(p, c).count() == 3


def test_unfinished_recovery(spark, recovery):
    p, c, expected = recovery
    row = O.transport_metrics(p, c.filter("sequence <> 3"), expected, expected.filter("stream_sequence <> 3")).first()
    assert (row["final_backlog"], row["catchup_seconds"], row["integrity_pass"]) == (1, None, False)


def test_integrity_counters(spark):
    expected = events(spark, (1, "a"), (2, "b"), (3, "c"))
    actual = events(spark, (3, "c"), (1, "a"), (1, "a"), (1, "changed"))
    row = O.delivery_integrity(expected, actual, ["experiment_id"], block_rows=2).first()
    assert (row["duplicate_count"], row["conflicting_duplicate_count"], row["missing_sequence_count"],
            row["ordering_violations"], row["integrity_pass"]) == (2, 1, 1, 1, False)
    odd = O.delivery_integrity(expected, events(spark, (1, "z"), (2, "b"), (9, "x")), ["experiment_id"]).first()
    assert (odd["payload_mismatches"], odd["unexpected_event_count"], odd["missing_sequence_count"]) == (1, 1, 1)


def test_clock_errors_and_lost_traces(spark):
    one = events(spark, (1, "a"))
    row = O.transport_metrics(marks(spark, ("produced", 1, 2)), marks(spark, ("consumed", 1, 1)), one, one).first()
    assert (row["clock_errors"], row["integrity_pass"], row["max_backlog"]) == (1, False, 0)
    back = O.clock_errors(marks(spark, ("produced", 1, 2), ("produced", 2, 1)), marks(spark, ("consumed", 1, 3))).first()
    assert back["clock_errors"] == 1
    none = O.transport_metrics(marks(spark), marks(spark), one, one).first()
    assert none["trace_integrity_pass"] is False and none["latency_p50_ms"] is None and none["total_produced"] == 0
    repeated = marks(spark, ("produced", 1, 1), ("produced", 1, 2))
    ids = one.select("experiment_id", F.col("stream_sequence").alias("sequence"))
    assert O.trace_integrity(repeated, marks(spark, ("consumed", 1, 3)), ids, ids).first()["trace_integrity_pass"] is False
    # The last produced mark and the first consumed mark count.
    late = O.latency(repeated, marks(spark, ("consumed", 1, 3), ("consumed", 1, 9))).first()
    assert late["latency_ms"] == 1000


def test_outage_boundaries_are_float32(spark):
    scans = spark.createDataFrame(
        [(1, 2, t, 1) for t in (.4, .5, 1.0, 1.5, .1)], "run_id bigint, sensor_id int, acquisition_time_seconds float, measurement_count bigint")
    outages = spark.createDataFrame([(1, 2, .5, 1.5), (1, 2, .1, .2)], "run_id bigint, sensor_id int, start double, end double")
    assert O.per_sensor_stats(scans, outages).first()[2:] == (5, 5, 3)
    assert O.outage_violations(scans, outages).count() == 3


def test_comparison_of_all_null_timings(spark, tmp_path):
    for name in ("a", "b"):
        folder = tmp_path / name
        folder.mkdir()
        timings = {k: None for k in ("produced_events_per_second", "consumed_events_per_second", "latency_p50_ms",
                                     "latency_p95_ms", "latency_p99_ms", "catchup_seconds")}
        (folder / "summary.json").write_text(json.dumps({
            "config": {"name": name}, "transport": "local", "errors": ["failed"],
            "metrics": {"total_produced": 0, "total_consumed": 0, "max_backlog": 0, "duplicate_count": 0,
                        "missing_sequence_count": 0, "integrity_pass": False, **timings}}, indent=2))
    out = O.transport_comparison(tables.read_experiment_summaries(spark, str(tmp_path)))
    rows = collected(out, "scenario")
    assert len(rows) == 2 and rows[0][0] == "a" and rows[0][4:9] == (None,) * 5
    assert dict(out.dtypes)["p50_ms"] == "double"


def test_trace_csv_and_missing_file(spark, tmp_path):
    (tmp_path / "t.csv").write_text("phase,sequence,wall_ns\nproduced,1,10\nproduced,2,5\n")
    rows = collected(tables.read_traces(spark, str(tmp_path)).select("arrival", "phase", "sequence", "wall_ns"), "arrival")
    assert rows == [(2, "produced", 1, 10), (3, "produced", 2, 5)]
    assert tables.read_traces(spark, str(tmp_path / "none.csv")).count() == 0
