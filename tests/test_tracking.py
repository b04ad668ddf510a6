import pytest
from pyspark.sql import functions as F
from recordings import Script, collected, events_of, f32, relay, with_frame_lines

from sonde.functions.trackbook import FusionSettings
from sonde.operators import evaluation as M
from sonde.operators import rules, tracking
from sonde.operators.summaries import fusion_totals, track_summary


@pytest.fixture(scope="module", params=[True, False], ids=["split", "whole"])
def fuse(request, spark):
    def run(*texts):
        frames = tracking.fuse_tracks(events_of(spark, *texts), split=request.param, block_rows=3).cache()
        return frames, [r.asDict(True) for r in frames.orderBy("run_id", "source_sequence").collect()]

    return run


def test_overlapping_sensors_share_a_track(fuse):
    s = Script().scan(0, 1, [(100, 20)]).scan(0, 2, [(102, 20)]).scan(.25, 2, [(104, 20)]).scan(.375, 1, [(105, 20)])
    _, rows = fuse(s.finish(.375))
    scans = [r for r in rows if r["source_type"] == "MEASUREMENTS"]
    assert [len(r["tracks"]) for r in scans] == [1, 1, 1, 1]
    assert scans[1]["tracks"][0]["sensors"] == [1, 2] and 100 < scans[1]["tracks"][0]["x"] < 102
    assert [r["tracks"][0]["state"] for r in scans] == ["tentative", "tentative", "confirmed", "confirmed"]
    assert scans[2]["tracks"][0]["vx"] > 0 and scans[3]["tracks"][0]["track_id"] == 1


def test_lifecycle_and_resets(fuse):
    s = Script().scan(0, 1, [(0, 0), (200, 0)]).scan(.25, 2, [(1, 0)]).scan(1, 1).scan(2.25, 2).scan(2.5, 1, [(0, 0)])
    s.reset_sensor(2.5, 1).scan(2.5, 1, [(0, 0)]).reset_run().scan(0, 1, [(0, 0)])
    frames, rows = fuse(s.finish(0))
    by_seq = {r["source_sequence"]: r for r in rows}
    assert by_seq[6]["tracks"][0]["state"] == "coasting" and len(by_seq[6]["retired"]) == 1
    assert by_seq[7]["tracks"] == [] and by_seq[7]["retired"] == [{"track_id": 1, "reason": "timeout"}]
    assert by_seq[8]["tracks"][0]["track_id"] == 3
    assert by_seq[10]["tracks"][0]["track_id"] == 3 and by_seq[10]["associations"][0]["sensor_generation"] == 1
    assert by_seq[11]["source_type"] == "RUN_RESET" and by_seq[11]["retired"] == [{"track_id": 3, "reason": "run_reset"}]
    assert by_seq[14]["tracks"][0]["track_id"] == 4
    totals = fusion_totals(frames).first()
    assert (totals["snapshots"], totals["tracks_created"], totals["retirements"]) == (15, 4, 3)
    assert rules.track_frame_rules(with_frame_lines(frames), block_rows=4).count() == 0


def test_ties_and_gate(fuse):
    s = Script().scan(0, 1, [(-2, 0), (2, 0)]).scan(0, 2, [(0, 0), (0, 0)]).scan(.25, 1, [(300, 0)])
    _, rows = fuse(s.finish(.25))
    assert [a["track_id"] for a in rows[4]["associations"]] == [1, 2]
    assert rows[5]["associations"][0]["track_id"] == 3


def test_settings_are_checked():
    for bad in (dict(gate=0), dict(gate=2e9), dict(alpha=0), dict(beta=1.5), dict(delete_after=.5),
                dict(tentative_timeout=0), dict(confirmation_times=0), dict(gate=float("nan"))):
        with pytest.raises(ValueError):
            FusionSettings(**bad)


SCENARIOS = {
    "overlap": dict(run=1001, sensors=(1, 2), times=[k / 8 for k in range(65)], period={1: 2, 2: 2}),
    "asynchronous": dict(run=1002, sensors=(1, 2, 3), times=[k / 8 for k in range(65)], period={1: 4, 2: 2, 3: 1}),
    "crossing": dict(run=1004, sensors=(1, 2), times=[0, .25, 1.5, 1.75, 2], period={1: 1, 2: 1}),
}


def scenario(name):
    spec = SCENARIOS[name]
    script, truth = Script(spec["run"], spec["sensors"]), []
    for tick, t in enumerate(spec["times"]):
        targets = [("A", -4 + 4 * t, 0.), ("B", 4 - 4 * t, 0.)] if name == "crossing" else [("A", 2 * t, 5.)]
        due = [s for s in spec["sensors"] if tick % spec["period"][s] == 0]
        for s in due:
            script.scan(t, s, [(x, y) for _, x, y in targets], 0.8)
        if due:
            truth.append((spec["run"], 0, len(script.rows), f32(t), targets))
    return script.finish(spec["times"][-1]), truth


def test_noise_free_goldens(spark, fuse):
    texts, truth = zip(*(scenario(n) for n in SCENARIOS))
    frames, _ = fuse(*texts)
    truth = spark.createDataFrame(
        [(str(r[0]), *r[1:4], [(i, float(x), float(y)) for i, x, y in r[4]]) for rows in truth for r in rows],
        "run_id string, run_generation long, source_sequence long, acquisition_time double, "
        "entities array<struct<truth_id:string,x:double,y:double>>").withColumn("run_id", F.col("run_id").cast("decimal(20,0)"))
    assert M.evaluation_guards(frames, truth).count() == 0
    rows = {int(r["run_id"]): r for r in M.run_metrics(frames, truth, 5.0, tracking.fusion_config(frames)).collect()}
    got = {k: (r["target_samples"], round(r["position_rmse"], 4), r["missed_target_samples"], r["false_track_samples"],
               r["id_switches"]) for k, r in rows.items()}
    assert got == {1001: (33, .0060, 1, 0, 0), 1002: (65, .0080, 1, 0, 0), 1004: (10, .0372, 2, 0, 2)}
    assert '"gate":20.0' in rows[1001]["fusion_config"]


def test_split_equals_whole_over_many_quiet_gaps(spark):
    s = Script(7)
    import random
    rng, t = random.Random(3), 0.0
    for n in range(400):
        t += rng.choice([.125, .25, .25, .5, 1.0, 2.0, 2.5])
        s.scan(t, 1 + n % 2, [(rng.uniform(0, 60), rng.uniform(0, 60)) for _ in range(rng.choice([0, 0, 1, 2, 3]))])
        if n in (150, 300):
            s.reset_run()
            t = 0.0
    events = events_of(spark, s.finish(t + 5)).cache()
    whole = tracking.fuse_tracks(events, split=False)
    split = tracking.fuse_tracks(events, block_rows=16)
    segments = tracking.segment_events(events, FusionSettings(), 16)
    assert segments.select("run_generation", "segment").distinct().count() > 20
    order = lambda df: [r.asDict(True) for r in df.orderBy("source_sequence").collect()]
    assert order(whole) == order(split)


def test_short_segments_share_a_fold(spark, monkeypatch):
    s, t = Script(9), 0.0
    for n in range(240):
        t += 2.5 if n % 6 == 0 else .25
        s.scan(t, 1 + n % 2, [(n % 50, 0), (30 + n % 7, 90)])
        if n in (90, 91):
            s.reset_run()
            t = 0.0
    events = events_of(spark, s.finish(t + 5)).cache()
    count = lambda *least: tracking.segment_events(
        events, FusionSettings(), 16, *least).select("run_generation", "segment").distinct().count()
    assert 3 < count(64) < 10 < 40 < count()
    monkeypatch.setattr(tracking, "GIVE", 5)
    order = lambda df: [r.asDict(True) for r in df.orderBy("source_sequence").collect()]
    whole = order(tracking.fuse_tracks(events, split=False))
    assert whole == order(tracking.fuse_tracks(events, block_rows=1024)) == order(tracking.fuse_tracks(events, block_rows=1 << 16))


def test_samples_and_summary(spark, fuse):
    s = Script(sensors=(1, 2)).scan(0, 1, [(1, 1)]).scan(0, 2, [(1, 1)])
    frames, _ = fuse(s.finish(0))
    samples = tracking.track_samples(frames)
    assert collected(samples.select("source_sequence", "observations", "sensor_count")) == [(6, 2, 2)]
    assert track_summary(samples).first()["samples"] == 1
    narrow = tracking.track_samples(frames, ("track_id", "state", "last_seen", "observations"))     # positions are not shuffled
    assert "x" not in narrow.columns and collected(track_summary(narrow)) == collected(track_summary(samples))
    assert tracking.associations(frames).count() == 2


def test_state_and_playback_through_restarts(spark):
    events = events_of(spark, relay()).cache()
    frames = tracking.fuse_tracks(events, block_rows=2).cache()
    assert [tracking.track_trails(frames, n, block_rows=2).count() for n in (4, 5, 8)] == [1, 3, 0]
    state = lambda n: {r["sensor_id"]: (r["sensor_generation"], r["scans"], r["measurements"])
                       for r in tracking.sensor_state(events, n).collect()}
    assert state(5) == {3: (0, 1, 1), 5: (0, 1, 2)} and state(7) == {3: (0, 2, 1), 5: (1, 0, 0)}
    assert state(8) == {} and state(12) == {3: (0, 0, 0), 5: (0, 1, 1)}
    assert [r["latest"] for r in tracking.sensor_state(events, 6).filter("sensor_id = 3").collect()] == [[]]
    timeline = tracking.playback_timeline(events, block_rows=3)
    assert [tracking.due_by(timeline, t).count() for t in (0, .25, .5, 1, 1.125, 1.5)] == [3, 4, 6, 10, 11, 12]
    with pytest.raises(ValueError):
        tracking.due_by(timeline, -1)


def test_trail_is_bounded_and_erased(spark):
    s = Script(1, (1,))
    for i in range(80):
        s.scan(i * .1, 1, [(i * .1, 0)])
    frames = tracking.fuse_tracks(events_of(spark, s.finish(11)), split=False).cache()
    assert tracking.track_trails(frames, 82).count() == 32
    assert tracking.track_trails(frames).count() == 0
    assert tracking.retirements(frames).count() == 1
