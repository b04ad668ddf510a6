import pytest
from pyspark.sql import functions as F

from sonde import schemas
from sonde.operators import evaluation as M
from sonde.plans.ordered import row_blocks


def fixture(spark):
    def track(i, x, y, state="confirmed"):
        return (i, state, float(x), float(y), 0., 0., 0., 1, 1, [1])

    frames = [(1, "GLOBAL_TRACKS", None, g, n, float(n), "MEASUREMENTS", None,
               [track(i, 3, 4), track(99, 100, 100, "coasting")], [], []) for n, g, i in ((1, 0, 1), (2, 0, 2), (3, 1, 3))]
    frames = spark.createDataFrame(frames, schemas.FRAMES).withColumn("run_id", F.lit(1).cast("decimal(20,0)"))
    truth = spark.createDataFrame(
        [(None, g, n, float(n), [("A", 0., 0.), ("B", -100., -100.)]) for n, g in ((1, 0), (2, 0), (3, 1))],
        schemas.TRUTH_FRAMES).withColumn("run_id", F.lit(1).cast("decimal(20,0)"))
    return frames, truth


def test_known_metrics(spark):
    frames, truth = fixture(spark)
    row = M.run_metrics(frames, truth, 5.0, block=row_blocks("source_sequence", 1)).first()
    assert (row["position_rmse"], row["missed_target_samples"], row["false_track_samples"], row["id_switches"],
            row["unique_false_tracks"], row["evaluated_frames"]) == (5, 3, 3, 1, 1, 3)
    assert list(row.asDict()) == schemas.RUN_METRICS.fieldNames()


def test_no_match_gives_null_errors(spark):
    frames, truth = fixture(spark)
    row = M.run_metrics(frames, truth, 1.0).first()
    assert row["position_rmse"] is None and row["mean_position_error"] is None and row["matched_samples"] == 0


def test_guards(spark):
    frames, truth = fixture(spark)
    names = lambda t, f=frames: {r["rule"] for r in M.evaluation_guards(f, t).collect()}
    assert names(truth) == set()
    assert names(truth.union(truth.limit(1))) == {"duplicate_truth_frame"}
    assert names(truth.withColumn("entities", F.concat("entities", "entities"))) == {"duplicate_truth_target"}
    assert names(truth, frames.filter("source_sequence <> 2")) == {"missing_frame"}
    assert names(truth.withColumn("acquisition_time", F.col("acquisition_time") + 1)) == {"truth_time_mismatch"}
    for gate in (0, -1, float("inf"), float("nan")):
        with pytest.raises(ValueError):
            M.match_frames(frames, truth, gate)


def brute(pairs):
    used_t, used_k, out = set(), set(), []
    for d, t, k in sorted(pairs):
        if t not in used_t and k not in used_k:
            used_t.add(t), used_k.add(k), out.append((d, t, k))
    return out


def test_fold_equals_sequential_greedy(spark):
    import random

    from sonde.functions.folds import greedy_one_to_one

    rng = random.Random(5)
    rows = [(n, [(rng.choice([1., 2., 3.]), f"t{rng.randrange(6)}", rng.randrange(6)) for _ in range(rng.randrange(25))])
            for n in range(40)]
    df = spark.createDataFrame(rows, "n int, pairs array<struct<distance:double,truth_id:string,track_id:bigint>>")
    for n, pairs, got in df.select("n", "pairs", greedy_one_to_one(F.col("pairs")).alias("g")).collect():
        assert [tuple(g) for g in got] == brute([tuple(p) for p in pairs])


def test_repeated_ids_stay_missed_and_false(spark):
    """Rows whose id comes twice in a frame: each stays missed or false unless a match holds its id, in lists and in counts."""
    track = "array<struct<track_id:bigint,state:string,x:double,y:double>>"
    frames = spark.createDataFrame(
        [(1, 0, 1, [(1, "confirmed", 0., 0.), (1, "confirmed", 0., 0.), (2, "confirmed", 90., 0.), (2, "confirmed", 90., 0.)])],
        f"run_id bigint, run_generation bigint, source_sequence bigint, tracks {track}")
    truth = spark.createDataFrame(
        [(1, 0, 1, [("A", 0., 0.), ("A", 0., 0.), ("B", -90., 0.), ("B", -90., 0.)])],
        "run_id bigint, run_generation bigint, source_sequence bigint, entities array<struct<truth_id:string,x:double,y:double>>")
    for limit in (10_000, 1):
        matched = M.match_frames(frames, truth, 5.0, limit)
        assert [r.truth_id for r in M.missed_targets(matched).collect()] == ["B", "B"]
        assert [r.track_id for r in M.false_tracks(matched).collect()] == [2, 2]
    row = M.run_metrics(frames, truth, 5.0).first()
    assert (row["matched_samples"], row["false_track_samples"], row["unique_false_tracks"]) == (1, 2, 1)
