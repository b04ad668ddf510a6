"""Grid join, interval bins and equal-depth blocks against plain re-statements; no task holds a whole group."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from recordings import collected

from sonde.functions.folds import gated_pairs
from sonde.operators import evaluation, spatial, transport
from sonde.plans.ordered import carry, depth_blocks

KEYS = ["run_id"]
POINT = "run_id bigint, {} {}, x double, y double"


def brute(tracks, targets, gate):
    return sorted((r, math.hypot(x - tx, y - ty), n, i) for r, i, tx, ty in tracks for q, n, x, y in targets
                  if r == q and all(v is not None and math.isfinite(v) for v in (x, y, tx, ty)) and math.hypot(x - tx, y - ty) <= gate)


@pytest.mark.parametrize("gate", [1.0, 0.1, 7.3, 1e-12, 1e300])
def test_grid_join_finds_every_pair(spark, gate):
    rng = random.Random(5)
    near = lambda: rng.choice([rng.uniform(-9, 9) * gate, rng.randint(-3, 3) * gate, rng.randint(-3, 3) * gate * (1 + 2e-16)])
    odd = [None, float("nan"), float("inf"), -float("inf"), 1e308, -1e308, 0.0, -0.0, gate]
    tracks = [(rng.randint(1, 2), i, near(), near()) for i in range(60)] + [(1, 100 + i, v, 0.0) for i, v in enumerate(odd)]
    targets = [(rng.randint(1, 2), f"t{i}", near(), near()) for i in range(60)] + [(1, f"o{i}", 0.0, v) for i, v in enumerate(odd)]
    got = spatial.gated_join(spark.createDataFrame(tracks, POINT.format("track_id", "bigint")),
                             spark.createDataFrame(targets, POINT.format("truth_id", "string")), KEYS, gate).collect()
    want = brute(tracks, targets, gate)
    assert sorted((r.run_id, r.truth_id, r.track_id) for r in got) == sorted((r, n, i) for r, _, n, i in want)
    assert len(want) > 20


def test_grid_join_builds_few_pairs(spark):
    """Spread points: candidates before the distance test grow with the points, not with their square."""
    n = 4000
    points = spark.range(n).select(F.lit(1).cast("bigint").alias("run_id"), F.col("id"), (F.col("id") % 63 * 10.0).alias("x"), (F.floor(F.col("id") / 63) * 10.0).alias("y"))
    a = points.select("run_id", F.col("id").alias("track_id"), "x", "y")
    b = points.select("run_id", F.col("id").cast("string").alias("truth_id"), "x", "y")
    found = spatial.gated_join(a, b, KEYS, 5.0)
    assert found.count() == n
    cells = a.select(spatial.cell(F.col("x"), 5.0).alias("cx"), spatial.cell(F.col("y"), 5.0).alias("cy"))
    assert cells.distinct().count() == n     # so a track meets the targets of nine cells, each with one at most


def test_crowded_frames_match_as_others(spark):
    rng = random.Random(2)
    frames, truth = [], []
    for f in range(6):
        n = 30 if f else 0
        tracks = [(i, "tentative" if i % 7 == 0 else "confirmed", rng.uniform(0, 40), rng.uniform(0, 40)) for i in range(n)]
        frames.append((1, 0, f, tracks))
        truth.append((1, 0, f, [(f"g{i}", rng.uniform(0, 40), rng.uniform(0, 40)) for i in range(25)]))
    frames = spark.createDataFrame(frames, "run_id bigint, run_generation bigint, source_sequence bigint,"
                                           "tracks array<struct<track_id:bigint,state:string,x:double,y:double>>")
    truth = spark.createDataFrame(truth, "run_id bigint, run_generation bigint, source_sequence bigint, entities array<struct<truth_id:string,x:double,y:double>>")
    rows = lambda limit: [r.asDict(True) for r in evaluation.match_frames(frames, truth, 4.0, limit).orderBy("source_sequence").collect()]
    assert rows(10**9) == rows(0) == rows(400) and sum(len(r["matches"]) for r in rows(0)) > 50


def test_outages_of_one_sensor(spark):
    rng = random.Random(3)
    f32 = lambda v: float(np.float32(v))
    outages = [(1, 2, s := rng.uniform(0, 900), s + rng.choice([0, 0.01, 0.3, 5, 200 if rng.random() < 0.02 else 0.1])) for _ in range(1500)]
    outages += [(1, 3, 5.0, 5.0), (1, 3, 9.0, 8.0), (1, 4, -1e9, 1e9), (1, 5, 1.0, float("inf")), (9, 9, 0.0, 1.0)]
    scans = [(1, rng.choice([2, 2, 2, 3, 4, 5, 6]), n, f32(rng.choice([rng.uniform(-10, 1100), rng.choice(outages[:1500])[2], rng.choice(outages[:1500])[3]])))
             for n in range(3000)]
    scan = spark.createDataFrame(scans, "run_id bigint, sensor_id int, stream_sequence bigint, acquisition_time_seconds float")
    table = spark.createDataFrame(outages, "run_id bigint, sensor_id int, start double, end double")
    got = {r.stream_sequence: r.in_outage for r in transport.in_outage(scan, table).collect()}
    spans = {}
    for _, s, a, b in outages:
        spans.setdefault(s, []).append((f32(a), f32(b)))
    assert len(got) == len(scans) and got == {n: any(a <= t < b for a, b in spans.get(s, ())) for _, s, n, t in scans}
    assert transport.in_outage(scan, table.limit(0)).filter("in_outage").count() == 0
    assert transport.in_outage(scan.limit(0), table).count() == 0
    plan = transport.in_outage(scan, table)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "bin#" in plan


@pytest.mark.parametrize("values", [lambda r: r.randrange(100), lambda r: 10**15 + r.randrange(10) * 10**12, lambda r: r.choice([r.random() * 60, r.random() * 3e7]), lambda r: 5])
def test_depth_blocks(spark, values):
    rng = random.Random(1)
    rows = [(rng.choice("aaaaab"), float(values(rng)), n) for n in range(4000)]
    df = spark.createDataFrame(rows, "k string, v double, n bigint")
    placed = depth_blocks(df, ["k"], "v", 64).collect()
    by = {}
    for r in placed:
        by.setdefault(r.k, []).append((r.v, r.depth_block))
    assert len(placed) == 4000
    for found in by.values():
        found.sort()
        assert all(a[1] <= b[1] for a, b in zip(found, found[1:]))
        assert all(a[1] == b[1] for a, b in zip(found, found[1:]) if a[0] == b[0])
    sums = carry(depth_blocks(df, ["k"], "v", 64), ["k"], ["v", "n"], F.col("depth_block"), sums={"s": F.lit(1)})
    assert [r[0] for r in collected(sums.filter("k = 'a'").select("s"), "s")] == list(range(1, 1 + sum(k == "a" for k, _, _ in rows)))


def test_dense_minute_becomes_many_blocks(spark):
    """A year with all but a few rows in one minute: no block holds much more than it should."""
    dense = spark.range(20_000).select(F.lit("a").alias("k"), (F.col("id") * 3_000 + 10**15).alias("t"))
    year = spark.range(50).select(F.lit("a").alias("k"), (F.col("id") * 600_000_000_000_000 + 1).alias("t"))
    sizes = [r["count"] for r in depth_blocks(dense.union(year), ["k"], "t", 100).groupBy("depth_block").count().collect()]
    assert max(sizes) <= 150 and len(sizes) > 150
    sparse = spark.range(1000).select(F.lit("a").alias("k"), (F.col("id") * 10**13).alias("t"))
    assert depth_blocks(sparse, ["k"], "t", 100).select("depth_block").distinct().count() <= 21


def test_pairs_at_one_distance_go_by_identity(spark):
    """Two pairs whose sums of squares are one double: hypot set them apart in the last bit, against truth id and track id."""
    a = spark.createDataFrame([(1, 26, 18.77, 74.0), (1, 18, 17.08, 45.0)], POINT.format("track_id", "bigint"))
    b = spark.createDataFrame([(1, "15", 37.62, 96.0), (1, "12", 35.93, 67.0)], POINT.format("truth_id", "string"))
    near = {(r.truth_id, r.track_id): r.distance for r in spatial.gated_join(a, b, KEYS, 50.0).collect()}
    squares = lambda dx, dy: math.sqrt(dx * dx + dy * dy)
    assert near["15", 26] == squares(37.62 - 18.77, 96.0 - 74.0) and near["12", 18] == squares(35.93 - 17.08, 67.0 - 45.0)
    assert near["15", 26] == near["12", 18]


def test_distances_inside_a_row_equal_the_grid(spark):
    rng = random.Random(4)
    cents = lambda: round(rng.uniform(0, 90), 2)
    tracks, targets = [(i, "confirmed", cents(), cents()) for i in range(90)], [(f"g{i}", cents(), cents()) for i in range(90)]
    row = spark.createDataFrame([(tracks, targets)], "tracks array<struct<track_id:bigint,state:string,x:double,y:double>>,"
                                                     "entities array<struct<truth_id:string,x:double,y:double>>")
    got = row.select(F.inline(gated_pairs(F.col("tracks"), F.col("entities"), 50.0))).collect()
    want = {(g, i): math.sqrt((gx - x) * (gx - x) + (gy - y) * (gy - y)) for i, _, x, y in tracks for g, gx, gy in targets}
    assert {(r.truth_id, r.track_id): r.distance for r in got} == {k: v for k, v in want.items() if v <= 50.0}
