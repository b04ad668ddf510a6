"""Block-wise running columns must equal plain windows for any data and any block size."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from recordings import collected

from sonde.plans.ordered import carry, exact_percentiles, first_rows, row_blocks


@pytest.mark.parametrize("rows,size", [(1, 1), (3, 2), (7, 3), (50, 4), (400, 1000)])
def test_carry_equals_window(spark, rows, size):
    rng = random.Random(rows)
    data = [(rng.choice("aaab"), n * 3, rng.choice([None, 1, 2, -3]), rng.choice([None, rng.random()])) for n in range(rows)]
    df = spark.createDataFrame(data, "k string, n bigint, v int, w double")
    got = carry(df, ["k"], ["n"], row_blocks("n", size), sums={"s": F.col("v"), "c": F.lit(1)},
                prior_max={"m": F.col("w"), "p": F.when(F.col("v") > 0, F.struct("n", "v"))},
                lags={"l": F.col("w"), "ln": F.col("n")})
    w = Window.partitionBy("k").orderBy("n")
    prev = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select(
        "k", "n", "v", "w", F.sum(F.coalesce("v", F.lit(0))).over(upto).alias("s"), F.count("*").over(upto).alias("c"),
        F.max("w").over(prev).alias("m"), F.max(F.when(F.col("v") > 0, F.struct("n", "v"))).over(prev).alias("p"),
        F.lag("w").over(w).alias("l"), F.lag("n").over(w).alias("ln"))
    assert collected(got.select(*want.columns), "k", "n") == collected(want, "k", "n")


def test_no_task_needs_a_whole_group(spark):
    """Every shuffle of full rows is keyed by group and block, never by the group alone."""
    df = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("n"), (F.col("id") % 7).alias("v"))
    plan = carry(df, ["k"], ["n"], row_blocks("n", 10), sums={"s": F.col("v")})._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and sum("__block" in line.split("windowspec")[1].split("ASC")[0].split(", n#")[0] for line in windows) >= 1


def test_order_of_input_does_not_matter(spark):
    df = spark.range(200).select((F.col("id") % 3).alias("k"), F.col("id").alias("n"), (F.col("id") % 5).alias("v"))
    run = lambda d: collected(carry(d, ["k"], ["n"], row_blocks("n", 16), sums={"s": F.col("v")}), "k", "n")
    assert run(df) == run(df.orderBy(F.rand(3))) == run(df.repartition(7, "v"))


def test_exact_percentiles(spark):
    data = [("a", float(v)) for v in (30, 0, 20, 10)] + [("b", 9.0)] + [("c", None)]
    df = spark.createDataFrame(data, "k string, v double")
    block = F.floor(F.col("v") / 8).cast("bigint")
    got = {r["k"]: (r["p50"], r["p95"], r["p99"]) for r in exact_percentiles(
        df, ["k"], "v", {"p50": 50, "p95": 95, "p99": 99}, block).collect()}
    assert got["a"] == pytest.approx((15, 28.5, 29.7)) and got["b"] == (9, 9, 9) and "c" not in got
    with pytest.raises(ValueError):
        exact_percentiles(df, ["k"], "v", {"p": 101}, block)
    many = spark.range(1, 1001).select(F.lit("x").alias("k"), (F.pmod(F.col("id") * 7919, 331) / 3).alias("v"))
    ours = exact_percentiles(many, ["k"], "v", {"p": 37.5}, F.floor("v").cast("bigint")).first()["p"]
    assert ours == pytest.approx(many.agg(F.percentile("v", 0.375)).first()[0])


def test_first_rows(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, n int, v string")
    assert collected(first_rows(df, ["k"], ["n"]), "k") == [("a", 1, "y"), ("b", 5, "z")]
    assert collected(first_rows(df, ["k"], ["n"], descending=True), "k") == [("a", 2, "x"), ("b", 5, "z")]
