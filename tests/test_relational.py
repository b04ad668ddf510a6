"""Registered relational queries and rules over small tables made here."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from sonde.operators import rules
from sonde.sources import tables


def test_anti_join_reads_every_order(spark, tmp_path):
    """Only a customer without any order stays; orders of all priorities and states count, one without a customer does not."""
    spark.createDataFrame([(1,), (2,), (3,)], "c_custkey bigint").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, "1-URGENT", "F"), (2, "5-LOW", "O"), (None, "5-LOW", "F")],
                          "o_custkey bigint, o_orderpriority string, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    assert [r.c_custkey for r in entry.queries()["anti_join"](spark, str(tmp_path)).collect()] == [3]


def test_truth_grid_broadcasts_no_ticks(spark):
    """The grid explodes from small rows: its joins go by shuffle, whatever the size estimate says."""
    runs = spark.range(3).select(F.col("id").alias("run_id"), F.lit(2).alias("duration_seconds"), F.lit(2).alias("target_count"), F.lit(8).alias("tick_hz"))
    truth = rules.expected_truth(runs).withColumn("timestamp", F.when((F.col("run_id") == 1) & (F.col("timestamp") == 1), 1.01).otherwise(F.col("timestamp")))
    found = rules.truth_grid(runs, truth.union(truth.filter("run_id = 2 AND timestamp = 0")))
    assert sorted((int(r.run_id or 0), r.detail) for r in found.filter("detail IN ('missing', 'unexpected')").collect()) == [
        (1, "missing"), (1, "missing"), (1, "unexpected"), (1, "unexpected")]
    assert found.count() == 6
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_layout_lines_are_split_once_a_pass(spark):
    """Two passes over the lines, for the sensors and for their first lines: none holds a second copy of the parsing."""
    lines = spark.createDataFrame([("a", 2, "0 1 0 0 0 360 150"), ("a", 3, "0 1 0 0 0 360 150"), ("a", 4, "0 2 0 0 0 360 -1")],
                                  "source string, line_no bigint, line string")
    good, bad = tables.parse_layout(lines.repartition(2))
    assert good.count() == 1 and sorted((r.line_no, r.error) for r in bad.collect()) == [
        (3, "duplicate sensor layout"), (4, "invalid sensor layout")]
    assert good._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 2
