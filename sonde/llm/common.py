"""Shared pieces: tables in the cluster's shared folder, size-checked joins, components of a link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonde.session import scratch_dir, ship_package

# Rows of a narrow (id, small blob) table that may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20


def tune(spark: SparkSession) -> SparkSession:
    """Arrow batches small enough that a worker holds a few MB of text at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return ship_package(spark)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written once below the shared checkpoint folder: lineage ends there and survives lost executors."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attach(docs: DataFrame, side: DataFrame, on: str | list[str], how: str, width: str | None = None) -> DataFrame:
    """`docs` joined with a stored `side` that has one row per `on`.

    The side is broadcast while its counted rows, and the summed bytes of its blob column `width`,
    are below the bounds above; otherwise both sides are shuffled and AQE splits skewed keys.
    """
    size = F.sum(F.length(width)) if width else F.lit(0)
    rows, wide = side.agg(F.count(F.lit(1)), size).first()
    small = rows <= BROADCAST_ROWS and (wide or 0) <= BROADCAST_BYTES
    return docs.join(F.broadcast(side) if small else side, on, how)


def _is_stars(edges: DataFrame) -> bool:
    """Whether each upper end u of `edges` has one lower end v, which is no upper end itself."""
    ends = edges.select(F.inline(F.array(
        F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))))
    met = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return not met.agg(F.count_if((F.col("ups") > 1) | (F.col("ups") > 0) & (F.col("least") == 0))).first()[0]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, root): the smallest vertex reachable from each vertex of `edges` (columns a, b; BIGINT).

    Alternating stars: every vertex hands its neighbours to the smallest one it knows, first to
    larger neighbours, then to smaller ones, until the edge set is one star per component.  Each
    round is a table in the shared folder, read by one short plan; only a count reaches the driver.
    Vertices without an edge to another vertex are absent.
    """
    small, large = F.least("a", "b"), F.greatest("a", "b")
    now = stored(edges.where("a <> b").select(large.alias("u"), small.alias("v")).distinct(), "stars")
    for _ in range(rounds):
        if _is_stars(now):
            return now.select(F.col("u").alias("v"), F.col("v").alias("root"))
        both = now.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        first, second = F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
        handed = F.when(F.col("v") != F.col("m"), F.array(first, second)).otherwise(F.array(first))
        now = stored(big.join(low, "u").select(F.inline(handed)).distinct(), "stars")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
