"""Content identities: canonical text, SHA-256 digests, digest trees, numeric run ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN_OUT = 4096
LEVELS = 5  # 4096^5 = 2^60 positions; the root row then holds at most 16 digests


def canonical_json(*columns: str | Column) -> Column:
    """Sorted-key JSON of the columns, nulls kept."""
    names = sorted(c for c in columns if isinstance(c, str))
    return F.to_json(F.struct(*names), {"ignoreNullFields": "false"})


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def run_id_of(digest: Column) -> Column:
    """First 16 hex digits of a digest as an unsigned 64-bit id; 0 becomes 1."""
    number = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    return F.when(number == 0, F.lit(1).cast("decimal(20,0)")).otherwise(number)


def canonical_event() -> Column:
    """One event's typed content as text; spelling variants of a number give the same text."""
    detection = F.transform(
        F.coalesce("measurements", F.array()),
        lambda m: F.concat_ws(" ", m["detection_id"].cast("string"), m["x"].cast("string"), m["y"].cast("string"),
                              m["confidence"].cast("string"), m["uncertainty_radius"].cast("string")))
    optional = [F.coalesce(F.col(c).cast("string"), F.lit("-"))
                for c in ("sensor_id", "sensor_generation", "scan_sequence", "measurement_count", "seed")]
    return F.concat_ws(
        " ", "event_type", F.col("run_id").cast("string"), F.col("run_generation").cast("string"),
        F.col("stream_sequence").cast("string"), F.col("event_time_seconds").cast("string"), *optional,
        F.concat_ws(" ", detection))


def tree_digest(df: DataFrame, keys: Sequence[str], position: str, leaf: Column) -> DataFrame:
    """(keys, digest, leaves): SHA-256 tree over the rows of each key, ordered by `position`.

    A flat digest would collect a key's rows into one value.  Here at most 4,096 digests meet
    in a row, at every level, however many rows a key has; each level is 4,096 times smaller.
    Positions must be unique per key and not negative.
    """
    level = df.select(*keys, F.col(position).cast("bigint").alias("__at"), leaf.alias("__d"), F.lit(1).cast("bigint").alias("__n"))
    for _ in range(LEVELS):
        level = _fold(level.withColumn("__up", F.expr(f"__at div {FAN_OUT}")), [*keys, "__up"]).withColumnRenamed(
            "__up", "__at")
    root = _fold(level, list(keys))
    return root.select(*keys, F.col("__d").alias("digest"), F.col("__n").alias("leaves"))


def _fold(df: DataFrame, keys: list[str]) -> DataFrame:
    children = F.array_sort(F.collect_list(F.struct("__at", "__d")))
    text = F.concat_ws("\n", F.transform(children, lambda c: c["__d"]))
    return df.groupBy(*keys).agg(F.sha2(text, 256).alias("__d"), F.sum("__n").alias("__n"))


def flat_digest(df: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """Order-free digest for tables without positions: count plus two 64-bit hash sums."""
    text = F.col(digest)
    number = [F.conv(F.substring(text, at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 17)]
    total = df.groupBy(*keys) if keys else df.groupBy()
    return total.agg(
        F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *(F.sum(n).cast("string") for n in number)), 256)
        .alias("digest"))
