"""Content-addressed archive of source bytes: chunks stored once, files as lists of chunks, restored byte for byte."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonde.sources.recordings import read_inbox, read_recordings
from sonde.sources.tables import path_exists

LINES = 4_096     # lines of a chunk
_MANIFEST = "batch string, source string, source_name string, bytes bigint, marked boolean, ended boolean, position bigint, chunk string"
_CHUNKS = "chunk string, body binary"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def empty_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(source, bytes) of files without bytes, which no reader lists; only names pass the driver, as in any listing."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path, pattern)
    status = found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found) or []
    return spark.createDataFrame([(s.getPath().toString(), 0) for s in status if s.isFile() and s.getLen() == 0], "source string, bytes bigint")


def archive_bytes(spark: SparkSession, path: str, archive: str, pattern: str = "*.events") -> DataFrame:
    """Archives the bytes of every recording below `path`; returns the manifest rows of this batch, one for each chunk.

    Files are read by split and cut at line feeds only, so carriage returns and bytes that are no UTF-8 stay as they
    are; whether a file starts with a byte order mark and ends with a line feed follows from its length.  A chunk is
    named by the SHA-256 of its bytes and written if no file had it before.  Manifest rows are written last: what a
    job that died has left is chunks that nothing names.  An empty file has one row without a chunk.
    """
    lines = read_recordings(spark, path, pattern, line_end="\n")
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    body = F.concat(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n"), F.lit("\n")).cast("binary")
    chunks = lines.groupBy("source", F.expr(f"(line_no - 1) div {LINES}").alias("position")).agg(body.alias("body"))
    batch = uuid.uuid4().hex
    chunks.withColumn("chunk", F.sha2("body", 256)).write.parquet(f"{archive}/incoming/{batch}")
    found = spark.read.schema(f"source string, position bigint, {_CHUNKS}").parquet(f"{archive}/incoming/{batch}")
    fresh = found.select("chunk", "body").dropDuplicates(["chunk"]).join(_stored(spark, f"{archive}/chunks", _CHUNKS).select("chunk"), "chunk", "left_anti")
    fresh.write.mode("append").parquet(f"{archive}/chunks")
    held = found.groupBy("source").agg(F.sum(F.length("body")).alias("held"))
    more = F.coalesce("bytes", F.lit(0)) - F.coalesce("held", F.lit(0))      # 3 for a byte order mark, -1 without a last line feed
    files = read_inbox(spark, path, pattern).unionByName(empty_files(spark, path, pattern)).join(held, "source", "left").join(found.select("source", "position", "chunk"), "source", "left")
    files.select(
        F.lit(batch).alias("batch"), "source", F.element_at(F.split("source", "/"), -1).alias("source_name"), "bytes",
        (more >= 2).alias("marked"), more.isin(0, 3).alias("ended"), "position", "chunk").write.mode("append").parquet(f"{archive}/files")
    return _stored(spark, f"{archive}/files", _MANIFEST).filter(F.col("batch") == batch)


def restore(spark: SparkSession, archive: str) -> DataFrame:
    """(batch, source, source_name, bytes, position, body): each archived file's bytes as parts in the order of `position`."""
    files = _stored(spark, f"{archive}/files", _MANIFEST)
    chunks = _stored(spark, f"{archive}/chunks", _CHUNKS).dropDuplicates(["chunk"])
    last = files.groupBy("batch", "source").agg(F.max("position").alias("last"))
    rows = files.join(chunks, "chunk", "left").join(last, ["batch", "source"])
    ended = F.when((F.col("position") == F.col("last")) & ~F.col("ended"), F.substring("body", 1, F.length("body") - 1)).otherwise(F.col("body"))
    whole = F.when(F.col("marked") & (F.coalesce("position", F.lit(0)) == 0), F.concat(F.lit(b"\xef\xbb\xbf"), F.coalesce(ended, F.lit(b"")))).otherwise(F.coalesce(ended, F.lit(b"")))
    return rows.select("batch", "source", "source_name", "bytes", F.coalesce("position", F.lit(0)).alias("position"), whole.alias("body"))


def contents(restored: DataFrame) -> DataFrame:
    """(batch, source, content) of restored files, for readers that want a file in one value (2 GB at most)."""
    parts = F.array_sort(F.collect_list(F.struct("position", "body")))
    return restored.groupBy("batch", "source").agg(
        F.aggregate(F.transform(parts, lambda p: p["body"]), F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b)).alias("content"))
