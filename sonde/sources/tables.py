"""Readers with declared schemas, dataset views, and user SQL."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonde import schemas
from sonde.functions import grammar as G
from sonde.plans.ordered import settle
from sonde.session import few_listing_tasks


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_track_frames(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Track frames from JSON Lines.  A frame's order is its source sequence."""
    frames = spark.read.schema(schemas.FRAMES).option("mode", "FAILFAST").json(path)
    return frames.select(F.col("_metadata.file_path").alias("source"), F.col("source_sequence").alias("line_no"), "*")


def read_truth_frames(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.schema(schemas.TRUTH_FRAMES).option("mode", "FAILFAST").json(path)


def read_analytical_csv(spark: SparkSession, table: str, path: str | Sequence[str]) -> DataFrame:
    """runs, sensors or ground_truth from CSV with a header; a bad value fails the read."""
    declared = schemas.ANALYSIS_INPUTS[table]
    # Unsigned 64-bit ids have 20 digits; everything is declared, nothing inferred.
    return spark.read.schema(declared).option("mode", "FAILFAST").option("enforceSchema", "false").csv(path, header=True)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Trace marks with `arrival`, their position in the file; a missing file has no marks."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], T.StructType([*schemas.TRACE.fields, T.StructField("source", T.StringType()),
                                                       T.StructField("arrival", T.LongType())]))
    from sonde.sources.recordings import read_recordings

    # Through numbered lines, so a trace of any size keeps its file order.
    lines = read_recordings(spark, path, "*.csv").filter(F.col("line_no") > 1)
    cells = F.split(F.trim("line"), ",")
    return lines.select(
        cells[0].alias("phase"), cells[1].cast("bigint").alias("sequence"), cells[2].cast("bigint").alias("wall_ns"),
        "source", F.col("line_no").alias("arrival"))


def read_experiment_summaries(spark: SparkSession, path: str, pattern: str = "*/summary.json") -> DataFrame:
    """All summary documents below a folder; optional timings keep their type when null."""
    return spark.read.schema(schemas.EXPERIMENT_SUMMARY).option("multiLine", True).json(f"{path}/{pattern}")


def read_layout(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(geometry, rejects) of a sensor layout file; comment and blank lines are skipped."""
    from sonde.sources.recordings import read_recordings

    return parse_layout(read_recordings(spark, path, "*"))


def parse_layout(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    header = lines.filter((F.col("line_no") == 1) & (F.regexp_replace("line", "[\r\n]+$", "") != schemas.LAYOUT_HEADER))
    body = lines.filter((F.col("line_no") > 1) & ~F.col("line").startswith("#") & (F.length(F.regexp_replace("line", G.BLANKS, "")) > 0))
    t = F.col("t")
    number = lambda i: F.when(G.token(t, i).rlike(G.FLOAT.replace("^-?", "^[-+]?")), G.token(t, i).try_cast("double"))
    names = ("x", "y", "heading_degrees", "fov_degrees", "range")
    # Each line is split and parsed once: filters on parsed columns would carry copies of the parsing below them.
    split = settle(body.select("source", "line_no", "line"), t=G.tokens(F.col("line")))
    parsed = settle(split, complete=F.size("t") == 7, generation=G.integer(G.token(t, 0)),
                    sensor_id=G.integer(G.token(t, 1), "int", signed=True), **{n: number(i) for i, n in enumerate(names, 2)}).drop("t")
    valid = (
        F.col("complete") & F.col("generation").isNotNull() & F.col("sensor_id").isNotNull()
        & G.finite(F.col("heading_degrees")) & (F.abs("x") <= 1e12) & (F.abs("y") <= 1e12)
        & (F.col("range") > 0) & (F.col("range") <= 1e12) & (F.col("fov_degrees") > 0) & (F.col("fov_degrees") <= 360))
    checked = settle(parsed, valid=F.coalesce(valid, F.lit(False)))
    key = ["source", "generation", "sensor_id"]
    first = checked.filter("valid").groupBy(*key).agg(F.min("line_no").alias("first_line"))
    marked = checked.join(first, key, "left")
    unique = F.col("valid") & (F.col("line_no") == F.col("first_line"))
    good = marked.filter(unique).select("source", *(f.name for f in schemas.LAYOUT.fields))
    bad = marked.filter(~F.coalesce(unique, F.lit(False))).select(
        "source", "line_no", F.when(F.col("valid"), "duplicate sensor layout").otherwise("invalid sensor layout").alias("error"))
    return good, bad.unionByName(header.select("source", "line_no", F.lit("missing layout header").alias("error")))


def union_sweeps(spark: SparkSession, paths: Sequence[str], *order: str) -> DataFrame:
    """The same table of many sweeps as one, in global order when `order` is given."""
    df = spark.read.parquet(*paths)
    return df.orderBy(*order) if order else df


# ---- published datasets -----------------------------------------------------------------------------

def read_table(spark: SparkSession, root: str, table: str, schema: T.StructType) -> DataFrame:
    """A stored table; empty, with its schema, when nothing was written yet."""
    path = f"{root}/{table}"
    if not path_exists(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields]))
    return spark.read.schema(schema).parquet(path)


def published(spark: SparkSession, root: str, manifest: str = "manifest",
              schema: T.StructType = schemas.MANIFEST) -> DataFrame:
    return read_table(spark, root, manifest, schema)


def open_dataset(spark: SparkSession, root: str, verify: bool | str = True) -> dict[str, DataFrame]:
    """Views `events`, `scans` and `measurements` over the published runs only.

    Rows whose (run, batch) has no manifest row, left by a job that died, are not visible.
    With `verify`, stored row counts are first checked against the manifest; with
    `verify="files"`, the bytes of every published file against their recorded SHA-256 as well.
    """
    few_listing_tasks(spark)
    manifest = published(spark, root)
    if manifest.isEmpty():
        raise ValueError("the dataset has no published runs")
    if not manifest.filter(F.col("schema_version") != schemas.SCHEMA_VERSION).isEmpty():
        raise ValueError("unsupported dataset schema")
    tables = {name: _visible(spark, root, name, schema, manifest) for name, schema in schemas.CLEAN_TABLES.items()}
    if verify:
        from sonde.operators.ingest import read_once, stored_files, verify_files, verify_partitions

        if verify == "files":
            recorded = read_table(spark, root, "files", schemas.FILES).join(
                manifest.select("batch").distinct(), "batch", "left_semi")
            lost = verify_files(recorded, stored_files(spark, f"{root}/clean")).limit(1).collect()
            if lost:
                raise ValueError(f"files do not match their published digests: {lost[0]['file']} {lost[0]['problem']}")
        bad = verify_partitions(manifest, read_once(spark, tables)).limit(1).collect()
        if bad:
            raise ValueError(f"dataset integrity check failed: run {bad[0]['run_id']}: {bad[0]['detail']}")
    return _views(tables)


def _visible(spark: SparkSession, root: str, name: str, schema: T.StructType, manifest: DataFrame) -> DataFrame:
    stored = T.StructType([*schema.fields, T.StructField("batch", T.StringType())])
    rows = read_table(spark, f"{root}/clean", name, stored)
    return rows.join(manifest.select("run_id", "batch"), ["run_id", "batch"], "left_semi").select(
        *(f.name for f in schema.fields))


def open_analysis(spark: SparkSession, root: str, verify: bool = True) -> dict[str, DataFrame]:
    """Opt-in views joining the clean tables with truth, tracks and metrics of analysed runs."""
    manifest = published(spark, root, "analysis_manifest", schemas.ANALYSIS_MANIFEST)
    if manifest.isEmpty():
        raise ValueError("dataset contains no analytical runs")
    clean = open_dataset(spark, root, verify)
    source = published(spark, root).select("run_id", F.col("normalized_sha256").alias("clean_sha256"))
    mismatch = manifest.join(source, "run_id", "left").filter(~F.col("source_sha256").eqNullSafe(F.col("clean_sha256")))
    if not mismatch.isEmpty():
        raise ValueError("analytical/clean source mismatch")
    tables = {}
    for name, schema in schemas.ANALYSIS_TABLES.items():
        stored = T.StructType([*schema.fields, T.StructField("batch", T.StringType())])
        rows = read_table(spark, f"{root}/analysis", name, stored)
        tables[name] = rows.join(manifest.select("run_id", "batch"), ["run_id", "batch"], "left_semi").select(
            *(f.name for f in schema.fields))
    return {**clean, **_views(tables)}


def open_tracks(frames: DataFrame) -> DataFrame:
    """View `track_samples` over track frames."""
    from sonde.operators.tracking import track_samples

    samples = track_samples(frames)
    samples.createOrReplaceTempView("track_samples")
    return samples


def _views(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return dict(tables)


def run_query(spark: SparkSession, text: str, args: Mapping | Sequence | None = None,
              views: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """User SQL over the registered views, with bound parameters (`:name` or `?`)."""
    _views(views or {})
    return spark.sql(text.strip().rstrip(";"), args=args)
