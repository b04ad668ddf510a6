"""Session settings the library relies on, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Semantics (time zone, ANSI) and adaptive execution.  Sizes such as shuffle
# partitions are left to the cluster; AQE coalesces and splits from there.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def few_listing_tasks(spark: SparkSession) -> None:
    """Lists folders by four tasks for each core instead of one for each folder: starting a task takes longer than a listing."""
    spark.conf.set(LISTING, str(4 * spark.sparkContext.defaultParallelism))


def build_session(app: str = "sonde", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's settings; `conf` keys use `__` for `.`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Sends this package's modules to the Python workers, once for each context.

    Functions that run on executors are pickled by reference, so workers must be able to import them
    wherever the driver was started.
    """
    context = spark.sparkContext
    if not getattr(context, "_sonde_shipped", False):
        home = Path(__file__).resolve().parent
        archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{home.name}.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for file in sorted(home.rglob("*.py")):
                out.write(file, str(file.relative_to(home.parent)))
        context.addPyFile(archive)
        context._sonde_shipped = True
    return spark


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    `spark.checkpoint.dir` wins.  Only when the session names none (tests, a laptop) is a
    local folder chosen, and it is then also set as the session's checkpoint folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext.getCheckpointDir()
        if not known and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = known or tempfile.mkdtemp(prefix="spark-")
        if not known:
            spark.sparkContext.setCheckpointDir(root)
    return os.path.join(root, f"{label}-{uuid.uuid4().hex}")
